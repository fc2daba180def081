"""A git repository read at a commit by Spark: trees level by level, blobs in tasks, from loose objects and packs, without a git binary.

The repository lies in a folder that driver and executors share, bare or with a work tree; the work tree is never read. Ids are SHA-1.
The driver resolves one name and opens one commit; all trees and blobs are read in tasks.

Defined results: links to other repositories (submodules) are left out, symbolic links are files that hold their target; names that aren't
UTF-8 get replacement characters; an object that isn't there (a partial clone) has a null size and no content; an empty commit has no rows.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Fixed values of the format of packs: types of entries, and how a version 2 index begins.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_PLACE, BY_ID = 6, 7
INDEX_MAGIC = b"\xfftOc\x00\x00\x00\x02"
ID = 20
SUBMODULE, FOLDER = b"160000", b"40000"
#: Where a short name is looked for (fixed values, in order).
PLACES = ("{}", "refs/{}", "refs/tags/{}", "refs/heads/{}", "refs/remotes/{}")
#: Bytes of delta bases that a task keeps, and of contents that it sends at once.
KEPT_BYTES, SENT_BYTES = 64 << 20, 16 << 20


def _inflated(raw, at: int, most: int | None = None) -> bytes:
    """What the zlib stream at a place holds, or its first `most` bytes; the input is fed in pieces, so that no tail of a pack is copied."""
    stream, out, have = zlib.decompressobj(), [], 0
    while not stream.eof and at < len(raw) and (most is None or have < most):
        out.append(stream.decompress(raw[at : at + 16384]))
        have += len(out[-1])
        at += 16384
    return b"".join(out)[:most]


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object that copies from `base` and insertions make."""
    size, at = _varint(delta, 0)
    target, at = _varint(delta, at)
    if size != len(base):
        raise ValueError("delta of another base")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op < 128:
            out += delta[at : at + op]
            at += op
            continue
        fields = [0] * 7
        for i in range(7):
            if op >> i & 1:
                fields[i] = delta[at]
                at += 1
        start, n = int.from_bytes(bytes(fields[:4]), "little"), int.from_bytes(bytes(fields[4:]), "little") or 1 << 16
        out += base[start : start + n]
    if len(out) != target:
        raise ValueError("delta of another size")
    return bytes(out)


class Pack:
    """A pack and its index, both mapped: only the pages that are looked at are read."""

    def __init__(self, index: str):
        self.index, self.raw = (self._map(p) for p in (index, index[:-3] + "pack"))
        if self.index[:8] != INDEX_MAGIC:
            raise ValueError(f"{index}: not an index of version 2")
        self.fan = struct.unpack(">256I", self.index[8 : 8 + 1024])
        self.ids = 8 + 1024
        self.places = self.ids + self.fan[-1] * (ID + 4)
        self.far = self.places + self.fan[-1] * 4

    @staticmethod
    def _map(path: str) -> mmap.mmap:
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def find(self, id_: bytes) -> int | None:
        """Where an object lies, by the fan-out over first bytes and bisection within."""
        low, high = self.fan[id_[0] - 1] if id_[0] else 0, self.fan[id_[0]]
        k = bisect_left(range(high), id_, low, high, key=lambda i: self.index[self.ids + i * ID : self.ids + (i + 1) * ID])
        if k == high or self.index[self.ids + k * ID : self.ids + (k + 1) * ID] != id_:
            return None
        (at,) = struct.unpack_from(">I", self.index, self.places + 4 * k)
        return at if at < 1 << 31 else struct.unpack_from(">Q", self.index, self.far + 8 * (at - (1 << 31)))[0]

    def entry(self, start: int) -> tuple[int, int, int | bytes | None, int]:
        """Type, size as written, base (a place in this pack or an id) and where the stream begins."""
        head, at = self.raw[start], start + 1
        kind, size = head >> 4 & 7, head & 15
        if head >= 128:
            more, at = _varint(self.raw, at)
            size |= more << 4
        if kind == BY_ID:
            return kind, size, self.raw[at : at + ID], at + ID
        if kind != BY_PLACE:
            return kind, size, None, at
        b, at = self.raw[at], at + 1
        back = b & 127
        while b >= 128:
            b, at = self.raw[at], at + 1
            back = (back + 1 << 7) | (b & 127)
        return kind, size, start - back, at


class Objects:
    """All objects of a repository: loose ones, packs, and those of repositories that it borrows from."""

    def __init__(self, repo: str):
        inner = os.path.join(repo, ".git")
        self.root = inner if os.path.isdir(inner) else repo
        self.folders, queue = [], [os.path.join(self.root, "objects")]
        while queue:
            folder = queue.pop(0)
            if folder in self.folders:
                continue
            if not os.path.isdir(folder):
                raise FileNotFoundError(f"no git objects in {folder}")
            self.folders.append(folder)
            borrowed = os.path.join(folder, "info", "alternates")
            if os.path.exists(borrowed):
                with open(borrowed, encoding="utf-8") as f:
                    queue += [os.path.normpath(os.path.join(folder, line.strip())) for line in f if line.strip() and not line.startswith("#")]
        packed = [os.path.join(f, "pack") for f in self.folders]
        self.packs = [Pack(os.path.join(p, n)) for p in packed if os.path.isdir(p) for n in sorted(os.listdir(p)) if n.endswith(".idx")]
        self.bases: OrderedDict[tuple[int, int], tuple[str, bytes]] = OrderedDict()
        self.held = 0

    def _loose(self, id_: str, most: int | None) -> bytes | None:
        for folder in self.folders:
            path = os.path.join(folder, id_[:2], id_[2:])
            if os.path.exists(path):
                with open(path, "rb") as f:
                    return _inflated(f.read(None if most is None else 4096), 0, most)
        return None

    def _place(self, id_: str) -> tuple[int, int] | None:
        raw = bytes.fromhex(id_)
        return next(((k, at) for k, p in enumerate(self.packs) if (at := p.find(raw)) is not None), None)

    def _packed(self, place: tuple[int, int]) -> tuple[str, bytes]:
        """Down a chain of deltas to a base that is whole or kept, then up again; bases on the way are kept for other chains."""
        chain = []
        while place not in self.bases:
            pack = self.packs[place[0]]
            kind, _, base, at = pack.entry(place[1])
            chain.append((place, _inflated(pack.raw, at)))
            if base is None:
                got = KINDS[kind], chain.pop()[1]
                self._keep(place, got)
                break
            if isinstance(base, bytes):
                below = self._place(base.hex())
                if below is None:
                    loose = self.read(base.hex())
                    if loose is None:
                        raise ValueError(f"base {base.hex()} isn't there")
                    got = loose
                    break
                place = below
            else:
                place = place[0], base
        else:
            self.bases.move_to_end(place)
            got = self.bases[place]
        for at, delta in reversed(chain):
            got = got[0], apply_delta(got[1], delta)
            self._keep(at, got)
        return got

    def _keep(self, place: tuple[int, int], got: tuple[str, bytes]) -> None:
        self.bases[place] = got
        self.held += len(got[1])
        while self.held > KEPT_BYTES and self.bases:
            self.held -= len(self.bases.popitem(last=False)[1][1])

    def read(self, id_: str) -> tuple[str, bytes] | None:
        """(type, content), or null for what isn't there."""
        loose = self._loose(id_, None)
        if loose is not None:
            head, _, data = loose.partition(b"\0")
            return head.split()[0].decode(), data
        place = self._place(id_)
        return None if place is None else self._packed(place)

    def size(self, id_: str) -> int | None:
        """The size of an object's content, from its head alone: a delta names the size of what it makes."""
        loose = self._loose(id_, 64)
        if loose is not None:
            return int(loose.partition(b"\0")[0].split()[1])
        place = self._place(id_)
        if place is None:
            return None
        pack = self.packs[place[0]]
        kind, size, base, at = pack.entry(place[1])
        if base is None:
            return size
        head = _inflated(pack.raw, at, 32)
        return _varint(head, _varint(head, 0)[1])[0]

    def resolve(self, name: str) -> str | None:
        """The commit of a full id, HEAD, branch or tag (looked for as in PLACES); null if there is none."""
        id_ = name if re.fullmatch(r"[0-9a-f]{40}", name) else next(filter(None, (self._ref(p.format(name)) for p in PLACES)), None)
        while id_:
            got = self.read(id_)
            if got is None or got[0] not in ("commit", "tag"):
                return None
            if got[0] == "commit":
                return id_
            id_ = got[1].split(b"\n", 1)[0].split()[1].decode()
        return None

    def _ref(self, name: str, hops: int = 5) -> str | None:
        if not hops or ".." in name.split("/") or name.startswith("/"):
            return None
        path = os.path.join(self.root, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                value = f.read().strip()
            return self._ref(value[5:].strip(), hops - 1) if value.startswith("ref: ") else value if re.fullmatch(r"[0-9a-f]{40}", value) else None
        packed = os.path.join(self.root, "packed-refs")
        if not os.path.exists(packed):
            return None
        with open(packed, encoding="utf-8") as f:
            return next((x[0] for x in (line.split() for line in f) if len(x) == 2 and x[1] == name), None)

    def tree(self, commit: str) -> str:
        kind, data = self.read(commit) or ("", b"")
        if kind != "commit":
            raise ValueError(f"no commit {commit}")
        return data.split(b"\n", 1)[0].split()[1].decode()

    def entries(self, tree: str | None) -> tuple[dict[str, tuple[bytes, str]], dict[str, str]]:
        """(files, folders) of a tree by name: mode and id of each file, id of each folder. No tree has neither."""
        files, folders = {}, {}
        if tree is None:
            return files, folders
        got = self.read(tree)
        if got is None or got[0] != "tree":
            raise ValueError(f"no tree {tree}")
        data, at = got[1], 0
        while at < len(data):
            space, zero = data.index(b" ", at), data.index(b"\0", at)
            mode, name, id_ = data[at:space], data[space + 1 : zero].decode("utf-8", "replace"), data[zero + 1 : zero + 1 + ID].hex()
            at = zero + 1 + ID
            if mode == FOLDER:
                folders[name] = id_
            elif mode != SUBMODULE:
                files[name] = mode, id_
        return files, folders


def resolve(repo: str, name: str) -> str:
    """The commit that a name stands for; an error if there is none."""
    commit = Objects(repo).resolve(name)
    if commit is None:
        raise ValueError(f"no commit {name!r} in {repo}")
    return commit


STEP = "path string, folder boolean, before string, after string"


def changed(spark: SparkSession, repo: str, before: str | None, after: str) -> DataFrame:
    """(path, before, after): files of either commit whose id or mode differs, with both blob ids (null where there is no file).

    Trees are compared pair by pair, one level after the other, each level written before the next; equal trees are never opened. Without
    a commit before, or where it isn't there any more, these are all files of `after`.
    """
    objects = Objects(repo)
    old = objects.tree(before) if before and objects.resolve(before) else None
    new = objects.tree(after)
    level = spark.createDataFrame([("", True, old, new)] if old != new else [], STEP)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            own = own or Objects(repo)
            for path, a, z in zip(*[b.column(c).to_pylist() for c in ("path", "before", "after")]):
                (files, folders), (files_now, folders_now) = own.entries(a), own.entries(z)
                rows = [(path + n, False, (x or (0, None))[1], (y or (0, None))[1]) for n in sorted(files.keys() | files_now.keys()) if (x := files.get(n)) != (y := files_now.get(n))]
                rows += [(f"{path}{n}/", True, folders.get(n), folders_now.get(n)) for n in sorted(folders.keys() | folders_now.keys()) if folders.get(n) != folders_now.get(n)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[at : at + 10_000]), (pa.string(), pa.bool_(), pa.string(), pa.string()))], names=["path", "folder", "before", "after"])

    found = None
    while not level.isEmpty():
        # Folders of one level are dealt evenly, however they lie.
        level = materialize(level.select("path", "before", "after").repartition("path").mapInArrow(compare, STEP), "git-level")
        files = level.where("NOT folder").select("path", "before", "after")
        found = files if found is None else found.unionByName(files)
        level = level.where("folder")
    return found if found is not None else spark.createDataFrame([], "path string, before string, after string")


def listing(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    """(path, blob): all files of a commit."""
    return changed(spark, repo, None, commit).select("path", F.col("after").alias("blob"))


def sizes(files: DataFrame, repo: str) -> DataFrame:
    """`files` (with blob) with the size of each, from heads alone."""

    def run(batches):
        own = None
        for b in batches:
            own = own or Objects(repo)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if i is None else own.size(i) for i in b.column("blob").to_pylist()], pa.int64())], names=[*b.schema.names, "size"])

    return files.drop("size").mapInArrow(run, files.drop("size").select("*", F.lit(0).cast("long").alias("size")).schema)


def contents(files: DataFrame, repo: str) -> DataFrame:
    """(path, blob, content) of `files` (path, blob); at most SENT_BYTES and one file more are held at once."""

    def run(batches):
        own = None
        for b in batches:
            own, rows, held = own or Objects(repo), [], 0
            for path, blob in zip(b.column("path").to_pylist(), b.column("blob").to_pylist()):
                got = own.read(blob) if blob else None
                rows.append((path, blob, got[1] if got else None))
                held += len(got[1]) if got else 0
                if held >= SENT_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names=["path", "blob", "content"])

    # Neighbours by name are often deltas of one base; a task gets ranges of names.
    return files.select("path", "blob").mapInArrow(run, "path string, blob string, content binary")
