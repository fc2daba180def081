"""WARC archives: writing, an index of where each record lies, and coalesced byte-range reads.

Each task writes archives of its own (a gzip member for each record) under new names, and returns
index rows: file, offset, length, url, digest. The index is a written table; a task that runs again leaves
an archive that no index row names. Reads come from the index alone: selected rows are ordered by file and
offset, neighbours are joined into ranges, and each range is read at once.

Archives go to a folder that driver and executors share, through pyarrow's file systems.

Defined results: a null payload is empty; a null key writes a response; of rows with equal key and payload all
are what the first is; a null URL reads back as null; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize, scratch

#: A range is joined to the one before if at most so many bytes lie between, up to so many bytes.
GAP, RANGE = 64 * 1024, 8 * 1024 * 1024
#: Bytes of records that one task reads.
TASK = 16 * 1024 * 1024
#: Rows that are written or yielded at once.
ROWS = 128
#: A new archive is begun after so many bytes.
ARCHIVE = 1 << 30
NO_URL = "urn:corvane:none"
INDEX = "file string, offset long, length long, url string, digest string, payload_bytes long, key string, record_type string, refers_to string"
READ = "key string, url string, record_type string, refers_to string, digest string, payload_bytes long, payload binary, intact boolean"


def payload_digest(payload: bytes) -> str:
    """Bare base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: str, url: str | None, digest: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit of the record refers_to, which has no payload of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:corvane:page:{quote(key, safe='')}>", f"WARC-Date: {date}", f"WARC-Target-URI: {NO_URL if url is None else quote(url, safe=SAFE)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:corvane:page:{quote(refers_to, safe='')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters that a URL keeps as they are; % is escaped, so that reading gives back what was written.
SAFE = "!#$&'()*+,/:;=?@[]~"


def parse(raw: bytes) -> dict:
    """The fields of READ from a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))[16:])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    name = lambda x: unquote(x.removeprefix("<urn:corvane:page:").removesuffix(">"))
    intact = fields["WARC-Block-Digest"] == f"sha1:{payload_digest(block)}" and (kind == "revisit" or payload_digest(payload) == digest)
    return {
        "key": name(fields["WARC-Record-ID"]) or None, "url": None if fields["WARC-Target-URI"] == NO_URL else unquote(fields["WARC-Target-URI"]), "record_type": kind, "refers_to": name(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "digest": digest, "payload_bytes": n, "payload": payload if kind == "response" else None, "intact": intact,
    }


def firsts(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """(sha1, first): the smallest key of each payload of at least `least` bytes that more than one row has."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    found = pages.select(F.sha1(body).alias("sha1"), F.octet_length(body).alias("n"), F.col(f"`{key}`").alias("k")).where(F.col("n") >= least)
    return found.groupBy("sha1").agg(F.min("k").alias("first"), F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL").select("sha1", "first")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a record under `path`; the index, as a written table."""
    again = broadcast_if_small(materialize(firsts(pages, key, payload, least), "firsts"))
    k = F.col(f"`{key}`")
    named = pages.select(k.alias("k"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary").alias("body")).withColumn("sha1", F.sha1("body"))
    ready = named.join(again, "sha1", "left").select(F.coalesce(F.col("k").cast("string"), F.lit("")).alias("key"), F.col("url").cast("string").alias("url"), "body", F.when(F.col("first") < F.col("k"), F.col("first").cast("string")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                index = []
                for r in whole.slice(begin, ROWS).to_pylist():
                    if out is None or at > ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(name, compression=None)
                    digest = payload_digest(r["body"])
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(record(r["key"], r["url"], digest, r["body"], r["refers_to"], date)) + packer.flush()
                    out.write(member)
                    index.append((name.rpartition("/")[2], at, len(member), r["url"], digest, len(r["body"]), r["key"] or None, "response" if r["refers_to"] is None else "revisit", r["refers_to"]))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), TYPES)], names=NAMES)
        if out is not None:
            out.close()

    return materialize(ready.mapInArrow(run, INDEX), "warc-index")


NAMES = [x.split()[0] for x in INDEX.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in INDEX.split(", ")]


def ranges(spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, begin, end, the records in it) for records (file, offset, length) in order."""
    file, begin, end, own = "", 0, 0, []
    for f, o, n in spans:
        if own and (f != file or o - end > GAP or o + n - begin > RANGE):
            yield file, begin, end, own
            own = []
        if not own:
            file, begin = f, o
        own.append((o, n))
        end = o + n
    if own:
        yield file, begin, end, own


def read(index: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of `index` name, from the archives under `path`. Without payloads, payload is null.

    intact: whether block and payload have the digests that the record states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        names = [x.split()[0] for x in READ.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in READ.split(", ")]
        opened, handle = "", None
        for b in batches:
            for file, begin, end, own in ranges(list(zip(*[b.column(i).to_pylist() for i in range(3)]))):
                if file != opened:
                    opened, handle = file, store.open_input_file(f"{folder}/{file}")
                whole = handle.read_at(end - begin, begin)
                for k in range(0, len(own), ROWS):
                    found = [parse(zlib.decompress(whole[o - begin : o - begin + n], 31)) for o, n in own[k : k + ROWS]]
                    if not payloads:
                        found = [x | {"payload": None} for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in zip(names, types)], names=names)

    spans = index.select("file", "offset", "length")
    parts = max(1, -(-(spans.agg(F.sum("length")).first()[0] or 0) // TASK))
    sorted_ = spans.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return sorted_.mapInArrow(run, READ)


def new_folder(spark: SparkSession) -> str:
    return scratch(spark, "warc")
