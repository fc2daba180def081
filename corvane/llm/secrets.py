"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived that every match must meet.
Texts are indexed some at a time: for each trigram the texts that have it. A rule's query intersects and
unites these postings, and only texts that are left are searched by the rule. A rule without
mandatory trigrams searches every text. The index sees lower-case ASCII, so case never loses a match.

Defined results: a null or empty text has no spans; repeated rows are searched alike; columns named
like a new one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns


@dataclass(frozen=True)
class Rule:
    """group, least: the match counts if this group has so many characters; tail: and if this group has any.

    Patterns know ASCII classes only. A pattern whose beginning fits at every place of a long run takes the run whole and
    leaves its tail empty where nothing follows, so that the run is read once."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True
    tail: int = 0


#: The rules, in the order in which spans at one place are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, False),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39, False),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]++(\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++|)", 0, 30, False, 1),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
)
#: Strings that one place of a pattern may stand for before they are given up as an exact set.
MOST_STRINGS = 64
#: Bytes of text that are indexed at once.
PIECE_BYTES = 1 << 20

# A query is True (every text), a string of three characters, or ("and" | "or", queries).


def _all(kind: str, parts: list) -> object:
    """A query of queries; True is neutral in "and" and wins in "or"."""
    parts = list(dict.fromkeys(parts))
    if kind == "or" and (True in parts or not parts):
        return True
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _strings(found: set[str]) -> object:
    """What texts have that hold one of these strings."""
    return _all("or", [_all("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(found)])


def _derive(nodes) -> tuple[set[str] | None, object]:
    """All strings that a parsed pattern can match, lower-cased, if they are few; and its query."""
    run, whole, parts = {""}, True, []
    for op, value in nodes:
        strings, query = _place(str(op), value)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        parts.append(_strings(run))
        whole = False
        run = strings if strings is not None else {""}
        if strings is None:
            parts.append(query)
    parts.append(_strings(run))
    return (run if whole else None), _all("and", parts)


def _place(op: str, value) -> tuple[set[str] | None, object]:
    if op == "LITERAL":
        return {chr(value).lower() if value < 128 else chr(value)}, True
    if op == "SUBPATTERN":
        return _derive(value[-1])
    if op == "BRANCH":
        found = [_derive(b) for b in value[1]]
        some = set().union(*(s for s, _ in found if s is not None))
        if all(s is not None for s, _ in found) and len(some) <= MOST_STRINGS:
            return some, True
        return None, _all("or", [q if s is None else _strings(s) for s, q in found])
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = value
        strings, query = _derive(body)
        if strings is not None and low == 0 and int(high) == 1:
            return strings | {""}, True
        if strings is not None and low == int(high) and len(strings) ** low <= MOST_STRINGS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, True
        return None, True if low == 0 else query if strings is None else _strings(strings)
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in value):
        return {chr(v).lower() for _, v in value}, True
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, True
    return None, True


def trigram_query(pattern: str) -> object:
    """The trigrams that every text with a match of `pattern` has, as a Boolean query."""
    from re import _parser  # the standard library's own parse of a pattern

    return _derive(_parser.parse(pattern, re.ASCII))[1]


class Index:
    """Postings of all trigrams of some texts."""

    def __init__(self, texts: list[bytes]):
        self.all = np.arange(len(texts))
        found, some, size = [], [], 0
        for i, t in enumerate(texts):
            # Pieces of a long text overlap by two bytes, so that no trigram is lost between them.
            for at in range(0, max(len(t) - 2, 0), PIECE_BYTES):
                some.append((i, t[at : at + PIECE_BYTES + 2]))
                size += len(some[-1][1])
                if size >= PIECE_BYTES:
                    found.append(self._keys(some))
                    some, size = [], 0
        found += [self._keys(some)] if some else []
        self.keys = found[0] if len(found) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))

    @staticmethod
    def _keys(pieces: list[tuple[int, bytes]]) -> np.ndarray:
        """Trigram and text of all trigrams of these pieces, ascending, each once; takes about 33 bytes for each of their bytes."""
        b = np.frombuffer(b"".join(p for _, p in pieces), np.uint8).astype(np.uint32)
        sizes = np.fromiter((len(p) for _, p in pieces), np.int64, len(pieces))
        piece = np.repeat(np.arange(len(pieces)), sizes)
        text = np.fromiter((i for i, _ in pieces), np.uint64, len(pieces))
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        own = piece[:-2] == piece[2:]
        keys = np.sort((code[own].astype(np.uint64) << np.uint64(32)) | text[piece[:-2][own]])
        return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys

    def postings(self, trigram: str) -> np.ndarray:
        raw = trigram.encode()
        # Of a trigram with longer characters, its first three bytes are looked for.
        first = int.from_bytes(raw[:3], "big") << 32
        low, high = np.searchsorted(self.keys, np.array([first, first + (1 << 32)], np.uint64))
        return (self.keys[low:high] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def find(self, query: object) -> np.ndarray:
        if query is True:
            return self.all
        if isinstance(query, str):
            return self.postings(query)
        kind, parts = query
        got = self.find(parts[0])
        for p in parts[1:]:
            if kind == "and" and not len(got):
                break
            got = np.intersect1d(got, self.find(p)) if kind == "and" else np.union1d(got, self.find(p))
        return got


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def searcher(rules: tuple[Rule, ...] = RULES) -> Callable[[list[str | None]], list[list[list[tuple]]]]:
    ready = [(k, r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for k, r in enumerate(rules)]

    def work(texts: list[str | None]) -> list[list[list[tuple]]]:
        found: list[list[tuple]] = [[] for _ in texts]
        index = Index([(t or "").encode().lower() for t in texts])
        for k, r, pattern, query in ready:
            for i in index.find(query).tolist():
                for m in pattern.finditer(texts[i] or ""):
                    if m.end(r.group) - m.start(r.group) >= r.least and m.end(r.tail) > m.start(r.tail):
                        found[i].append((m.start(), k, m.end()))
        return [[[(rules[k].name, a, z) for a, k, z in sorted(f)] for f in found]]

    return work


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with secrets: array of {kind, start, end} by start, then kind as listed; places are code points, the end exclusive."""
    return add_columns(docs, [text], [T.StructField("secrets", SPAN)], lambda: searcher(rules), drop=drop)


def mask(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in brackets; of overlapping spans the first counts."""

    def make():
        search = searcher(rules)

        def work(texts):
            out = []
            for t, spans in zip(texts, search(texts)[0]):
                parts, at = [], 0
                for kind, a, z in spans:
                    if a >= at:
                        parts += [t[at:a], f"[{kind.upper()}]"]
                    at = max(at, z)
                out.append("".join(parts) + t[at:] if spans else t)
            return [out]

        return work

    return add_columns(docs, [text], [T.StructField(text, T.StringType())], make).select(docs.columns)


def join_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
