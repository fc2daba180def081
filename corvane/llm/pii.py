"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Column functions only; each document is searched in its own row, so nothing is shuffled. Places are
code points, the end exclusive. Patterns use possessive repeats and begin only where a run begins, so
that a long text costs time in proportion to its length and no deep stack; places are added up and contexts cut
in pieces, so that a text with very many spans doesn't cost its length for each.

Defined results: a null text has no spans; empty tables give an empty result; repeated rows are
searched alike; other columns of the input are kept, those named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, running

#: Code points before and after a span in which context words count.
BEFORE, AFTER = 48, 24
#: A span of a kind that isn't a base kind is kept from this score on.
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    """pattern: Java pattern; needs: a text without this string has no match; check: of the matched string;
    score: before context; context: lower-case words that add 0.3; base: kept at any score."""

    name: str
    pattern: str
    needs: str | None
    check: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(F.ascii(c) > 52, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (letters upper case, spaces removed) leaves 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97) == 1


def _ip(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))


def _between(x: Column, low: int, high: int) -> Column:
    return (F.length(x) >= low) & (F.length(x) <= high)


#: The kinds, in the order in which results list them.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda x: F.lit(True), 0.7, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _ip, 0.5, r"\bip\b|host|server|address|serveur|servidor|adresse"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+", None, lambda x: _between(_digits(x), 16, 19) & luhn(_digits(x)), 0.7, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda x: _between(_digits(x), 8, 15), 0.6, r"phone|\btel|call|fax|mobil|anruf|appel|llam"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, lambda x: _between(F.translate(x, " ", ""), 15, 34) & mod97(F.translate(x, " ", "")), 0.8, "iban|account|konto|compte|cuenta|bank", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda x: ~x.rlike("^(?:000|666|9)|-00-|-0000$"), 0.4, r"\bssn\b|social|security|tax", base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)


#: Code points in a piece of text; what is near a place is looked for in the pieces round it, not from the start of the text.
PIECE = 512


def _pieces(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end (code points, the end exclusive), from its pieces."""
    first = F.floor(start / PIECE).cast("int")
    few = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
    return F.substr(F.array_join(few, ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def _hits(text: str, kind: Kind) -> Column:
    """Array of {gap, hit}: what the pattern finds, and the length of what lies before it; null where there is nothing."""
    t = F.col(f"`{text}`")
    some = F.contains(t, F.lit(kind.needs)) if kind.needs else t.rlike("[0-9]")
    pieces = F.zip_with(F.split(t, kind.pattern, -1), F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    # The last piece has no match after it.
    return F.when(some & t.rlike(kind.pattern), F.filter(pieces, lambda x: x["hit"].isNotNull()))


def _places(hits: str) -> Column:
    """Array of {start, end, hit} from a column of _hits()."""
    placed = running(F.col(hits), F.lit(0), lambda at, x: at + x["gap"] + F.length(x["hit"]))
    return F.transform(placed, lambda p: F.struct((p["before"] + p["item"]["gap"]).alias("start"), (p["before"] + p["item"]["gap"] + F.length(p["item"]["hit"])).alias("end"), p["item"]["hit"].alias("hit")))


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text: str = "text") -> DataFrame:
    """`docs` with pii: array of {kind, start, end, score}, by kind as listed, then start."""
    t, c, *m = free(docs, "__text", "__pieces", *[f"__{k.name}" for k in kinds])
    raw = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    raw = raw.withColumns({n: _hits(t, k) for n, k in zip(m, kinds)})
    raw = raw.withColumns({n: F.when(F.col(n).isNotNull(), _places(n)) for n in m})
    raw = raw.withColumn(c, F.when(F.coalesce(*m).isNotNull(), _pieces(F.col(t))))

    def scored(k: Kind, name: str) -> Column:
        before = lambda x: _cut(F.col(c), F.greatest(x["start"] - BEFORE, F.lit(0)), x["start"])
        near = lambda x: F.concat(before(x), F.lit(" "), _cut(F.col(c), x["end"], x["end"] + AFTER))
        score = lambda x: F.lit(k.score) + F.when(F.lower(near(x)).rlike(k.context), 0.3).otherwise(0.0)
        kept = F.transform(F.filter(name, lambda x: k.check(x["hit"])), lambda x: F.struct(F.lit(k.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score")))
        kept = kept if k.base else F.filter(kept, lambda x: x["score"] >= THRESHOLD)
        return F.coalesce(kept, F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))

    return raw.withColumn("pii", F.concat(*[scored(k, n) for k, n in zip(kinds, m)])).drop(t, c, *m)


def join_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text: str = "text") -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in brackets; of overlapping spans the first counts.

    A null text stays null.
    """
    own, s, c = free(docs, "__pii", "__spans", "__pieces")
    found = find(docs, kinds, text) if "pii" not in docs.columns else find(docs.withColumnRenamed("pii", own), kinds, text)
    t, empty = F.col(f"`{text}`"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("shown"))
    spans = F.sort_array(F.transform("pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    # The furthest end so far, and the end of the last span that counts: a span that begins before the first is skipped.
    further = lambda at, x: F.struct(F.greatest(at["end"], x["end"]).alias("end"), F.when(x["start"] < at["end"], F.greatest(at["end"], x["end"])).otherwise(x["end"]).alias("shown"))
    placed = found.withColumn(s, spans).withColumn(s, F.when(F.size("pii") > 0, running(F.col(s), empty, further))).withColumn(c, F.when(F.col(s).isNotNull(), _pieces(t)))
    mark = lambda p: F.concat(_cut(F.col(c), p["before"]["shown"], p["item"]["start"]), F.lit("["), F.upper(p["item"]["kind"]), F.lit("]"))
    kept = F.filter(s, lambda p: p["item"]["start"] >= p["before"]["end"])
    last = F.array_max(F.transform("pii", lambda x: x["end"]))
    whole = F.concat(F.array_join(F.transform(kept, mark), ""), _cut(F.col(c), last, F.length(t)))
    done = placed.withColumn(text, F.when(F.col(s).isNotNull(), whole).otherwise(t)).drop(s, c, "pii")
    return (done if "pii" not in docs.columns else done.withColumnRenamed(own, "pii")).select(docs.columns)
