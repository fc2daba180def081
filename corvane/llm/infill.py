r"""Fill-in-the-middle by lookaround splitting: a grammar of units becomes one zero-width regex of boundaries, at which Spark's split cuts.

A grammar lists classes of characters and how each closes a unit: a `run` closes where a character that isn't of the class
follows, a `single` after each of its characters; characters of no listed class never close one. `boundary` translates it, class by class,
to alternatives that look at the two neighbours of a place: `(?<=[c])(?=[^c])` and `(?<=[c])(?=.)`. No character is matched, so the pieces of the split are
the text. A split makes one empty piece of an empty text, which is handled apart: it has no units.

The text of a document is cut at two places, drawn from a hash of its key, and written as prefix, suffix, middle or as suffix, prefix, middle; `restore` rebuilds
it from output and form alone. All expressions are Spark's own; there is no shuffle, and a row needs some 24 bytes for each unit of its text.

Defined results: a null text is empty, and empty texts are plain; so is one that contains a mark; a null key is hashed as an empty one; repeated rows are
cut alike; an empty table gives an empty result; columns named like a new one are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Grammars of units: (characters of a class as in brackets of a regex, how it closes).
WORDS = (("A-Za-z", "run"), ("^A-Za-z", "single"))
CHARACTERS = ((r"\x{0}-\x{10FFFF}", "single"),)
LINES = ((r"\n", "single"),)
#: Of 100: how many documents are cut, and how many of these have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


def boundary(grammar: tuple[tuple[str, str], ...]) -> str:
    """A regex that matches the empty place between two units."""

    def after(chars: str, closes: str) -> str:
        if closes not in ("run", "single"):
            raise ValueError(f"a class closes as a run or as a single, not as {closes!r}")
        other = chars[1:] if chars[0] == "^" else f"^{chars}"
        return f"(?<=[{chars}])(?=[{other}])" if closes == "run" else f"(?<=[{chars}])(?=.)"

    return "(?s)" + "|".join(after(*c) for c in grammar)


def units(text: Column, grammar: tuple[tuple[str, str], ...] = WORDS) -> Column:
    """Array of the units of a text, which joined are the text; none for an empty or null one."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, boundary(grammar), -1))


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers: the first groups of 8 digits of the SHA-256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def restore(output: Column, form: Column) -> Column:
    """The text again, from what was written and its form. A cut text contains no mark, so that each mark is found where it was put."""
    body, (p, s, m) = F.substr(output, F.lit(len(MARKS[0]) + 1)), MARKS
    head, middle = F.substring_index(body, m, 1), F.substring_index(body, m, -1)
    sides = lambda mark: (F.substring_index(head, mark, 1), F.substring_index(head, mark, -1))
    (prefix, suffix), (suffix_first, prefix_last) = sides(s), sides(p)
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_last, middle, suffix_first))


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", grammar: tuple[tuple[str, str], ...] = WORDS, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """`docs` with n (units), form, output, and prefix_chars and middle_chars (code points; null where the form is plain)."""
    kept = docs.drop("n", "form", "output", "prefix_chars", "middle_chars")
    whole, own, low, high, prefix, middle, suffix = free(kept, "whole", "units", "low", "high", "prefix", "middle", "suffix")
    h = draws(F.col(f"`{key}`"), seed)
    p, s, m = map(F.lit, MARKS)
    marked = reduce(or_, (F.contains(F.col(whole), mark) for mark in (p, s, m)))
    cuttable = (F.col(whole) != "") & ~marked & (h[2] % 100 < cut)
    piece = lambda a, z: F.array_join(F.slice(own, F.col(a) + 1 if a else F.lit(1), F.col(z) - F.col(a) if a else F.col(z)), "")
    found = kept.withColumn(whole, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).withColumn(own, units(F.col(whole), grammar)).withColumn("n", F.size(own).cast("long"))
    found = found.withColumns({"form": F.when(~cuttable, PLAIN).when(h[3] % 100 < suffix_first, SPM).otherwise(PSM), low: F.least(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)).cast("int"), high: F.greatest(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)).cast("int")})
    found = found.withColumns({prefix: piece(None, low), middle: piece(low, high)})
    # What is left of the text is the suffix: it needs no third join of units.
    found = found.withColumn(suffix, F.substr(F.col(whole), F.char_length(prefix) + F.char_length(middle) + 1))
    output = F.when(F.col("form") == PLAIN, F.col(whole)).when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    length = lambda c: F.when(F.col("form") != PLAIN, F.char_length(c).cast("long"))
    return found.withColumns({"output": output, "prefix_chars": length(prefix), "middle_chars": length(middle)}).drop(whole, own, low, high, prefix, middle, suffix)
