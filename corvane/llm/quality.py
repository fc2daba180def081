"""Quality rules: a short-circuit cascade whose order is set by rejection per cost, measured on a sample.

Column functions only. Each document is judged from its own row, so nothing is shuffled. The order
of the rules changes the work, never the verdict: a document is kept if no rule rejects it.

Defined results: a null or blank text has no words and fails the base rule; repeated rows are judged
alike; an empty table gives an empty result (and the rules' given order).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BLANKS, free, words

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are measured.
SAMPLE_ROWS = 512


@dataclass(frozen=True)
class Rule:
    """`rejects`: SQL over {text}, lines and the base measures, never null; {text} stands for the text, '' if it is null."""

    name: str
    rejects: str


#: The production rules. Thresholds are ratios of whole numbers, so that any SQL engine agrees.
RULES = (
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("few_letters", r"10 * regexp_count({text}, '(?:\\A|[\\x20\\x09-\\x0D])[^\\p{L}\\x20\\x09-\\x0D]++(?![^\\x20\\x09-\\x0D])') > 2 * n_words"),
    Rule("ellipsis_lines", r"10 * size(filter(lines, x -> trim(TRAILING ' \\t\\r' FROM x) LIKE '%...' OR trim(TRAILING ' \\t\\r' FROM x) LIKE '%…')) > 3 * n_lines"),
    Rule("bullet_lines", r"10 * size(filter(lines, x -> x RLIKE '^[\\x20\\x09-\\x0D]*+[-*•][\\x20\\x09]')) > 9 * n_lines"),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, lines (those with a word), n_lines, n_dup_lines, n_repeat_words, base_failed.

    Three-word windows are compared by a 64-bit hash of their words within one document.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    w, h, s, p = free(docs, "__w", "__h", "__s", "__p")
    a = docs.withColumns({w: words(t), "lines": F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")})
    n = F.size(w)
    b = a.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        h: F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))),
    }).drop(w)
    # Most texts repeat no window: only the others are sorted.
    c = b.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop(h)
    twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    d = c.withColumn(p, F.sort_array(F.transform(twice, lambda x: x["i"]))).drop(s)
    # Windows of 3 words that start at sorted places cover 3 words each, less what the one before covers.
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(p, start, lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).cast("long").alias("n")), lambda acc: acc["n"])
    e = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(p)
    return e.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rejects(rule: Rule, text: str = "text") -> Column:
    return F.expr("(" + rule.rejects.replace("{text}", f"coalesce(`{text}`, '')") + ")")


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, repeats: int = 4, text: str = "text") -> list[tuple[Rule, float, float]]:
    """Rules with (seconds, share rejected) on a sample, the highest rejection per second first.

    The sample is `sample_rows` rows of the table, which Spark takes from as few tasks as have them, and no more come to the
    driver however many tasks the table has; it decides the order only. Each row is judged `repeats` times, so that the
    rule outweighs the cost of starting a job.
    """
    few = docs.sparkSession.createDataFrame(docs.select(F.col(f"`{text}`").cast("string")).limit(sample_rows).toArrow()) if sample_rows else docs.limit(0)
    sample = materialize(measure(few, text), "quality-sample")
    again = sample.withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def timed(check: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            share = again.agg(F.avg(F.when(check, 1.0).otherwise(0.0))).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    idle, _ = timed(F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) < 0)
    found = [(r, max(s - idle, 1e-4), share) for r in rules for s, share in [timed(rejects(r, text))]]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(measured: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """`measured` with rejected_by (the first rule in this order that rejects, else null) and kept.

    CASE stops at the first hit: a later rule isn't evaluated for a row that an earlier one rejects.
    """
    first = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        first = first.when(rejects(r, text), F.lit(r.name))
    return measured.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every row of `docs` with the measures, rejected_by and kept. Columns of these names are replaced."""
    return cascade(measure(docs, text), [r for r, _, _ in order_rules(docs, rules, text=text)], text)
