"""Roll-ups: citations, findings, audit, connections, retention, threads, lint of links, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

SEVERITIES = ("blocker", "major", "nit")


def citations(hits: DataFrame, most: int) -> DataFrame:
    """For each document: hits, the first URL, whether any came by graph; `more`: how many documents aren't shown."""
    by = hits.groupBy("source_id", "path").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.min_by("url", F.when(F.col("url").isNotNull(), F.col("rank"))).alias("url"), F.max(F.col("via") == "graph").alias("graph"))
    total = by.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return by.orderBy("first").limit(most).crossJoin(total).drop("first")


#: Characters of a finding's texts (fixed values).
FINDING_LENGTHS = {"title": 200, "detail": 1500, "where": 200, "suggestion": 1000}


def clean_findings(found: DataFrame) -> DataFrame:
    """Known severities, lower-cased and trimmed; title, detail, where and suggestion cleaned and cut, those that there are."""
    s = F.lower(F.trim("severity"))
    return found.withColumn("severity", s).where(s.isin(*SEVERITIES)).withColumns({c: text.clean(F.col(f"`{c}`"), most) for c, most in FINDING_LENGTHS.items() if c in found.columns})


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c)


def by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("lens").alias("lenses"))


def merge_findings(findings: DataFrame, merges: DataFrame) -> DataFrame:
    """Findings (id, severity, lens, where) joined as merges (merge_id, ids) say; each id counts once, in its first merge.

    A merged finding has the worst severity and all lenses; a merge without any known finding goes, a finding in no merge stays.
    """
    used = merges.select("merge_id", F.explode("ids").alias("id")).groupBy("id").agg(F.min("merge_id").alias("merge_id"))
    own = findings.join(used, "id", "left").withColumn("group", F.coalesce(F.concat(F.lit("m"), "merge_id"), F.concat(F.lit("f"), "id")))
    return own.groupBy("group").agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.sort_array(F.collect_set("lens")).alias("lenses"), F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("id", "where"))), lambda x: x["where"])), "; ").alias("where"), F.count("*").alias("findings"))


def connection_problem(today: Column, days: int = 14) -> Column:
    """Why a connection (blocked, configured, expires_at, status, verified_at) is to be removed, or null."""
    verified = F.try_to_timestamp("verified_at").cast("date")
    return (
        F.when(F.col("blocked"), "blocked").when(~F.col("configured"), "not_configured")
        .when(F.to_date("expires_at") < today, "expired")
        .when((F.col("status") != "ok") & (verified.isNull() | (verified < F.date_sub(today, days))), "rejected")
    )


def purge(rows: DataFrame, activity: DataFrame, key: str, before: Column, at: str = "ts") -> DataFrame:
    """Rows whose key was active at or after `before`."""
    return rows.join(activity.groupBy(key).agg(F.max(at).alias("__last")).where(F.col("__last") < before).select(key), key, "left_anti")


def threads(turns: DataFrame, title: Column, scanned: int = 60, shown: int = 30) -> DataFrame:
    """The newest threads with a title, from their first user turn: the newest `scanned` are looked at, `shown` come."""
    t = turns.groupBy("conv_id").agg(F.max("turn").alias("turns"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first"))
    newest = t.orderBy(F.desc("conv_id")).limit(scanned).withColumn("first", F.coalesce("first", F.lit("")))
    return newest.withColumn("title", title).where("title <> ''").orderBy(F.desc("conv_id")).limit(shown).drop("first")


def broken_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, target) of links to documents that aren't there."""
    return links.join(documents.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target").distinct()


def uncovered(requirements: DataFrame, components: DataFrame) -> DataFrame:
    """Requirements that no component's `satisfies` names."""
    return requirements.join(components.select(F.explode("satisfies").alias("requirement")).distinct(), "requirement", "left_anti")


def drift(components: DataFrame, changed: DataFrame) -> DataFrame:
    """(component, files): components (component, code_path, concept_path) with changed files below code_path and an unchanged concept file."""
    # A code path is a beginning of a changed path: an equal join over beginnings of the lengths that code paths have.
    lengths = [r[0] for r in components.select(F.length("code_path")).distinct().collect()]
    begins = changed.select("path", F.explode(F.array_distinct(F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.when(F.length("path") >= n, F.left(F.col("path"), n))), lambda x: x.isNotNull()))).alias("code_path"))
    hit = begins.join(components, "code_path").groupBy("component", "concept_path").agg(F.count("*").alias("files"))
    return hit.join(changed.select(F.col("path").alias("concept_path")), "concept_path", "left_anti").select("component", "files")


def call_outcomes(calls: DataFrame) -> DataFrame:
    """(call_id, outcome): the first that holds of unauthenticated, deny, rate_limited, error, tool_error, ok."""
    o = F.when(F.col("oid").isNull(), "unauthenticated").when(F.col("decision") != "allow", "deny").when(~F.col("within_rate"), "rate_limited").when(F.col("failed"), "error").when(F.col("tool_failed"), "tool_error").otherwise("ok")
    return calls.select("call_id", o.alias("outcome"))


def calls_in_window(calls: DataFrame, seconds: int, user: str = "user_id", at_us: str = "us") -> DataFrame:
    """Calls with how many that user made in the window that ends with each (its start is left out)."""
    w = Window.partitionBy(user).orderBy(at_us).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("recent", F.count("*").over(w))


def report_sections(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """(review_id, severity, section): a Markdown section for each severity of each review, its findings numbered by id.

    findings: (review_id, id, severity, title, lenses array, where, detail, suggestion); empty parts have no line. A review holds some dozens of findings.
    """
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"\n- {label}: "), F.col(c))).otherwise("")
    body = F.concat(F.coalesce("title", F.lit("")), F.lit("** ("), F.array_join("lenses", ", "), F.lit(")"), part("Where", "where"), part("Why", "detail"), part("Fix", "suggestion"))
    items = findings.select("review_id", "severity", "id", body.alias("body")).groupBy("review_id", "severity").agg(F.sort_array(F.collect_list(F.struct("id", "body"))).alias("items"))
    every = reviews.select("review_id").distinct().withColumn("severity", F.explode(F.array(*[F.lit(s) for s in SEVERITIES])))
    row = every.join(items, ["review_id", "severity"], "left")
    letter, n = F.upper(F.left("severity", F.lit(1))), F.coalesce(F.size("items"), F.lit(0))
    numbered = F.array_join(F.transform("items", lambda x, i: F.concat(F.lit("\n\n**"), letter, (i + 1).cast("string"), F.lit(". "), x["body"])), "")
    head = F.concat(F.lit("## "), F.initcap("severity"), F.lit(" ("), n.cast("string"), F.lit(")"))
    return row.select("review_id", "severity", F.concat(head, F.coalesce(numbered, F.lit("\nNone."))).alias("section"))
