"""Versioned documents of owners: the latest live version, counts, and what may be saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_DOCUMENTS, MOST_VERSIONS = 50, 10


def latest(rows: DataFrame, document: str = "document_id", version: str = "version") -> DataFrame:
    """The highest version of each document, and how many versions it has."""
    best = rows.groupBy(document).agg(F.max_by(F.struct(*rows.columns), version).alias("r"), F.count("*").alias("versions"))
    return best.select("r.*", "versions")


def live_counts(rows: DataFrame, owner: str, document: str, live: Column) -> DataFrame:
    """Live documents and live versions of each owner."""
    return rows.where(live).groupBy(owner).agg(F.countDistinct(document).alias("documents"), F.count("*").alias("versions"))


def numbered(rows: DataFrame, document: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(document).orderBy(*order)))


def save_outcome(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests: (request_id, owner_oid, document_id or null, base_version); stored: live (owner_oid, document_id, version).

    outcome: created, saved, stale (base isn't the latest), not found, or which limit is reached; next_version.
    """
    docs = stored.groupBy("owner_oid", "document_id").agg(F.max("version").alias("last"), F.count("*").alias("versions"))
    owners = docs.groupBy("owner_oid").agg(F.count("*").alias("documents"))
    r = requests.join(docs, ["owner_oid", "document_id"], "left").join(owners, "owner_oid", "left")
    new = F.col("document_id").isNull()
    outcome = (
        F.when(new & (F.coalesce("documents", F.lit(0)) >= MOST_DOCUMENTS), "too many documents").when(new, "created")
        .when(F.col("last").isNull(), "not found").when(~F.col("base_version").eqNullSafe(F.col("last")), "stale")
        .when(F.col("versions") >= MOST_VERSIONS, "too many versions").otherwise("saved")
    )
    return r.select("request_id", outcome.alias("outcome"), F.when(outcome == "created", 1).when(outcome == "saved", F.col("last") + 1).alias("next_version"))


def number_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content); CRLF counts as LF, and a newline at the end leaves a last empty line."""
    return rows.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)
