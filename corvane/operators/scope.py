"""Row policy: what a caller may read. Applied to every base table before anything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(rows: DataFrame, policy: DataFrame, source: str = "source_id", rank: str = "classification_rank") -> DataFrame:
    """Rows whose source the policy (source_id, ceiling) names and whose rank is at most its ceiling.

    Fails closed: an empty policy, an unknown source, or a null rank or ceiling gives no rows.
    """
    p = policy.select(F.col("source_id").alias("__source"), F.col("ceiling").alias("__ceiling"))
    return rows.join(p, (F.col(source) == F.col("__source")) & (F.col(rank) <= F.col("__ceiling")), "left_semi")


def owned(rows: DataFrame, oid: str) -> DataFrame:
    """Rows of one owner; an id that isn't one is an error, not an empty result."""
    import re

    if not re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", oid.lower()):
        raise ValueError("not an owner id")
    return rows.where(F.col("owner_oid") == oid.lower())


def live(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.where(F.col("expires_at") > as_of)
