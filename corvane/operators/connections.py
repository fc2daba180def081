"""Users' connections to providers: their status, whether they can be used, and whether a stored entry is its owner's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import user_key

WARNING_DAYS = 14


def expiring_soon(expires: Column, today: Column, days: int = WARNING_DAYS) -> Column:
    """Whether a day is today or within so many days; false for none."""
    return F.coalesce(expires.between(today, F.date_add(today, days)), F.lit(False))


def status(users: DataFrame, catalog: DataFrame, entries: DataFrame, today: Column) -> DataFrame:
    """(oid, connection_id, connected, expires_at, expired, expiring_soon) for every connection of the catalog and every user.

    users: (oid); catalog: (connection_id), what is configured, some dozens; entries: (oid, connection_id, expires_at date). Both flags are null where
    the user has no entry; an entry without a last day never expires.
    """
    every = users.select("oid").distinct().crossJoin(catalog.select("connection_id"))
    own = every.join(entries.select("oid", "connection_id", "expires_at", F.lit(True).alias("has")), ["oid", "connection_id"], "left")
    e, has = F.col("expires_at"), F.col("has").isNotNull()
    return own.select("oid", "connection_id", has.alias("connected"), "expires_at", F.when(has, F.coalesce(e < today, F.lit(False))).alias("expired"), F.when(has, expiring_soon(e, today)).alias("expiring_soon"))


def eligibility(requests: DataFrame, catalog: DataFrame, entries: DataFrame, today: Column) -> DataFrame:
    """(request_id, outcome) of requests (request_id, oid, connection_id): not configured, not connected, rejected, expired or ok, the first that holds."""
    row = requests.join(catalog.select("connection_id", F.lit(True).alias("configured")), "connection_id", "left").join(entries.select("oid", "connection_id", "status", "expires_at"), ["oid", "connection_id"], "left")
    outcome = F.when(F.col("configured").isNull(), "not configured").when(F.col("status").isNull(), "not connected").when(F.col("status") != "ok", "rejected").when(F.col("expires_at") < today, "expired").otherwise("ok")
    return row.select("request_id", outcome.alias("outcome"))


def readable_entries(stored: DataFrame, schema_version: int = 1) -> DataFrame:
    """`stored` (key, oid, schema) with problem: an entry whose key isn't its owner's, or of another schema, is kept, reported and not used."""
    return stored.withColumn("problem", F.when(~F.col("schema").eqNullSafe(F.lit(schema_version)), "schema").when(~user_key(F.col("oid")).eqNullSafe(F.col("key")), "owner"))


def written(entries: DataFrame, writes: DataFrame) -> DataFrame:
    """`entries` (oid, connection_id, status, ...) after writes (oid, connection_id, action).

    `forget` drops all entries of the user, whatever the connection; `disconnect` drops one; `invalid` sets its status. The strongest
    holds where one entry has several. Writes without an entry change nothing.
    """
    gone = writes.where("action = 'forget'").select("oid").distinct()
    own = writes.where("action <> 'forget'").groupBy("oid", "connection_id").agg(F.bool_or(F.col("action") == "disconnect").alias("__off"), F.bool_or(F.col("action") == "invalid").alias("__bad"))
    kept = entries.join(gone, "oid", "left_anti").join(own, ["oid", "connection_id"], "left").where(~F.coalesce("__off", F.lit(False)))
    return kept.withColumn("status", F.when(F.col("__bad"), "invalid").otherwise(F.col("status"))).select(*entries.columns)
