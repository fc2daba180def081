"""Audit records: what is said of each event, as JSON lines, and lists of what a caller saw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Fields that each kind of event records, besides event and who (fixed values).
FIELDS = {"tools_list": ("visible", "hidden"), "skills_list": ("visible", "hidden"), "skill_access": ("skill", "outcome", "rule"), "artifact_save": ("artifact_id", "outcome"), "artifact_read": ("artifact_id", "outcome"), "connection": ("connection_id", "outcome")}


def seen_lists(seen: DataFrame) -> DataFrame:
    """(call_id, visible, hidden) of (call_id, name, allowed): the names shown, sorted, and how many weren't."""
    return seen.groupBy("call_id").agg(F.sort_array(F.collect_set(F.when(F.col("allowed"), F.col("name")))).alias("visible"), F.count_if(~F.col("allowed")).alias("hidden"))


def record(kind: str, who: Column) -> Column:
    """A compact JSON object of an event: event, who, and the fields of its kind that aren't null, from columns of these names."""
    return F.to_json(F.struct(F.lit(kind).alias("event"), who.alias("who"), *FIELDS[kind]))


def append(records: DataFrame, path: str) -> None:
    """Add records (one string column) to the audit files under `path`, a line each."""
    records.write.mode("append").text(path)


#: What a token may claim, as far as it is looked at.
CLAIMS = "oid string, tid string, iss string, aud string, scp string, exp double"


def auth_failure(header: Column, now: Column, blocked: Sequence[str], tenant: str, issuer: str, audiences: Sequence[str], scopes: Sequence[str]) -> Column:
    """Why a caller wasn't let in, by the first reason that holds. Claims aren't verified: a token that claims all that is wanted was rejected for what it is.

    `now`: seconds since 1970. No header is no token; another scheme than bearer, or claims that can't be read, are a malformed one.
    """
    scheme, token = F.split_part(header, F.lit(" "), F.lit(1)), F.regexp_extract(header, "(?s)^[^ ]* (.*)$", 1)
    claims = F.when(F.size(F.split(token, r"\.", -1)) == 3, text.jwt_claims(token, CLAIMS))
    one_of = lambda c, names: F.coalesce(c.isin(list(names)), F.lit(False)) if names else F.lit(False)
    lacks = F.size(F.array_except(F.array(*[F.lit(s) for s in scopes]).cast("array<string>"), F.split(F.coalesce(claims["scp"], F.lit("")), r"\s+"))) > 0
    return (
        F.when(F.coalesce(header, F.lit("")) == "", "missing_token")
        .when((F.lower(scheme) != "bearer") | (token == "") | claims.isNull(), "malformed_token")
        .when(one_of(F.lower(claims["oid"]), blocked), "blocked")
        .when(F.coalesce(claims["exp"] < now, F.lit(False)), "expired")
        .when(~claims["tid"].eqNullSafe(F.lit(tenant)), "wrong_tenant")
        .when(~claims["iss"].eqNullSafe(F.lit(issuer)), "wrong_issuer")
        .when(~one_of(claims["aud"], audiences), "wrong_audience")
        .when(lacks, "missing_scope")
        .otherwise("invalid_token")
    )
