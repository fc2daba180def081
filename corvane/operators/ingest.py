"""Ingest: what changed, what goes, replacing documents with all that hangs on them, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGED, METADATA, UNCHANGED, RESTRICTED, DELETED = "changed", "metadata", "unchanged", "restricted", "deleted"


def classify_file(content: Column, length: Column) -> Column:
    """pdf, text, or null for what isn't read."""
    head = F.substring(content, 1, 4096)
    pdf = F.regexp_replace(F.substring(content, 1, 1024).cast("string"), r"^[\x09-\x0D\x20]+", "").startswith("%PDF-") & (length <= 200 << 20)
    text = (length <= 1_000_000) & ~F.contains(head.cast("string"), F.lit("\0")) & F.is_valid_utf8(content.cast("string"))
    return F.when(pdf, "pdf").when(text, "text")


def changes(items: DataFrame, stored: DataFrame, listing_complete: bool | str = True, force: bool = False, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, action, known) for every item and every stored document.

    items: (keys, content_hash, title, url, restricted); stored: (keys, content_hash, title, url). Restricted items are
    never written, and their stored copies go. After a listing that failed nothing is deleted; `listing_complete` may name a column of
    `stored` that says so for each document.
    """
    goes = F.lit(listing_complete) if isinstance(listing_complete, bool) else F.coalesce(F.col(listing_complete), F.lit(False))
    old = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("content_hash", "title", "url")], F.lit(True).alias("known"), goes.alias("goes"))
    joined = items.withColumn("listed", F.lit(True)).join(old, list(keys), "full_outer")
    same = F.col("content_hash").eqNullSafe(F.col("old_content_hash")) & F.col("known")
    action = (
        F.when(F.col("listed").isNull(), F.when(F.col("goes"), DELETED).otherwise(UNCHANGED))
        .when(F.col("restricted"), RESTRICTED)
        .when(F.lit(force) | ~F.coalesce(same, F.lit(False)), CHANGED)
        .when(~(F.col("title").eqNullSafe(F.col("old_title")) & F.col("url").eqNullSafe(F.col("old_url"))), METADATA)
        .otherwise(UNCHANGED)
    )
    return joined.select(*keys, action.alias("action"), F.coalesce("known", F.lit(False)).alias("known"))


def counters(actions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of `by`: how many of each action; a restricted item that was stored counts as deleted too."""
    n = lambda c, name: F.count_if(c).alias(name)
    a = F.col("action")
    return actions.groupBy(*by).agg(n(a == CHANGED, "changed"), n(a == METADATA, "metadata"), n(a == UNCHANGED, "unchanged"), n(a == RESTRICTED, "restricted"), n((a == DELETED) | ((a == RESTRICTED) & F.col("known")), "deleted"))


def replace_documents(table: DataFrame, gone: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`table` without the rows of `gone` (by keys), with the rows of `new`: one snapshot to the next."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def restamp(rows: DataFrame, ranks: DataFrame, source: str = "source_id", rank: str = "classification_rank") -> DataFrame:
    """Ranks as the sources (source_id, new_rank) have them now; a source that isn't there is removed with its rows."""
    now = ranks.select(F.col("source_id").alias(source), "new_rank")
    return rows.join(now, source).withColumn(rank, F.col("new_rank")).drop("new_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New values where there are any, else the old ones."""
    o = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in columns])
    n = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__has"))
    return o.join(n, keys, "full_outer").select(*keys, *[F.when(F.col("__has"), F.col(f"__new_{c}")).otherwise(F.col(f"__old_{c}")).alias(c) for c in columns])


def save_cursor(cursors: DataFrame, source_id: str, cursor: str | None, errors: int) -> DataFrame:
    """The cursor table after a run: kept as it is if the run had errors, removed by a null cursor."""
    if errors:
        return cursors
    rest = cursors.where(F.col("source_id") != source_id)
    return rest if cursor is None else rest.unionByName(cursors.sparkSession.createDataFrame([(source_id, cursor)], "source_id string, cursor string"))


def hash_embedding(docs: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """Sparse (key, idx, weight): counts of hashed tokens, divided by their length."""
    tokens = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    index = (F.conv(F.left(F.sha2("token", 256), F.lit(8)), 16, 10).cast("long") % dimensions).cast("int")
    counts = tokens.groupBy(key, index.alias("idx")).agg(F.count("*").alias("tf"))
    length = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key)))
    return counts.select(key, "idx", "tf", (F.col("tf") / length).alias("weight"))


def vocabulary_mentions(chunks: DataFrame, names: dict[str, str], key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(chunk, name, type) for each name of a small vocabulary that stands in the text as a word of its own."""
    import re

    found = [F.when(F.col(text).rlike(rf"(?i)(?<![A-Za-z0-9_-]){re.escape(n)}(?![A-Za-z0-9_-])"), F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"))) for n, t in sorted(names.items())]
    return chunks.select(key, F.explode(F.array_compact(F.array(*found))).alias("e")).select(key, "e.*")
