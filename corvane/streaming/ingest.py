"""Ingest as a stream: each batch of what loaders found becomes one state of the store, together with the batch's number and the cursors of its sources.

A batch that is run again, since the driver stopped before the stream took note of it, changes nothing: its number is in the state that it made. A
source whose listing failed is neither written nor deleted, and keeps its cursor; the others of the batch go on. A source's listing is
whole in one batch if its `end` is there: only then do stored documents go that it doesn't name.

Defined results: rows without a source, or items and listed paths without a path, are ignored; of items with one source and path the one with the greatest
(content_hash, title, url, text) counts; a null text has no chunks but is stored, so that it isn't read again; an unknown kind is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import chunking
from ..operators import ingest, store
from ..session import materialize

#: What a batch holds. kind: item (read), listed (there, but not read again), end (the listing is whole, with the next cursor) or error (it failed).
FOUND = "source_id string, kind string, path string, content_hash string, media_type string, title string, url string, restricted boolean, text string, cursor string"
SCHEMAS = {
    store.DOCUMENTS: "document_id string, source_id string, path string, content_hash string, media_type string, title string, url string",
    store.CHUNKS: "chunk_id string, document_id string, source_id string, ordinal int, start_line int, end_line int, heading string, content string",
    store.ENTITIES: "entity_id string, source_id string, key string",
    store.MENTIONS: "entity_id string, chunk_id string, source_id string",
    store.EDGES: "src_id string, dst_id string, relation string, chunk_id string, source_id string",
}
KEYS = ("source_id", "path")


def cursor_of(spark: SparkSession, root: str, source_id: str) -> str | None:
    return store.marks(spark, root).get(f"cursor {source_id}")


def _plan(batch: DataFrame, stored: DataFrame, force: bool) -> tuple[DataFrame, DataFrame]:
    """(items, actions) of the sources in `batch`: one item for each source and path, one action for each item and each stored document."""
    latest = F.max(F.struct("content_hash", "title", "url", "text", "media_type", F.coalesce("restricted", F.lit(False)).alias("restricted"))).alias("i")
    items = materialize(batch.where("kind = 'item' AND path IS NOT NULL").groupBy(*KEYS).agg(latest).select(*KEYS, "i.*"), "items")
    there = batch.where("kind = 'listed' AND path IS NOT NULL").select(*KEYS, F.lit(True).alias("there")).distinct()
    whole = batch.where("kind = 'end'").select("source_id", F.lit(True).alias("whole")).distinct()
    known = stored.join(there, list(KEYS), "left").join(F.broadcast(whole), "source_id", "left").withColumn("goes", F.col("whole") & F.col("there").isNull())
    return items, materialize(ingest.changes(items, known, "goes", force, KEYS), "actions")


def _tables(held: dict[str, DataFrame], items: DataFrame, actions: DataFrame, most: int, overlap: int) -> dict[str, DataFrame]:
    """The five tables of the sources as they are after the actions."""
    of = lambda *which: actions.where(F.col("action").isin(*which)).select(*KEYS)
    id_ = F.sha2(F.to_json(F.array(*KEYS)), 256)
    own = [x.split()[0] for x in SCHEMAS[store.DOCUMENTS].split(", ")]
    new = items.join(of(ingest.CHANGED), list(KEYS), "left_semi").withColumn("document_id", id_)
    stays = held[store.DOCUMENTS].join(of(ingest.CHANGED, ingest.RESTRICTED, ingest.DELETED), list(KEYS), "left_anti")
    named = items.join(of(ingest.METADATA), list(KEYS), "left_semi").select(*KEYS, F.struct("title", "url").alias("now"))
    renamed = stays.join(named, list(KEYS), "left").withColumns({c: F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(c)) for c in ("title", "url")})
    cut = chunking.chunk(new, "document_id", path="path", media_type="media_type", most=most, overlap=overlap)
    chunks = cut.join(new.select("document_id", "source_id"), "document_id").withColumn("chunk_id", F.concat_ws("-", "document_id", "ordinal", F.sha2("content", 256)))
    old = held[store.CHUNKS].join(stays.select("document_id"), "document_id", "left_semi")
    grown = {
        store.DOCUMENTS: renamed.select(*own).unionByName(new.select(*own)),
        store.CHUNKS: old.select(held[store.CHUNKS].columns).unionByName(chunks.select(held[store.CHUNKS].columns)),
    }
    return store.without_orphans(held | grown)


def apply(spark: SparkSession, root: str, batch: DataFrame, stream: str, number: int, force: bool = False, dry_run: bool = False, most: int = 400, overlap: int = 40) -> DataFrame | None:
    """Bring a batch (FOUND) into the store: counters for each source, or null if the batch was there already.

    force: items are written though their content is the stored one; dry_run: counters only, nothing is written, known batches too.
    """
    marks = store.marks(spark, root)
    if not dry_run and number <= int(marks.get(f"batch {stream}", -1)):
        return None
    # Read once, since the listing may be another the next time.
    rows = materialize(batch.where("source_id IS NOT NULL"), "batch")
    failed = rows.where("kind = 'error'").select("source_id").distinct()
    good = rows.join(F.broadcast(failed), "source_id", "left_anti")
    sources = [r[0] for r in good.select("source_id").distinct().collect()]  # one a source
    items, actions = _plan(good, store.read(spark, root, store.DOCUMENTS, SCHEMAS[store.DOCUMENTS], sources), force)
    counted = ingest.counters(actions, ("source_id",))
    if dry_run:
        return counted
    busy = [r[0] for r in actions.where(F.col("action") != ingest.UNCHANGED).select("source_id").distinct().collect()]
    changing = spark.createDataFrame([(s,) for s in busy], "source_id string")
    held = {t: store.read(spark, root, t, SCHEMAS[t], busy) for t in store.TABLES}
    within = lambda df: df.where(F.col("source_id").isin(busy))
    tables = _tables(held, within(items), within(actions), most, overlap) if busy else {}
    ends = {f"cursor {r.source_id}": r.cursor for r in good.where("kind = 'end'").groupBy("source_id").agg(F.max("cursor").alias("cursor")).collect()}
    store.commit(spark, root, tables, changing, ends | {f"batch {stream}": str(number)})
    return counted


def writer(found: DataFrame, root: str, stream: str, checkpoint: str, force: bool = False) -> DataStreamWriter:
    """Writes a stream of FOUND into the store. A stream with a new checkpoint needs a new name, since its batches are numbered anew."""
    return found.writeStream.queryName(stream).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: apply(batch.sparkSession, root, batch, stream, number, force) and None)
