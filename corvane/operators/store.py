"""Writes of dependent tables as one: new folders for the sources that change, then a manifest that names the folders of every table and source.

A reader takes the newest finished manifest and reads the folders it names. A write that stops half-way leaves folders that no manifest names, and the old
state stays readable; two writes from one state can't both finish, since the manifest of a number is written once. What a source holds is replaced whole,
other sources aren't touched: the work follows the changed sources, not the store.

Tables have a column source_id, which is not null. A table that a manifest doesn't name is empty; a write of no sources is a new state that
equals the old; repeated rows are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest

DOCUMENTS, CHUNKS, ENTITIES, MENTIONS, EDGES = TABLES = ("documents", "chunks", "entities", "mentions", "edges")
MANIFEST = "table string, source_id string, folder string"
#: Marks stand in the manifest as rows of no table: their name as source_id, their value as folder.
MARKS = ""


def finished(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished states, in order: those whose manifest's writer left its mark."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(int(s.getPath().getParent().getName()) for s in found)


def manifest(spark: SparkSession, root: str, state: int | None = None) -> DataFrame:
    """(table, source_id, folder) of a state, the newest if none is given; a state that isn't there is an error."""
    states = finished(spark, root)
    if state is not None and state not in states:
        raise ValueError(f"no state {state}: there are {states}")
    if not states:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root}/manifests/{states[-1] if state is None else state}")


def read(spark: SparkSession, root: str, table: str, schema: str, sources: Sequence[str] | None = None, state: int | None = None) -> DataFrame:
    """A table as a state has it, or the rows of some sources: only their folders are read."""
    named = manifest(spark, root, state).where(F.col("table") == table)
    if sources is not None:
        named = named.where(F.col("source_id").isin(list(sources)))
    folders = [r[0] for r in named.select("folder").distinct().orderBy("folder").collect()]  # folders, not rows
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def marks(spark: SparkSession, root: str) -> dict[str, str]:
    """The marks of the newest state: one for each stream, and one for each source that has a cursor."""
    return {r.source_id: r.folder for r in manifest(spark, root).where(F.col("table") == MARKS).collect()}


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], sources: DataFrame, new_marks: dict[str, str | None] | None = None) -> int:
    """Replace what the `sources` (source_id) hold in the given tables, all at once; the number of the new state.

    A source of which a table has no row is gone from that table. Rows of other sources in `tables` are an error. `new_marks` are set in the same state, those of null go.
    """
    new_marks = new_marks or {}
    states, old = finished(spark, root), manifest(spark, root)
    changed = sources.select("source_id").distinct()
    run, named = uuid.uuid4().hex, []
    for name, rows in tables.items():
        base = f"{root}/{name}/{run}"
        # The folder of a source is named by its hash, since an id may hold any character.
        keyed = rows.withColumn("folder", F.sha2("source_id", 256))
        keyed.write.partitionBy("folder").parquet(base)
        written = spark.read.schema(f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, folder string").parquet(base)
        named.append(written.select("source_id", "folder").distinct().select(F.lit(name).alias("table"), "source_id", F.concat(F.lit(f"{base}/folder="), "folder").alias("folder")))
    for each in named:
        if not each.join(changed, "source_id", "left_anti").isEmpty():
            raise ValueError("rows of sources that aren't among those that change")
    stays = old.join(changed, "source_id", "left_anti").unionByName(old.where(~F.col("table").isin(list(tables))).join(changed, "source_id", "left_semi"))
    whole = stays.select("table", "source_id", "folder").where(~((F.col("table") == MARKS) & F.col("source_id").isin(list(new_marks))))
    for each in [*named, spark.createDataFrame([(MARKS, k, v) for k, v in new_marks.items() if v is not None], MANIFEST)]:
        whole = whole.unionByName(each)
    number = (states[-1] if states else 0) + 1
    # Fails where another write has finished, or begun to finish, this number.
    whole.coalesce(1).write.mode("error").json(f"{root}/manifests/{number}")
    return number


def without_orphans(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left when rows whose parents are gone go: chunks by document, mentions and edges by chunk, entities without a mention, edges by both ends."""
    chunks = ingest.cascade(tables[CHUNKS], tables[DOCUMENTS], "document_id")
    mentions = ingest.cascade(tables[MENTIONS], chunks, "chunk_id")
    entities = ingest.cascade(tables[ENTITIES], mentions, "entity_id")
    ends = ingest.cascade(tables[EDGES], chunks, "chunk_id")
    for end in ("src_id", "dst_id"):
        ends = ends.join(entities.select(F.col("entity_id").alias(end)), end, "left_semi")
    return {DOCUMENTS: tables[DOCUMENTS], CHUNKS: chunks, ENTITIES: entities, MENTIONS: mentions, EDGES: ends.select(tables[EDGES].columns)}


def replace_documents(spark: SparkSession, root: str, schemas: dict[str, str], gone: DataFrame, new: dict[str, DataFrame] | None = None) -> int:
    """Documents of `gone` (source_id, path) go with all that hangs on them, `new` rows of the five tables come, entities without a mention go: one state to the next.

    A document is replaced by naming it in `gone` and giving its rows in `new`; both may name any number of sources.
    """
    new = new or {}
    touched = gone.select("source_id")
    for rows in new.values():
        touched = touched.unionByName(rows.select("source_id"))
    sources = [r[0] for r in touched.distinct().collect()]  # one a source
    held = {t: read(spark, root, t, schemas[t], sources) for t in TABLES}
    kept = ingest.replace_documents(held[DOCUMENTS], gone, new.get(DOCUMENTS, held[DOCUMENTS].limit(0)).select(held[DOCUMENTS].columns), ["source_id", "path"])
    old_chunks = held[CHUNKS].join(held[DOCUMENTS].join(gone, ["source_id", "path"], "left_anti").select("document_id"), "document_id", "left_semi").select(held[CHUNKS].columns)
    rest = {t: held[t] for t in (ENTITIES, MENTIONS, EDGES)} | {CHUNKS: old_chunks}
    grown = {t: rows.unionByName(new[t].select(rows.columns)) if t in new else rows for t, rows in rest.items()}
    # Entities are there once for each source and key, whichever came first.
    grown[ENTITIES] = grown[ENTITIES].dropDuplicates(["source_id", "entity_id"])
    return commit(spark, root, without_orphans(grown | {DOCUMENTS: kept}), spark.createDataFrame([(s,) for s in sources], "source_id string"))


def sync_sources(spark: SparkSession, root: str, schemas: dict[str, str], ranks: DataFrame) -> int:
    """Ranks as the registry (source_id, new_rank) has them, in all tables that differ; sources that it doesn't name go with all their rows."""
    there = manifest(spark, root).where(F.col("table") != MARKS).select("source_id").distinct()
    removed = there.join(ranks, "source_id", "left_anti")
    held = {t: read(spark, root, t, schemas[t]) for t in TABLES}
    differ = held[DOCUMENTS].select("source_id", "classification_rank").distinct().join(ranks, "source_id").where("not classification_rank <=> new_rank").select("source_id")
    sources = [r[0] for r in removed.unionByName(differ).distinct().collect()]
    rows = {t: ingest.restamp(held[t].where(F.col("source_id").isin(sources)), ranks).select(held[t].columns) for t in TABLES}
    return commit(spark, root, rows, spark.createDataFrame([(s,) for s in sources], "source_id string"))
