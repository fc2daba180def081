"""Loaders: each type of source as items, the ids of all that is there, and a cursor for the next run.

`load` looks a type up; each loader returns DataFrames, so neither listings nor cursors go through the driver. A cursor holds a generation for each id,
under a fingerprint of the location and the selection: one of another fingerprint counts as none, and everything is read. Contents are
read only of ids whose generation differs.

Defined results: what isn't read (binary, too long, not UTF-8, gone since the listing) stays among the ids, so that its stored document isn't deleted;
restricted items have no text and aren't among the ids; of rows of an export with one key that with the greatest generation counts; rows without a key are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import markup
from ..functions.text import bucket_location, deep_link, named_value, selected
from ..operators.ingest import classify_file
from ..session import materialize
from . import git

LISTED = "path string, size long, modified long, generation string"
ITEMS = "path string, kind string, content_hash string, media_type string, text string, content binary, title string, url string, restricted boolean"
#: The longest text and the longest PDF that are read, and the media types.
MOST_TEXT, MOST_PDF = 1_000_000, 200 << 20
MEDIA = {"text": "text/plain", "pdf": "application/pdf", "markdown": "text/markdown"}
SENT_BYTES = 16 << 20


# --- Listings as a data source


def store_of(location: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a location, a path or a URI, and the path in it."""
    if "://" in location or location.startswith("file:"):
        return pafs.FileSystem.from_uri(location)
    return pafs.LocalFileSystem(), location


@dataclass
class Folders(InputPartition):
    """Folders to be listed whole, and folders of which only the files in them are listed."""

    whole: list[str]
    shallow: list[str]
    after: int = -1
    upto: int | None = None


class Listing(DataSource):
    """Files below a folder (LISTED), by format name `corvane_listing`. Options: path; depth, the levels of folders that the driver looks at to
    deal them out (1); parts, the most partitions (200).

    As a stream each file comes once for each time that it is modified, `settle` seconds later (2), so that a store's clock may be late by
    that; the offset is a time, of one size however many files there are. Stores that keep old modification times for new
    files need the batch listing against a cursor.
    """

    @classmethod
    def name(cls) -> str:
        return "corvane_listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingStream(self.options)


class _Lists:
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("corvane_listing needs a path")
        self.location, self.depth, self.parts = options["path"], int(options.get("depth", 1)), max(1, int(options.get("parts", 200)))
        self.settle = float(options.get("settle", 2))

    def dealt(self, after: int = -1, upto: int | None = None) -> list[Folders]:
        store, root = store_of(self.location)
        if store.get_file_info(root).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no folder {self.location}")
        level, shallow = [root], []
        for _ in range(self.depth):
            shallow += level
            level = [i.path for f in level for i in store.get_file_info(pafs.FileSelector(f, allow_not_found=True)) if i.type == pafs.FileType.Directory]
        n = min(self.parts, max(1, len(level) + len(shallow)))
        return [Folders(sorted(level)[k::n], sorted(shallow)[k::n], after, upto) for k in range(n)]

    def listed(self, part: Folders) -> Iterator[pa.RecordBatch]:
        store, root = store_of(self.location)
        cut = len(root.rstrip("/")) + 1
        for folder, deep in [(f, True) for f in part.whole] + [(f, False) for f in part.shallow]:
            found = [i for i in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=deep)) if i.type == pafs.FileType.File]
            rows = [(i.path[cut:], i.size, i.mtime_ns or 0, f"{i.mtime_ns}-{i.size}") for i in found if part.after < (i.mtime_ns or 0) and (part.upto is None or (i.mtime_ns or 0) <= part.upto)]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[at : at + 10_000]), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["path", "size", "modified", "generation"])


class ListingReader(_Lists, DataSourceReader):
    def partitions(self):
        return self.dealt()

    def read(self, partition):
        return self.listed(partition)


class ListingStream(_Lists, DataSourceStreamReader):
    def initialOffset(self):
        return {"upto": -1}

    def latestOffset(self):
        return {"upto": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start, end):
        return self.dealt(start["upto"], end["upto"])

    def read(self, partition):
        return self.listed(partition)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listing)


def read_files(paths: DataFrame, location: str) -> DataFrame:
    """`paths` (path, …) with the content of each; null for a file that is gone. At most SENT_BYTES and one file more are held at once."""
    own = [c for c in paths.columns if c != "content"]
    schema = paths.select(*own, F.lit(None).cast("binary").alias("content")).schema

    def run(batches):
        store, root = store_of(location)
        for b in batches:
            names, start, got, held = b.column("path").to_pylist(), 0, [], 0
            for k, name in enumerate(names):
                try:
                    with store.open_input_stream(f"{root.rstrip('/')}/{name}") as f:
                        got.append(f.read())
                except FileNotFoundError:
                    got.append(None)
                held += len(got[-1] or b"")
                if held >= SENT_BYTES or k + 1 == len(names):
                    yield pa.RecordBatch.from_arrays([*b.slice(start, len(got)).columns, pa.array(got, pa.binary())], names=[*own, "content"])
                    start, got, held = k + 1, [], 0

    return paths.select(*own).mapInArrow(run, schema)


# --- The contract


@dataclass(frozen=True)
class Source:
    """options, by type: git: ref, provider; pages: space; issues: edition (cloud or server), fields."""

    type: str
    location: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


@dataclass
class Loaded:
    """items: ITEMS to be taken in; ids: (path) of all that is there; cursor: (selection, path, generation) to be stored if the run had no error;
    incremental: whether items are only those that changed, so that ids are needed to tell what was deleted; details: for reports."""

    items: DataFrame
    ids: DataFrame
    cursor: DataFrame
    incremental: bool
    details: dict


def selection(source: Source) -> str:
    """What a cursor was made for; any other location, glob or option makes another."""
    return repr((source.type, source.location.rstrip("/"), source.include, source.exclude, sorted((k, v) for k, v in source.options.items() if k != "ref")))


def _unread(listed: DataFrame, source: Source, cursor: DataFrame | None) -> tuple[DataFrame, bool]:
    """Listed rows (path, generation, …) that the cursor doesn't hold at this generation, and whether there was a cursor for this selection."""
    known = None if cursor is None else cursor.where(F.col("selection") == selection(source)).select("path", "generation")
    if known is None or known.isEmpty():
        return listed, False
    return listed.join(known.distinct(), ["path", "generation"], "left_anti"), True


def _cursor(listed: DataFrame, source: Source) -> DataFrame:
    return listed.select(F.lit(selection(source)).alias("selection"), "path", "generation")


def _shaped(items: DataFrame, **made: Column) -> DataFrame:
    """ITEMS of what a loader has made; what it doesn't make is null."""
    return items.select(*[made.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in ITEMS.split(", "))])


def _fits(path: Column, size: Column) -> Column:
    return size <= F.when(F.lower(path).endswith(".pdf"), MOST_PDF).otherwise(MOST_TEXT)


def _of_files(read: DataFrame, url: Column | None = None) -> DataFrame:
    """Items of (path, content): texts and PDFs; the rest is left out."""
    kind = read.where("content IS NOT NULL").withColumn("kind", classify_file(F.col("content"), F.length("content"))).where("kind IS NOT NULL")
    c, text = F.col("content"), F.col("kind") == "text"
    return _shaped(kind, path=F.col("path"), kind=F.col("kind"), content_hash=F.sha2(c, 256), media_type=F.when(text, MEDIA["text"]).otherwise(MEDIA["pdf"]),
                   text=F.when(text, c.cast("string")).otherwise(""), content=F.when(~text, c), url=F.lit(None) if url is None else url, restricted=F.lit(False))


def _of_texts(made: DataFrame, url: Column) -> DataFrame:
    """Items of (path, title, body, restricted), as Markdown; bodies beyond the limit are left out."""
    fits = made.where("restricted OR octet_length(body) <= %d" % MOST_TEXT)
    shown = lambda c: F.when(~F.col("restricted"), c)
    body = F.when(F.col("restricted"), "").otherwise(F.col("body"))
    return _shaped(fits, path=F.col("path"), kind=F.lit("text"), content_hash=F.when(F.col("restricted"), "").otherwise(F.sha2(body, 256)), media_type=F.lit(MEDIA["markdown"]), text=body, title=shown(F.col("title")), url=shown(url), restricted=F.col("restricted"))


def _listed(spark: SparkSession, source: Source, location: str) -> DataFrame:
    register(spark)
    found = spark.read.format("corvane_listing").options(path=location, **{k: str(v) for k, v in source.options.items() if k in ("depth", "parts")}).load()
    return materialize(found.where(selected(F.col("path"), list(source.include), list(source.exclude)) & _fits(F.col("path"), F.col("size"))), "listing")


def local_folder(spark: SparkSession, source: Source, cursor: DataFrame | None) -> Loaded:
    """All files at each run: what didn't change is told by content later."""
    listed = _listed(spark, source, source.location)
    items = _of_files(read_files(listed.select("path"), source.location))
    return Loaded(items, listed.select("path"), _cursor(listed, source), False, {})


def objects(spark: SparkSession, source: Source, cursor: DataFrame | None) -> Loaded:
    """Objects below gs://bucket/prefix, or any location that has a file system; those of a known generation aren't read.

    An object that is written anew after the listing is read as it then is, under the generation listed: the next run reads it again.
    """
    listed = _listed(spark, source, source.location).where(~F.col("path").endswith("/"))
    changed, incremental = _unread(listed, source, cursor)
    at = bucket_location(F.lit(source.location))
    url = deep_link(F.lit("github"), F.lit("https://h/o/r"), F.lit(""), F.concat(F.coalesce(at["prefix"], F.lit("")), F.col("path")))
    # The console's address, its path escaped as all addresses here are.
    shown = F.when(at.isNotNull(), F.concat(F.lit("https://storage.cloud.google.com/"), at["bucket"], F.lit("/"), F.substring_index(url, "/o/r/blob//", -1)))
    return Loaded(_of_files(read_files(changed.select("path"), source.location), shown), listed.select("path"), _cursor(listed, source), incremental, {})


def git_files(spark: SparkSession, source: Source, cursor: DataFrame | None) -> Loaded:
    """Files of a commit (option `ref`, HEAD if there is none). Blob ids are the generations, so changed files are read whether the old commit is still there or not."""
    commit = git.resolve(source.location, source.options.get("ref", "HEAD"))
    files = git.listing(spark, source.location, commit).where(selected(F.col("path"), list(source.include), list(source.exclude)))
    sized = materialize(git.sizes(files, source.location), "git-sizes")
    listed = sized.where(_fits(F.col("path"), F.col("size"))).withColumn("generation", F.col("blob"))
    changed, incremental = _unread(listed, source, cursor)
    url = deep_link(F.lit(source.options.get("provider")), F.lit(source.options.get("web", source.location)), F.lit(commit), F.col("path"))
    return Loaded(_of_files(git.contents(changed, source.location), url), listed.select("path"), _cursor(listed, source), incremental, {"commit": commit})


# --- Exports: JSON lines, one object of the service's API in each


def _export(spark: SparkSession, location: str, schema: str) -> DataFrame:
    return spark.read.text(location).select(F.from_json("value", schema).alias("o")).select("o.*")


def _latest(rows: DataFrame, generation: Column) -> DataFrame:
    """One row for each id, of the greatest generation; ties are settled by the whole row."""
    order = Window.partitionBy("id").orderBy(generation.desc_nulls_last(), F.xxhash64(F.to_json(F.struct("*"))))
    return rows.where("id IS NOT NULL").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


_WHO = "STRUCT<results: ARRAY<STRING>, size: BIGINT>"
PAGE = f"id STRING, title STRING, version STRUCT<number: BIGINT>, ancestors ARRAY<STRUCT<id: STRING, title: STRING>>, restrictions STRUCT<read: STRUCT<restrictions: STRUCT<user: {_WHO}, `group`: {_WHO}>>>, body STRUCT<storage: STRUCT<value: STRING>>, _links STRUCT<webui: STRING>"


def restricted_itself(read: Column) -> Column:
    """Whether read restrictions name anyone; null where they aren't there."""
    named = [F.coalesce(F.size(read[k]["results"]) > 0, F.lit(False)) | (F.coalesce(read[k]["size"], F.lit(0)) > 0) for k in ("user", "group")]
    return F.when(read.isNotNull(), named[0] | named[1])


def pages(spark: SparkSession, source: Source, cursor: DataFrame | None) -> Loaded:
    """Pages of a wiki's export. A page is restricted if it is so itself or any ancestor is; what isn't known, or not in the export, is restricted.

    Bodies are turned to Markdown of pages only whose version the cursor doesn't hold.
    """
    space = source.options["space"]
    own = F.coalesce(restricted_itself(F.col("restrictions.read.restrictions")), F.lit(True))
    all_ = materialize(_latest(_export(spark, source.location, PAGE), F.col("version.number")).withColumn("own", own), "pages")
    above = all_.select("id", F.explode(F.array_distinct("ancestors.id")).alias("above"))
    shut = above.join(all_.where("NOT own").select(F.col("id").alias("above")), "above", "left_anti").select("id").distinct()
    # An ancestor without an id can't be looked up.
    nameless = F.exists(F.coalesce("ancestors", F.array().cast("array<struct<id:string,title:string>>")), lambda a: a["id"].isNull())
    told = all_.join(shut.withColumn("shut", F.lit(True)), "id", "left").withColumn("restricted", F.col("own") | F.coalesce("shut", F.lit(False)) | nameless)
    # Without bodies: these are looked up of changed pages alone.
    told = materialize(told.select("id", F.concat_ws("/", F.lit(space), "id").alias("path"), F.coalesce(F.col("version.number").cast("string"), F.lit("")).alias("generation"), "restricted"), "pages-told")
    listed = told.where("NOT restricted")
    changed, incremental = _unread(listed, source, cursor)
    title = F.coalesce(F.nullif("title", F.lit("")), "path")
    trail = F.filter(F.coalesce("ancestors.title", F.array().cast("array<string>")), lambda t: t != "")
    way = F.when(F.size(trail) > 0, F.concat(F.lit("Path: "), F.array_join(F.concat(trail, F.array(title)), " > "), F.lit("\n\n"))).otherwise("")
    body = F.concat(F.lit("# "), title, F.lit("\n\n"), way, F.coalesce(markup.html_markdown(F.coalesce("body.storage.value", F.lit(""))), F.lit("")))
    made = all_.join(changed.select("id", "path", "restricted"), "id").select("path", title.alias("title"), body.alias("body"), "restricted", F.col("_links.webui").alias("webui"))
    gone = told.where("restricted").select("path", F.lit(None).cast("string").alias("title"), F.lit("").alias("body"), "restricted", F.lit(None).cast("string").alias("webui"))
    url = F.concat(F.lit(source.options.get("web", "").rstrip("/")), F.coalesce("webui", F.lit("")))
    return Loaded(_of_texts(made.unionByName(gone), url), listed.select("path"), _cursor(listed, source), incremental, {})


#: Fields that are shown where a source names none, and the labels of those that are facts or lists (fixed values).
FIELDS = ("summary", "description", "issuetype", "status", "priority", "components", "labels", "issuelinks")
FACTS = {"issuetype": "Type", "status": "Status", "priority": "Priority", "resolution": "Resolution"}
LISTS = {"components": "Components", "fixVersions": "Fix versions"}
ISSUE = "key STRING, fields STRING"
_ISSUE_LINK = "ARRAY<STRUCT<type: STRUCT<outward: STRING, inward: STRING>, outwardIssue: STRUCT<key: STRING>, inwardIssue: STRUCT<key: STRING>>>"
_COMMENTS = "ARRAY<STRUCT<created: STRING, body: STRING>>"


def issue_text(key: Column, fields: Column, shown: tuple[str, ...] = FIELDS, rich: Callable[[Column], Column] = markup.wiki_markdown) -> Column:
    """An issue as Markdown: title, facts, lists, links, description and comments, as far as they are among the fields shown. `fields`: the JSON object of an issue's fields."""
    raw = lambda f: F.get_json_object(fields, f"$.{f}")
    kept = lambda f, c: c if f in shown else F.lit(None).cast("string")
    filled = lambda c: F.nullif(c, F.lit(""))
    line = lambda label, names: F.concat(F.lit(f"{label}: "), filled(names))
    summary = F.trim(F.coalesce(raw("summary"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    facts = filled(F.concat_ws(" · ", *[kept(f, line(label, named_value(fields, f))) for f, label in FACTS.items()]))
    name = lambda v: F.coalesce(filled(F.get_json_object(v, "$.name")), filled(F.get_json_object(v, "$.value")), F.when(~v.startswith("{"), v), F.lit(""))
    lists = [kept(f, line(label, F.array_join(F.transform(F.from_json(raw(f), "ARRAY<STRING>"), name), ", "))) for f, label in LISTS.items()]
    labels = kept("labels", line("Labels", F.array_join(F.from_json(raw("labels"), "ARRAY<STRING>"), ", ")))
    way = lambda x, end: F.when(x[f"{end}Issue"]["key"].isNotNull(), F.concat_ws(" ", F.coalesce(x["type"][end], F.lit("relates to")), x[f"{end}Issue"]["key"]))
    links = F.transform(F.from_json(raw("issuelinks"), _ISSUE_LINK), lambda x: F.coalesce(way(x, "outward"), way(x, "inward")))
    linked = kept("issuelinks", line("Links", F.array_join(F.filter(links, lambda x: x.isNotNull()), "; ")))
    about = filled(raw("description"))
    description = kept("description", F.when(about.isNotNull(), F.concat(F.lit("## Description\n\n"), F.coalesce(rich(about), F.lit("")))))
    head = F.concat(F.lit("# "), F.when(summary == "", key).otherwise(F.concat(key, F.lit(": "), summary)))
    top = F.concat(filled(F.concat_ws("\n", facts, *lists, labels, linked)), F.lit("\n"))
    rest = F.concat_ws("\n\n", description, kept("comment", filled(F.col("__comments"))))
    return F.concat(F.rtrim(F.concat(head, F.lit("\n\n"), F.coalesce(top, F.lit("")), F.lit("\n"), rest), F.lit(" \n")), F.lit("\n"))


def issues(spark: SparkSession, source: Source, cursor: DataFrame | None) -> Loaded:
    """Issues of a tracker's export. Those with a security level are restricted; texts are made of issues only whose `updated` the cursor doesn't hold."""
    cloud = source.options.get("edition", "cloud") == "cloud"
    shown = tuple(source.options.get("fields") or FIELDS)
    at = lambda f: F.get_json_object("fields", f"$.{f}")
    rows = _export(spark, source.location, ISSUE).withColumnRenamed("key", "id").withColumn("generation", F.coalesce(at("updated"), F.lit("")))
    # A level that is null or empty is none.
    level = at("security")
    told = materialize(_latest(rows, F.col("generation")).withColumns({"path": F.col("id"), "restricted": F.coalesce(~level.isin("", "{}", "[]", "false", "0"), F.lit(False))}), "issues")
    listed = told.where("NOT restricted")
    changed, incremental = _unread(listed, source, cursor)

    def rich(c: Column) -> Column:
        return F.when(c.startswith("{"), markup.tree_markdown(c)).otherwise(markup.wiki_markdown(c)) if cloud else markup.wiki_markdown(c)

    # Comments become rows, since rich text is made by a function of columns.
    if "comment" in shown:
        each = changed.select("id", F.posexplode(F.from_json(F.get_json_object("fields", "$.comment.comments"), _COMMENTS)).alias("nth", "c"))
        said = each.select("id", "nth", F.concat(F.rtrim(F.concat(F.lit("### Comment "), F.left(F.coalesce("c.created", F.lit("")), F.lit(10)))), F.lit("\n\n"), F.coalesce(rich(F.col("c.body")), F.lit(""))).alias("said"))
        joined = said.groupBy("id").agg(F.concat(F.lit("## Comments\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "said"))), lambda x: x["said"]), "\n\n")).alias("__comments"))
        changed = changed.join(joined, "id", "left")
    else:
        changed = changed.withColumn("__comments", F.lit(None).cast("string"))
    summary = F.nullif(F.trim(F.coalesce(at("summary"), F.lit("")), F.lit(" \t\n\x0b\x0c\r")), F.lit(""))
    made = changed.select("path", F.concat_ws(": ", "id", summary).alias("title"), issue_text(F.col("id"), F.col("fields"), shown, rich).alias("body"), "restricted")
    gone = told.where("restricted").select("path", F.lit(None).cast("string").alias("title"), F.lit("").alias("body"), "restricted")
    url = F.concat(F.lit(source.options.get("web", "").rstrip("/") + "/browse/"), F.col("path"))
    return Loaded(_of_texts(made.unionByName(gone), url), listed.select("path"), _cursor(listed, source), incremental, {})


LOADERS: dict[str, Callable[[SparkSession, Source, DataFrame | None], Loaded]] = {"local_folder": local_folder, "git": git_files, "gcs": objects, "confluence": pages, "jira": issues}


def load(spark: SparkSession, source: Source, cursor: DataFrame | None = None) -> Loaded:
    """What a source holds; an unknown type is an error."""
    if source.type not in LOADERS:
        raise ValueError(f"no loader for sources of type {source.type!r}; there are {', '.join(LOADERS)}")
    return LOADERS[source.type](spark, source, cursor)
