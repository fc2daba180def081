"""Files as items: a scan of a folder in any store that Spark reads, and rows of the same form from listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import selected
from ..operators.ingest import classify_file
from ..session import materialize


def folder(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), most: int = 200 << 20) -> DataFrame:
    """(path, kind, content_hash, text, content): files that the globs select, below `root`; text only of text files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    small = found.withColumn("path", relative).where((F.col("length") <= most) & selected(F.col("path"), list(include), list(exclude)))
    kind = small.withColumn("kind", classify_file(F.col("content"), F.col("length"))).where("kind IS NOT NULL")
    return kind.select("path", "kind", F.sha2("content", 256).alias("content_hash"), F.when(F.col("kind") == "text", F.col("content").cast("string")).alias("text"), "content")


def unread(listing: DataFrame, cursor: DataFrame) -> DataFrame:
    """Listed objects (path, generation) that the cursor doesn't have at this generation."""
    return listing.join(cursor.select("path", "generation"), ["path", "generation"], "left_anti")


def restricted_pages(pages: DataFrame) -> DataFrame:
    """Ids of pages (id, parent, restricted) that are restricted themselves or below one that is, however deep; unknown is restricted.

    Each round is written, and goes on from the pages that were not found before, so that a circle of parents ends too.
    """
    found = last = materialize(pages.where(F.coalesce("restricted", F.lit(True))).select("id").distinct(), "restricted")
    while not last.isEmpty():
        below = pages.join(last.select(F.col("id").alias("parent")), "parent").select("id").distinct()
        last = materialize(below.join(found, "id", "left_anti"), "restricted")
        found = materialize(found.unionByName(last), "restricted-found")
    return found


def changed_paths(before: DataFrame, after: DataFrame, comparable: bool = True) -> DataFrame:
    """(path, change) from one listing (path, content_hash) to the next: changed or deleted; all are changed where they can't be compared,
    since the old one is missing, the location is new or the globs are others."""
    if not comparable:
        return after.select("path", F.lit("changed").alias("change"))
    b, a = before.select("path", F.col("content_hash").alias("old")), after.select("path", F.col("content_hash").alias("new"))
    both = b.join(a, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("path", F.when(F.col("new").isNull(), "deleted").otherwise("changed").alias("change"))
