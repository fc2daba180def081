"""A stored keyword index with positions, and searches that read only the postings of their words.

The index has a row for each word of a chunk, with its places, and the chunk's source and rank, so that the row policy
applies to postings before any choice. Rows lie in folders by a hash of the word, ordered by word: a search opens the folders of its words, and
in these the row groups that may hold them. A word of very many chunks is spread over several files.

Searches use only the postings of their words. Single words need counts alone: these postings are dealt by chunk and meet all searches there. A phrase is looked
for once, however many searches have it, in the chunks of its rarest word, and only these chunks need places for their covers. Hits are as many as searches times the
chunks with their words, so that work grows with the square of the input where searches do.

A search is a set of terms; a term of several words is a phrase. A cover is a run of places that satisfies the search and holds no
shorter one that does: a phrase, or a word, but not a phrase around another term. Its density is 0.1 by the number of its words over those in it, so each cover of
adjacent words adds 0.1; a chunk's rank is by their sum, ties by key.

Words are the runs of letters and digits of heading and content, lower-cased. A chunk without words has no rows, a search without words finds nothing; null headings and contents are empty;
repeated terms count once; keys of chunks are unique, and a repeated row counts once; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import simple_tokens
from ..session import broadcast_if_small, scratch
from .scope import scoped

#: Folders of an index, and files that a folder's rows are spread over while they are written.
BUCKETS, SPREAD = 64, 4
#: Bytes of content whose words a task of the writing gets, on average: more content is spread over more files of a folder.
PART_BYTES = 2 << 20
#: Hits (a search's word in a chunk) of a task, on average, and words of searches that are sent to all tasks at once.
PART_HITS, GROUP_WORDS = 8_000_000, 1_000_000
#: Of a cover whose words are adjacent.
DENSITY = 0.1
CANDIDATES = 20
#: Chunk columns that a policy needs, kept with each posting where there are.
POLICY = ("source_id", "classification_rank")


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def postings(chunks: DataFrame, key: str = "chunk_id", buckets: int = BUCKETS) -> DataFrame:
    """bucket, token, key, places (in order, from 0), length (words of the chunk), and what the policy needs. One shuffle, by bucket and a hash of the key."""
    held = [c for c in POLICY if c in chunks.columns]
    heading = [F.coalesce(F.col("heading").cast("string"), F.lit(""))] if "heading" in chunks.columns else []
    texts = chunks.select(F.col(f"`{key}`").alias(key), *held, F.concat_ws(" ", *heading, F.coalesce("content", F.lit(""))).alias("text"))
    size, most = chunks.groupBy(f"`{key}`").agg(F.sum(F.octet_length("content")).alias("b"), F.count("*").alias("n")).agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > 1:
        texts = texts.distinct()
    # A word's places are brought together within the row: words are sorted, and each run of one word is a posting. Steps are columns, so that none is worked out for each word.
    words = texts.select(key, *held, simple_tokens(F.col("text")).alias("words"))
    ordered = words.select(key, *held, F.sort_array(F.transform("words", lambda w, i: F.struct(w.alias("token"), i.alias("place")))).alias("words"))
    tokens = ordered.select(key, *held, F.transform("words", lambda w: w["token"]).alias("token"), F.transform("words", lambda w: w["place"]).alias("place"), F.size("words").alias("length"))
    starts = tokens.select("*", F.filter(F.transform("token", lambda w, i: F.when((i == 0) | (w != F.get("token", i - 1)), i)), lambda i: i.isNotNull()).alias("start"))
    each = starts.select(key, *held, "length", F.inline(F.transform("start", lambda a, j: F.struct(F.get("token", a).alias("token"), F.slice("place", a + 1, F.coalesce(F.get("start", j + 1), F.col("length")) - a).alias("places")))))
    spread = max(SPREAD, -(-size // (buckets * PART_BYTES)))
    marked = each.withColumns({"bucket": bucket(F.col("token"), buckets), "spread": F.pmod(F.xxhash64(key), F.lit(spread))})
    # Partitions grow in number with the content, not in size.
    placed = marked.repartition(buckets * spread, "bucket", "spread") if spread > SPREAD else marked.repartition("bucket", "spread")
    return placed.select("bucket", "token", key, *held, "places", "length")


def write_index(chunks: DataFrame, folder: str | None = None, key: str = "chunk_id", buckets: int = BUCKETS) -> str:
    """Write the index of `chunks` (key, content, perhaps heading and policy columns) and return its folder: the given one, or one in the shared folder."""
    folder = folder or scratch(chunks.sparkSession, "keyword-index") + "/postings"
    postings(chunks, key, buckets).sortWithinPartitions("bucket", "token", key).write.mode("overwrite").partitionBy("bucket").parquet(folder)
    return folder


def read_index(spark: SparkSession, folder: str, policy: DataFrame | None = None) -> DataFrame:
    """The postings that a policy (source_id, ceiling) lets through; all without one."""
    found = spark.read.parquet(folder)
    return found if policy is None else scoped(found, policy)


def phrases(terms: Column) -> Column:
    """The distinct word lists of an array of terms; terms without words have none."""
    return F.array_distinct(F.filter(F.transform(terms, simple_tokens), lambda p: F.size(p) > 0))


def covers(windows: Column) -> Column:
    """How many of some windows {last, first} hold no other: by their ends, those that begin after all before them."""
    none = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("first"))
    later = lambda s, w: F.struct((s["n"] + F.when(w["first"] > s["first"], 1).otherwise(0)).alias("n"), F.greatest(s["first"], w["first"]).alias("first"))
    # Of windows with one end the shortest comes first, and the others don't begin after it.
    ordered = F.transform(F.array_sort(F.transform(windows, lambda w: F.struct(w["last"].alias("last"), (-w["first"]).alias("back")))), lambda w: F.struct(w["last"].alias("last"), (-w["back"]).alias("first")))
    return F.aggregate(ordered, none, later, lambda s: s["n"])


def asked_of(index: DataFrame, searches: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The postings of words that are searched for. search() reads them several times: write them first where the index is large."""
    token = F.explode(F.flatten(phrases(F.col("terms")))).alias("token")
    tokens = searches.select(token).distinct().select(bucket(F.col("token"), buckets).alias("bucket"), "token")
    return index.join(broadcast_if_small(tokens, GROUP_WORDS), ["bucket", "token"], "left_semi")


def _best(found: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("search").orderBy(F.desc("covers"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_words(index: DataFrame, words: DataFrame, k: int, key: str) -> DataFrame:
    """search, key, covers of the k best by words (search, bucket, token) alone: each place of a word is a cover.

    Postings are dealt by chunk, not by word, so that no frequent word makes one task large, and hits are summed and cut to the k best where they are made.
    """
    asked = words.groupBy("bucket", "token").agg(F.count("*").alias("asked"))
    hits = index.join(F.broadcast(asked), ["bucket", "token"]).agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hits // PART_HITS))
    held = index.join(F.broadcast(asked), ["bucket", "token"], "left_semi").select("bucket", "token", key, F.size("places").alias("n"))
    found = held.repartition(parts, key).join(F.broadcast(words), ["bucket", "token"]).groupBy("search", key).agg(F.sum("n").cast("int").alias("covers"))
    return _best(found, k, key).drop("rank")


def _at(index: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of `wanted` (bucket, token, key, more) with the places of that word in that chunk."""
    there = index.select(F.col("bucket").alias("__bucket"), F.col("token").alias("__token"), F.col(key).alias("__key"), "places")
    same = (F.col("bucket") == F.col("__bucket")) & (F.col("token") == F.col("__token")) & F.col(key).eqNullSafe(F.col("__key"))
    return wanted.join(there, same).drop("__bucket", "__token", "__key")


def _of_phrases(index: DataFrame, several: DataFrame, one: DataFrame, key: str, buckets: int) -> DataFrame:
    """search, key, covers of the chunks in which a phrase of `several` (search, phrase) stands, with the words `one` of its search."""
    words = several.select("phrase").distinct().select("phrase", F.posexplode("phrase").alias("nth", "token")).withColumn("bucket", bucket(F.col("token"), buckets))
    # Only chunks that hold the rarest word of a phrase are looked at.
    df = index.join(words.select("bucket", "token").distinct(), ["bucket", "token"]).groupBy("bucket", "token").agg(F.count("*").alias("df"))
    rarest = words.join(df, ["bucket", "token"]).groupBy("phrase").agg(F.min_by(F.struct("bucket", "token"), F.struct("df", "nth")).alias("word"), F.count("*").alias("n"))
    chunks = index.join(rarest.where(F.col("n") == F.size("phrase")).select("phrase", "word.bucket", "word.token"), ["bucket", "token"]).select("phrase", key)
    hits = _at(index, chunks.join(words, "phrase"), key).select("phrase", key, F.transform("places", lambda p: p - F.col("nth")).alias("starts"))
    # A phrase stands where each of its words has it start.
    size = F.size("phrase")
    every = hits.groupBy("phrase", key).agg(F.collect_list("starts").alias("all")).where(F.size("all") == size)
    common = F.aggregate(F.slice(F.col("all"), 2, size - 1), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    stands = every.select("phrase", key, F.transform(common, lambda s: F.struct((s + size - 1).alias("last"), s.alias("first"))).alias("windows")).where(F.size("windows") > 0)
    found = stands.join(several, "phrase").select("search", key, "windows")
    # Its covers hold none of the words that are searched for by themselves.
    single = _at(index, found.select("search", key).distinct().join(one, "search"), key).select("search", key, F.transform("places", lambda p: F.struct(p.alias("last"), p.alias("first"))).alias("windows"))
    return found.unionByName(single).groupBy("search", key).agg(covers(F.flatten(F.collect_list("windows"))).alias("covers"))


def search(index: DataFrame, searches: DataFrame, k: int = CANDIDATES, key: str = "chunk_id", buckets: int = BUCKETS) -> DataFrame:
    """search, key, covers, keyword_score and rank (from 1): the k best chunks of each of the `searches` (search, terms). Both are read several times: see asked_of()."""
    asked = searches.select("search", F.explode(phrases(F.col("terms"))).alias("phrase"))
    token = F.get("phrase", F.lit(0))
    one = asked.where(F.size("phrase") == 1).select("search", token.alias("token"), bucket(token, buckets).alias("bucket"))
    groups = max(1, -(-one.count() // GROUP_WORDS))
    parts = [_of_words(index, one.where(F.pmod(F.xxhash64("search"), F.lit(groups)) == g), k, key) for g in range(groups)]
    found = _of_phrases(index, asked.where(F.size("phrase") > 1), one, key, buckets).select("search", key, "covers")
    # A chunk with phrases has as many covers as by its words alone, or more: what is among the k best is here.
    for p in parts:
        found = found.unionByName(p)
    most = found.groupBy("search", key).agg(F.max("covers").alias("covers")).where("covers > 0")
    return _best(most, k, key).withColumn("keyword_score", F.col("covers") * F.lit(DENSITY))


def find(spark: SparkSession, folder: str, terms: Sequence[str], policy: DataFrame | None = None, k: int = CANDIDATES, key: str = "chunk_id", buckets: int = BUCKETS) -> DataFrame:
    """One search: its words are worked out on one row here, so that folders and row groups without them aren't read."""
    one = spark.range(1).select(F.lit(0).alias("search"), F.array(*[F.lit(str(t)) for t in terms]).cast("array<string>").alias("terms"))
    tokens = sorted({w for p in one.select(phrases(F.col("terms")).alias("p")).first()["p"] for w in p})
    at = sorted({r[0] for r in spark.createDataFrame([(w,) for w in tokens], "w string").select(bucket(F.col("w"), buckets)).collect()}) if tokens else []
    index = read_index(spark, folder, policy).where(F.col("bucket").isin(at) & F.col("token").isin(tokens))
    return search(index, one, k, key, buckets).drop("search")
