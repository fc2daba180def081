"""Ranking: exact vector top-k, keyword rank, fusion, hybrid search, per-document choice, metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, MOST_HITS = 20, 20
BONUS, RRF = 0.08, 60


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine similarity in doubles; a zero vector has similarity 0. The query is divided by its length once, here."""
    length = sum(float(x) * float(x) for x in query) ** 0.5
    q = F.array(*[F.lit(float(x) / length if length else 0.0) for x in query])
    both = F.aggregate(F.zip_with(v, q, lambda a, b: F.struct((a.cast("double") * b).alias("d"), (a.cast("double") * a.cast("double")).alias("n"))), F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n")), lambda s, x: F.struct((s["d"] + x["d"]).alias("d"), (s["n"] + x["n"]).alias("n")))
    return F.coalesce(F.try_divide(both["d"], F.sqrt(both["n"])), F.lit(0.0))


def vector_top_k(chunks: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    """The k most similar rows with score; equal scores by key. Spark keeps k rows a task, it never sorts all."""
    return chunks.withColumn("score", cosine(F.col("embedding"), query)).orderBy(F.desc("score"), key).limit(k)


def occurrences(text: Column, phrase: list[str]) -> Column:
    """How often the words of the phrase stand one after the other in a lower-case text, words being runs of letters and digits."""
    letter = r"[\p{L}\p{N}]"
    rest = "".join(rf"[^\p{{L}}\p{{N}}]+\Q{p}\E(?!{letter})" for p in phrase[1:])
    return F.regexp_count(text, F.lit(rf"(?<!{letter})\Q{phrase[0]}\E(?!{letter})" + (f"(?={rest})" if rest else "")))


def keyword_rank(chunks: DataFrame, terms: list[str], k: int = CANDIDATES, key: str = "chunk_id") -> DataFrame:
    """The k rows with most occurrences of any term, with keyword_score and rank from 1; a term of several parts is a phrase.

    One pass of a pattern for each term, over rows that hold its first word at all; rows without a hit go after the choice of k.
    """
    import re

    phrases = [p for p in ([x.lower() for x in re.split(r"[\W_]+", t) if x] for t in terms) if p]
    if not phrases:
        return chunks.limit(0).withColumns({"keyword_score": F.lit(0.0), "rank": F.lit(0)})
    text = F.lower(F.concat_ws(" ", F.coalesce("heading", F.lit("")), "content"))
    maybe = text.contains(phrases[0][0])
    for p in phrases[1:]:
        maybe = maybe | text.contains(p[0])
    total = sum((occurrences(text, p) for p in phrases[1:]), occurrences(text, phrases[0]))
    best = chunks.where(maybe).withColumn("keyword_score", total * F.lit(0.1)).orderBy(F.desc("keyword_score"), key).limit(k)
    return best.where("keyword_score > 0").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("keyword_score"), key)))


def keyword_bonus(rank: Column) -> Column:
    return F.when(rank.isNull(), 0.0).otherwise(BONUS * 10 / (10 + rank - 1))


def fuse(rankings: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (list, id, rank): id, score, best rank, and the lists it is in."""
    return rankings.groupBy("id").agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"), F.min("rank").alias("best"), F.sort_array(F.collect_set("list")).alias("lists"))


def hybrid_search(chunks: DataFrame, query: list[float], terms: list[str], k: int, key: str = "chunk_id", matches: DataFrame | None = None) -> DataFrame:
    """The k best by cosine plus keyword bonus. The score returned is the cosine; via: vector, keyword or both. An empty query finds nothing.

    `matches`: (key, rank) of the terms from a stored index, at most CANDIDATES rows; without it every text is scanned.
    """
    if not query and not terms:
        return chunks.limit(0).select(key, *[c for c in chunks.columns if c != key], F.lit(0.0).alias("score"), F.lit("").alias("via"), F.lit(0.0).alias("order_score"))
    k = max(1, min(k, MOST_HITS))
    vector = vector_top_k(chunks, query, max(k, CANDIDATES) if terms else k, key).withColumn("__v", F.lit(True))
    columns = [c for c in chunks.columns if c != key]
    found = keyword_rank(chunks, terms, key=key) if matches is None else chunks.join(F.broadcast(matches.select(key, "rank").limit(CANDIDATES)), key)
    keyword = found.withColumn("score", cosine(F.col("embedding"), query))
    # Two lists of at most CANDIDATES rows.
    v = vector.select(key, F.struct(*columns, "score").alias("v"))
    w = keyword.select(key, F.struct(*columns, "score").alias("w"), "rank")
    both = v.join(w, key, "full_outer").withColumn("row", F.coalesce("v", "w"))
    via = F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), "both").when(F.col("v").isNotNull(), "vector").otherwise("keyword")
    ordered = both.withColumns({"via": via, "order_score": F.col("row.score") + keyword_bonus(F.col("rank"))})
    return ordered.orderBy(F.desc("order_score"), key).limit(k).select(key, "row.*", "via", "order_score")


def one_per_document(hits: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first hit of each (source_id, path) in this order, k of them."""
    w = Window.partitionBy("source_id", "path").orderBy(*order)
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").orderBy(*order).limit(k)


def location(hit_is_pdf: Column) -> Column:
    """Pages for PDF files, else lines."""
    return F.struct(F.when(hit_is_pdf, "pages").otherwise("lines").alias("unit"), F.col("start_line").alias("from"), F.col("end_line").alias("to"))


def retrieval_metrics(hits: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """recall_3, recall_5 and mrr, averaged over questions in each group.

    hits: (q, rank, doc); expected: (q, doc, *by). Documents are ranked by their first hits. Recall and mrr are means over the expected
    documents of a question: of whether they are among the first, and of 1 / rank, 0 where they aren't found.
    """
    files = hits.groupBy("q", "doc").agg(F.min("rank").alias("hit")).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("hit", "doc")))
    firsts = expected.join(files.select("q", "doc", "rank"), ["q", "doc"], "left")
    share = lambda n: F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0))
    each = firsts.groupBy("q", *by).agg(share(3).alias("r3"), share(5).alias("r5"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("rr"))
    return each.groupBy(*by).agg(F.count("*").alias("questions"), F.avg("r3").alias("recall_3"), F.avg("r5").alias("recall_5"), F.avg("rr").alias("mrr"))


def variants(hits: DataFrame, k: int) -> DataFrame:
    """(variant, q, rank, doc) of hits (variant, q, rank, doc): each variant as it is, and as `<variant>+dedup` with each document's first hit only."""
    own = hits.select("variant", "q", "rank", "doc")
    once = own.groupBy("variant", "q", "doc").agg(F.min("rank").alias("hit"))
    again = once.select(F.concat("variant", F.lit("+dedup")).alias("variant"), "q", F.row_number().over(Window.partitionBy("variant", "q").orderBy("hit", "doc")).alias("rank"), "doc")
    return own.unionByName(again).where(F.col("rank") <= k)


def neighbours_of(vectors: DataFrame, questions: DataFrame, k: int, block: int = 512) -> DataFrame:
    """(q, doc, rank): the k most similar rows of `vectors` (doc, v) for each question (q, v), itself (doc = q) aside.

    Exact, by cosine rounded to 9 digits, of equals the smaller doc; a zero vector comes last. Questions go out in blocks of
    `block` (from the driver's iterator, so that one block is held); a task keeps the best k of each question.
    """

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)

    def best(qs: np.ndarray, qv: np.ndarray):
        asked = unit(qv)

        def run(batches):
            doc, score = np.zeros((len(qs), 0), np.int64), np.zeros((len(qs), 0))
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    ids = b.column(0).to_numpy(zero_copy_only=False)
                    s = np.round(asked @ unit(np.array(b.column(1).to_pylist(), float)).T, 9)
                    s = np.where(ids[None, :] == qs[:, None], -np.inf, np.where(np.isnan(s), -2.0, s))
                    doc, score = np.concatenate([doc, np.broadcast_to(ids, s.shape)], 1), np.concatenate([score, s], 1)
                    keep = np.lexsort((doc, -score), axis=1)[:, :k]
                    doc, score = np.take_along_axis(doc, keep, 1), np.take_along_axis(score, keep, 1)
            q, at = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(qs[q]), pa.array(doc[q, at]), pa.array(score[q, at])], names=["q", "doc", "s"])

        return run

    rows, found, part = questions.select("q", "v").toLocalIterator(), [], []

    def send():
        run = best(np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], float))
        found.append(vectors.select("doc", "v").mapInArrow(run, "q long, doc long, s double"))
        part.clear()

    for r in rows:
        part.append(r)
        if len(part) == block:
            send()
    if part:
        send()
    if not found:
        return vectors.sparkSession.createDataFrame([], "q long, doc long, rank int")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "doc"))).where(F.col("rank") <= k).select("q", "doc", "rank")
