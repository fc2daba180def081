"""The knowledge graph: entities met by key across sources, bounded walks, merging and cleaning what was extracted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_key, names_key
from ..session import broadcast_if_small, materialize
from . import retrieval

MOST_HOPS, MOST_KEYS, MOST_EDGES = 2, 40, 60
DEPTH_BONUS = {0: 0.06, 1: 0.04, 2: 0.02}
GLOSSARY_BONUS = 0.03


def neighbours(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (a, b): keys that an edge joins, in both directions."""
    e = entities.select("entity_id", "key")
    ends = edges.join(e.select(F.col("entity_id").alias("src_id"), F.col("key").alias("a")), "src_id").join(e.select(F.col("entity_id").alias("dst_id"), F.col("key").alias("b")), "dst_id")
    return ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def walk(seeds: DataFrame, pairs: DataFrame, hops: int, most: int = MOST_KEYS) -> DataFrame:
    """(key, depth): keys within `hops` of the seeds, at their least depth, the first `most` by (depth, key).

    A hop is a join of the keys found last with the pairs; hops are few, so the plan is unrolled.
    """
    hops = max(0, min(hops, MOST_HOPS))
    found = last = seeds.select("key").distinct().withColumn("depth", F.lit(0))
    for d in range(1, hops + 1):
        last = last.join(pairs, last.key == pairs.a).select(F.col("b").alias("key")).distinct().withColumn("depth", F.lit(d))
        found = found.unionByName(last)
    return found.groupBy("key").agg(F.min("depth").alias("depth")).orderBy("depth", "key").limit(most)


def edges_among(keys: DataFrame, entities: DataFrame, edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """Distinct (src, relation, dst) names of edges whose ends both have one of the keys; where edges have a source_id, equal edges of two sources are two."""
    own = entities.join(keys.select("key"), "key", "left_semi").select("entity_id", "name")
    ends = edges.join(own.select(F.col("entity_id").alias("src_id"), F.col("name").alias("src")), "src_id").join(own.select(F.col("entity_id").alias("dst_id"), F.col("name").alias("dst")), "dst_id")
    names = ["src", "relation", "dst", *(["source_id"] if "source_id" in edges.columns else [])]
    return ends.select(*names).distinct().orderBy(*names).limit(most)


def seeds(best: DataFrame, entities: DataFrame, mentions: DataFrame, question: str) -> DataFrame:
    """Keys that the best chunks mention, and keys that the question names."""
    e = entities.select("entity_id", "key")
    mentioned = mentions.join(best.select("chunk_id"), "chunk_id", "left_semi").join(e, "entity_id").select("key")
    named = e.where(names_key(entity_key(F.lit(question)), F.col("key"))).select("key")
    return mentioned.unionByName(named).distinct()


@dataclass(frozen=True)
class Found:
    """What one walk gives: hits in order, seeds (key), reached (key, depth)."""

    hits: DataFrame
    seeds: DataFrame
    reached: DataFrame


def graph_search(chunks: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame, query: list[float], terms: list[str], question: str, k: int, hops: int, boost: list[str] = ()) -> DataFrame:
    """The hits of search(): the k best chunks, one a document."""
    return search(chunks, entities, mentions, edges, query, terms, question, k, hops, boost).hits


def search(chunks: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame, query: list[float], terms: list[str], question: str, k: int, hops: int, boost: list[str] = ()) -> Found:
    """The k best chunks (1 to 20), one a document: vector and keyword candidates, and chunks reached through the graph, with the walk that reached them.

    The score of a hit has all bonuses: of the depth, the keyword rank and the glossary sources. A blank question finds nothing.
    """
    k = max(1, min(int(k), retrieval.MOST_HITS))
    if not question.strip():
        none = F.lit(None)
        return Found(chunks.limit(0).withColumns({"score": F.lit(0.0), "via": F.lit("")}), entities.limit(0).select("key"), entities.limit(0).select("key", none.cast("int").alias("depth")))
    # Two lists of at most CANDIDATES rows, written, since all that follows looks at them again.
    vector = materialize(retrieval.vector_top_k(chunks, query, retrieval.CANDIDATES).select("chunk_id", "score"), "vector")
    keyword = materialize(retrieval.keyword_rank(chunks, terms).select("chunk_id", "rank"), "keyword")
    ranked = vector.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("rank"), F.lit(0).alias("list"))
    fused = retrieval.fuse(ranked.unionByName(keyword.withColumn("list", F.lit(1))).withColumnRenamed("chunk_id", "id"))
    best = fused.orderBy(F.desc("score"), "best", "id").limit(3).select(F.col("id").alias("chunk_id"))
    begun = materialize(seeds(best, entities, mentions, question), "seeds")
    reached = materialize(walk(begun, neighbours(entities, edges), hops), "reached")
    by_graph = entities.join(reached, "key").join(mentions, "entity_id").groupBy("chunk_id").agg(F.min("depth").alias("depth"))
    ids = fused.select(F.col("id").alias("chunk_id"), "lists").join(by_graph, "chunk_id", "full_outer").join(keyword, "chunk_id", "left")
    rows = chunks.join(broadcast_if_small(materialize(ids, "ids")), "chunk_id").withColumn("cosine", retrieval.cosine(F.col("embedding"), query))
    depth_bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in DEPTH_BONUS.items() for x in pair]), F.col("depth")), F.lit(0.0))
    glossary = F.when(F.col("source_id").isin(*boost), GLOSSARY_BONUS).otherwise(0.0) if boost else F.lit(0.0)
    via = F.when(F.col("depth").isNotNull(), "graph").when(F.size("lists") > 1, "both").when(F.get("lists", F.lit(0)) == 0, "vector").otherwise("keyword")
    scored = rows.withColumns({"score": F.col("cosine") + depth_bonus + retrieval.keyword_bonus(F.col("rank")) + glossary, "via": via})
    return Found(retrieval.one_per_document(scored, k, [F.desc("score"), F.col("chunk_id")]), begun, reached)


def answer(chunks: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame, query: list[float], terms: list[str], question: str, k: int, hops: int, boost: list[str] = ()) -> DataFrame:
    """One row with all that a question finds, from one walk:

    results, the hits by falling score (source, path, heading, score to four places, via, snippet); seeds, keys in order; entities, at most
    MOST_KEYS by key and source (name, type, source, hops, description); relations, at most MOST_EDGES by name (from, relation, to, source).
    A blank question has four empty arrays. The tables must be those that the caller may read; entities and edges have a source_id.
    """
    found = search(chunks, entities, mentions, edges, query, terms, question, k, hops, boost)
    hit = F.struct(F.col("source_id").alias("source"), "path", "heading", F.round("score", 4).alias("score"), "via", F.col("content").alias("snippet"))
    # Each part is bounded, by k, MOST_KEYS, MOST_EDGES, or the keys that three chunks and a question name.
    results = found.hits.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "chunk_id", hit.alias("hit")))), lambda x: x["hit"]).alias("results"))
    keys = found.seeds.agg(F.array_sort(F.collect_set("key")).alias("seeds"))
    near = entities.join(F.broadcast(found.reached), "key").orderBy("key", "source_id", "entity_id").limit(MOST_KEYS)
    entity = F.struct("name", "type", F.col("source_id").alias("source"), F.col("depth").alias("hops"), "description")
    named = near.agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "source_id", "entity_id", entity.alias("e")))), lambda x: x["e"]).alias("entities"))
    relation = F.struct(F.col("src").alias("from"), "relation", F.col("dst").alias("to"), F.col("source_id").alias("source"))
    joined = edges_among(found.reached, entities, edges).agg(F.array_sort(F.collect_list(relation)).alias("relations"))
    return results.crossJoin(keys).crossJoin(named).crossJoin(joined)  # four tables of one row


def merge_entities(mentioned: DataFrame, order: Column) -> DataFrame:
    """One entity for each (source_id, key): the first name and type, the longest description (of equals the first)."""
    first = F.min(F.struct(order.alias("o"), "name", "type"))
    longest = F.max(F.struct(F.length("description").alias("n"), (-order).alias("o"), "description"))
    return mentioned.groupBy("source_id", "key").agg(first.alias("f"), longest.alias("d")).select("source_id", "key", "f.name", "f.type", "d.description")


def orphans(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    return entities.join(mentions, "entity_id", "left_anti")


def clean_extraction(found: DataFrame, types: list[str], most: int = 25) -> DataFrame:
    """Of (doc, pos, name, type, description): known types, first of each key, `most` a document, cut to length."""
    keyed = found.where(F.col("type").isin(*types)).withColumn("key", entity_key(F.col("name"))).where("key <> ''")
    first = keyed.groupBy("doc", "key").agg(F.min(F.struct("pos", F.left(F.trim("name"), F.lit(200)).alias("name"), "type", F.left("description", F.lit(500)).alias("description"))).alias("f")).select("doc", "key", "f.*")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).where(F.col("n") <= most).drop("n")


def clean_relations(relations: DataFrame, entities: DataFrame, allowed: list[str]) -> DataFrame:
    """(doc, source, relation, target): distinct known relations between two different entities of clean_extraction(), by their names there."""
    keyed = relations.where(F.col("relation").isin(*allowed)).select("doc", entity_key(F.col("source")).alias("s"), "relation", entity_key(F.col("target")).alias("t")).where("s <> t").distinct()
    end = lambda key, name: entities.select("doc", F.col("key").alias(key), F.col("name").alias(name))
    return keyed.join(end("s", "source"), ["doc", "s"]).join(end("t", "target"), ["doc", "t"]).select("doc", "source", "relation", "target")


def write_graph(entities: DataFrame, relations: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new entities, mentions, edges) of a source: entities (source_id, chunk_id, key, name, type, description), relations (source_id,
    chunk_id, src_key, relation, dst_key), known entities (source_id, key, entity_id).

    Ids of new entities follow the greatest known one, in the order of source and key; a mention or an edge counts once.
    """
    merged = merge_entities(entities, F.col("chunk_id")).join(known.select("source_id", "key"), ["source_id", "key"], "left_anti")
    last = known.agg(F.coalesce(F.max("entity_id"), F.lit(0))).first()[0]
    # Ranges of keys are numbered side by side: counts of each range come first.
    ordered = materialize(merged.repartitionByRange("source_id", "key").sortWithinPartitions("source_id", "key").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "new-entities")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = sizes.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    new = ordered.join(before, "part").select("source_id", "key", "name", "type", "description", (F.lit(last) + 1 + F.col("before") + F.col("at") - F.col("first")).alias("entity_id"))
    ids = known.select("source_id", "key", "entity_id").unionByName(new.select("source_id", "key", "entity_id"))
    mentions = entities.select("source_id", "chunk_id", "key").distinct().join(ids, ["source_id", "key"]).select("source_id", "entity_id", "chunk_id")
    end = lambda key, name: ids.select("source_id", F.col("key").alias(key), F.col("entity_id").alias(name))
    edges = relations.select("source_id", "chunk_id", "src_key", "relation", "dst_key").distinct().join(end("src_key", "src_id"), ["source_id", "src_key"]).join(end("dst_key", "dst_id"), ["source_id", "dst_key"]).select("source_id", "src_id", "relation", "dst_id", "chunk_id")
    return new, mentions, edges


def cache_key(version: str, model: str, types: list[str], relations: list[str], text: Column) -> Column:
    """One key for the same text under the same extractor; the order of types and relations doesn't matter."""
    texts = lambda names: F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(model).alias("model"), texts(types).alias("types"), texts(relations).alias("relations"), F.coalesce(text, F.lit("")).alias("text"))), 256)


def cache_lookup(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """`chunks` (with cache_key) with the cached result, and cached: false where the extractor has to be asked, once for each key."""
    found = chunks.join(cache.select("cache_key", F.col("result"), F.lit(True).alias("cached")), "cache_key", "left")
    return found.withColumn("cached", F.coalesce("cached", F.lit(False)))
