"""The queries on the driver's tables, one for each operator, each with its SQL.

A chunk is a document with its embedding; the policy, graph and call tables are made from the same columns in
the Spark plan and in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, markup, text
from ..operators import graph, ingest, policy, retrieval, rollups, scope, versions
from ..streaming import calls as limiter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CEILINGS = [("src0", 3), ("src1", 2), ("src2", 1), ("src3", 0), ("src5", 3), ("src7", 2), ("nowhere", 3)]
CEILING_VALUES = ", ".join(f"('{s}', {c})" for s, c in CEILINGS)
#: A query vector of as many numbers as an embedding has (fixed values).
VECTOR = [round(((i * 37) % 101) / 50 - 1, 2) for i in range(64)]
VECTOR_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"
TERMS = ["the", "by-nc", "worthless"]
CHUNKS_SQL = f"""chunks AS (SELECT doc_id AS chunk_id, source AS source_id, source || '/' || doc_id AS path, d.text AS content, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM documents d JOIN embeddings e ON doc_id = vec_id JOIN (VALUES {CEILING_VALUES}) p(s, c) ON source = s AND doc_id % 4 <= c)"""
COSINE_SQL = f"(list_dot_product(v, {VECTOR_SQL}) / sqrt(list_dot_product(v, v) * list_dot_product({VECTOR_SQL}, {VECTOR_SQL})))"
TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
HITS_SQL = f"(SELECT chunk_id, t, list_sum(list_transform(range(1, len(t) + 1), lambda i: (t[i] = 'the')::INT + (t[i] = 'by' AND coalesce(t[i + 1], '') = 'nc')::INT + (t[i] = 'worthless')::INT)) AS n FROM (SELECT chunk_id, {TOKENS_SQL} AS t FROM chunks))"
KEYWORD_SQL = f"keyword AS (SELECT chunk_id, n * 0.1 AS kscore, row_number() OVER (ORDER BY n DESC, chunk_id) AS rank FROM {HITS_SQL} WHERE n > 0 QUALIFY rank <= 20)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    return scope.scoped(d.withColumns({"classification_rank": F.pmod("doc_id", F.lit(4)), "source_id": F.col("source")}), F.broadcast(values(spark, CEILINGS, "source_id string, ceiling int")))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    d, e = docs(spark, sf), t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return d.join(e, "doc_id").select(F.col("doc_id").alias("chunk_id"), "source_id", F.concat_ws("/", "source_id", "doc_id").alias("path"), F.col("text").alias("content"), F.lit(None).cast("string").alias("heading"), "embedding")


@query(f"SELECT source AS source_id, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN (VALUES {CEILING_VALUES}) p(s, c) ON source = s AND doc_id % 4 <= c GROUP BY source")
def rls_scan(spark, sf):
    return docs(spark, sf).groupBy("source_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, path, round({COSINE_SQL}, 6) AS score FROM chunks ORDER BY {COSINE_SQL} DESC, chunk_id LIMIT 10")
def vector_topk(spark, sf):
    return retrieval.vector_top_k(chunks(spark, sf), VECTOR, 10).select("chunk_id", "path", F.round("score", 6).alias("score"))


@query(r"""SELECT doc_id, len(ts)::INT AS n, array_to_string(ts, ' ') AS terms FROM (SELECT doc_id, list_transform(list_sort(list_transform(map_entries(list_min), lambda e: e)), lambda e: e) AS ts FROM (SELECT 1 AS doc_id, MAP {} AS list_min) WHERE false)
UNION ALL SELECT doc_id, count(*)::INT AS n, string_agg(w, ' ' ORDER BY i) AS terms FROM (
  SELECT doc_id, w, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, lower(x[i]) AS w, min(i) AS i FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9](?:[A-Za-z0-9_./-]*[A-Za-z0-9])?') AS x FROM documents))
    WHERE regexp_matches(x[i], '[_./-]|[0-9]') OR (substring(x[i], 2) <> lower(substring(x[i], 2)) AND x[i] <> upper(x[i])) GROUP BY doc_id, lower(x[i])))
WHERE k <= 12 GROUP BY doc_id""")
def keyword_terms(spark, sf):
    found = t(spark, sf, "documents").select("doc_id", text.identifier_terms(F.col("text")).alias("x"))
    return found.where(F.size("x") > 0).select("doc_id", F.size("x").alias("n"), F.array_join("x", " ").alias("terms"))


ORACLE_SQL["keyword_terms"] = ORACLE_SQL["keyword_terms"].split("UNION ALL ", 1)[1]


@query(f"WITH {CHUNKS_SQL}, {KEYWORD_SQL} SELECT chunk_id, round(kscore, 6)::DOUBLE AS keyword_score, rank::INT AS rank, round(0.8 / (9 + rank), 9) AS bonus FROM keyword")
def keyword_rank(spark, sf):
    return retrieval.keyword_rank(chunks(spark, sf), TERMS).select("chunk_id", F.round("keyword_score", 6).alias("keyword_score"), "rank", F.round(retrieval.keyword_bonus(F.col("rank")), 9).alias("bonus"))


@query(f"""WITH {CHUNKS_SQL}, {KEYWORD_SQL}, cos AS (SELECT chunk_id, path, {COSINE_SQL} AS score FROM chunks), vec AS (SELECT * FROM cos ORDER BY score DESC, chunk_id LIMIT 20)
SELECT chunk_id, path, round(score, 6) AS score, via, round(o, 6) AS order_score FROM (
  SELECT c.*, CASE WHEN v.chunk_id IS NOT NULL AND k.chunk_id IS NOT NULL THEN 'both' WHEN v.chunk_id IS NOT NULL THEN 'vector' ELSE 'keyword' END AS via, c.score + coalesce(0.8 / (9 + k.rank), 0) AS o
  FROM cos c LEFT JOIN vec v USING (chunk_id) LEFT JOIN keyword k USING (chunk_id) WHERE v.chunk_id IS NOT NULL OR k.chunk_id IS NOT NULL) ORDER BY o DESC, chunk_id LIMIT 10""")
def hybrid_search(spark, sf):
    return retrieval.hybrid_search(chunks(spark, sf), VECTOR, TERMS, 10).select("chunk_id", "path", F.round("score", 6).alias("score"), "via", F.round("order_score", 6).alias("order_score"))


@query(f"""WITH {CHUNKS_SQL}, {KEYWORD_SQL}, r AS (SELECT chunk_id AS id, rank, 1 AS l FROM keyword UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY {COSINE_SQL} DESC, chunk_id), 0 FROM chunks QUALIFY row_number() OVER (ORDER BY {COSINE_SQL} DESC, chunk_id) <= 20)
SELECT id, round(sum(1 / (60 + rank)), 9) AS score, min(rank)::INT AS best, string_agg(l::VARCHAR, ',' ORDER BY l) AS lists FROM r GROUP BY id""")
def rrf_fuse(spark, sf):
    c = chunks(spark, sf)
    vector = retrieval.vector_top_k(c, VECTOR, 20).select(F.col("chunk_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("rank"), F.lit(0).alias("list"))
    keyword = retrieval.keyword_rank(c, TERMS).select(F.col("chunk_id").alias("id"), "rank", F.lit(1).alias("list"))
    return retrieval.fuse(vector.unionByName(keyword)).select("id", F.round("score", 9).alias("score"), "best", F.concat_ws(",", F.transform("lists", lambda x: x.cast("string"))).alias("lists"))


# The graph: suppliers, nations and regions are entities; a supplier is in a nation, a nation in a region.
ENTITIES_SQL = """ent AS (SELECT s_suppkey AS entity_id, s_name AS name FROM supplier UNION ALL SELECT 1000000000 + n_nationkey, n_name FROM nation UNION ALL SELECT 2000000000 + r_regionkey, r_name FROM region),
entities AS (SELECT entity_id, name, trim(regexp_replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM ent),
edges AS (SELECT s_suppkey AS src_id, 1000000000 + s_nationkey AS dst_id, 'located in' AS relation FROM supplier UNION ALL SELECT 1000000000 + n_nationkey, 2000000000 + n_regionkey, 'part of' FROM nation),
named AS (SELECT a.key AS ka, b.key AS kb, a.name AS na, b.name AS nb, relation FROM edges JOIN entities a ON src_id = a.entity_id JOIN entities b ON dst_id = b.entity_id),
pairs AS (SELECT ka AS a, kb AS b FROM named UNION SELECT kb, ka FROM named)""".replace("\\\\", "\\")


def entities(spark, sf):
    named = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    for table, key, name, base in (("nation", "n_nationkey", "n_name", 10**9), ("region", "r_regionkey", "r_name", 2 * 10**9)):
        named = named.union(t(spark, sf, table).select(F.col(key) + base, name))
    return named.withColumn("key", text.entity_key(F.col("name")))


def edges(spark, sf):
    a = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("src_id"), (F.col("s_nationkey") + 10**9).alias("dst_id"), F.lit("located in").alias("relation"))
    return a.union(t(spark, sf, "nation").select(F.col("n_nationkey") + 10**9, F.col("n_regionkey") + 2 * 10**9, F.lit("part of")))


SEEDS_SQL = "SELECT key, 0 AS depth FROM entities WHERE entity_id = 1"
WALK_SQL = f"steps AS ({SEEDS_SQL} UNION SELECT b, depth + 1 FROM steps JOIN pairs ON a = key WHERE depth < 2), walk AS (SELECT key, min(depth) AS depth FROM steps GROUP BY key ORDER BY 2, 1 LIMIT 40)"


def walked(spark, sf):
    e = entities(spark, sf)
    return e, graph.walk(e.where("entity_id = 1"), graph.neighbours(e, edges(spark, sf)), 2)


@query(f"WITH RECURSIVE {ENTITIES_SQL}, {WALK_SQL} SELECT key, depth FROM walk")
def graph_walk(spark, sf):
    return walked(spark, sf)[1]


@query(f"WITH RECURSIVE {ENTITIES_SQL}, {WALK_SQL} SELECT DISTINCT na AS src, relation, nb AS dst FROM named JOIN walk w ON ka = w.key JOIN walk x ON kb = x.key ORDER BY 1, 2, 3 LIMIT 60")
def graph_edges(spark, sf):
    e, reached = walked(spark, sf)
    return graph.edges_among(reached, e, edges(spark, sf))


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, {KEYWORD_SQL}, {ENTITIES_SQL}, cos AS (SELECT chunk_id, source_id, path, {COSINE_SQL} AS score FROM chunks), vec AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM cos QUALIFY rank <= 20),
lists AS (SELECT chunk_id, sum(1 / (60 + rank)) AS f, min(rank) AS best, count(*) AS n, min(l) AS l FROM (SELECT chunk_id, rank, 0 AS l FROM vec UNION ALL SELECT chunk_id, rank, 1 FROM keyword) GROUP BY chunk_id),
top AS (SELECT chunk_id FROM lists ORDER BY f DESC, best, chunk_id LIMIT 3),
steps AS (SELECT key, 0 AS depth FROM entities JOIN top ON entity_id = chunk_id UNION SELECT key, 0 FROM entities WHERE key = 'france' UNION SELECT b, depth + 1 FROM steps JOIN pairs ON a = key WHERE depth < 2),
walk AS (SELECT key, min(depth) AS depth FROM steps GROUP BY key ORDER BY 2, 1 LIMIT 40), reach AS (SELECT entity_id AS chunk_id, min(depth) AS depth FROM walk JOIN entities USING (key) GROUP BY 1)
SELECT chunk_id, path, round(s, 6) AS score, via FROM (SELECT c.chunk_id, c.path, CASE WHEN depth IS NOT NULL THEN 'graph' WHEN n > 1 THEN 'both' WHEN l = 0 THEN 'vector' ELSE 'keyword' END AS via,
  c.score + CASE depth WHEN 0 THEN 0.06 WHEN 1 THEN 0.04 WHEN 2 THEN 0.02 ELSE 0 END + coalesce(0.8 / (9 + k.rank), 0) + CASE source_id WHEN 'src0' THEN 0.03 ELSE 0 END AS s
  FROM cos c LEFT JOIN lists USING (chunk_id) LEFT JOIN reach USING (chunk_id) LEFT JOIN keyword k USING (chunk_id) WHERE n IS NOT NULL OR depth IS NOT NULL) ORDER BY s DESC, chunk_id LIMIT 10""")
def graph_search(spark, sf):
    e = entities(spark, sf)
    mentions = e.select("entity_id", F.col("entity_id").alias("chunk_id"))
    found = graph.graph_search(chunks(spark, sf), e, mentions, edges(spark, sf), VECTOR, TERMS, "Who sells in France?", 10, 2, ["src0"])
    return found.select("chunk_id", "path", F.round("score", 6).alias("score"), "via")


ORACLE_SQL["graph_search"] = ORACLE_SQL["graph_search"].replace("WHERE key = 'france'", "WHERE length(key) >= 4 AND contains('-who-sells-in-france-', '-' || key || '-')")


@query(f"WITH {ENTITIES_SQL} SELECT entity_id, key FROM entities")
def entity_key(spark, sf):
    return entities(spark, sf).select("entity_id", "key")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def orphan_entities(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders").where("o_totalprice > 400000")
    return graph.orphans(c.select(F.col("c_custkey").alias("entity_id")), o.select(F.col("o_custkey").alias("entity_id"))).select(F.col("entity_id").alias("c_custkey"))


@query("SELECT o_custkey, o_orderkey, n AS versions FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_version(spark, sf):
    return versions.latest(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS documents, count(*) AS versions FROM orders WHERE o_orderdate > DATE '1995-01-01' GROUP BY 1")
def live_counts(spark, sf):
    return versions.live_counts(t(spark, sf, "orders"), "o_orderstatus", "o_custkey", F.col("o_orderdate") > F.lit("1995-01-01").cast("date"))


@query("""WITH s AS (SELECT 'o' || o_custkey % 7 AS owner_oid, 'd' || o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders WHERE o_custkey % 5 = 0),
r AS (SELECT o_orderkey AS request_id, 'o' || o_custkey % 7 AS owner_oid, CASE WHEN o_orderkey % 3 > 0 THEN 'd' || o_custkey END AS document_id, (o_orderkey % 12)::INT AS base_version FROM orders),
d AS (SELECT owner_oid, document_id, max(version) AS last, count(*) AS n FROM s GROUP BY 1, 2), o AS (SELECT owner_oid, count(*) AS docs FROM d GROUP BY 1)
SELECT request_id, outcome, (CASE outcome WHEN 'created' THEN 1 WHEN 'saved' THEN last + 1 END)::INT AS next_version FROM (SELECT request_id, last, CASE WHEN r.document_id IS NULL THEN CASE WHEN coalesce(docs, 0) >= 50 THEN 'too many documents' ELSE 'created' END WHEN last IS NULL THEN 'not found' WHEN base_version <> last THEN 'stale' WHEN n >= 10 THEN 'too many versions' ELSE 'saved' END AS outcome
  FROM r LEFT JOIN d USING (owner_oid, document_id) LEFT JOIN o ON r.owner_oid = o.owner_oid)""")
def save_outcomes(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    named = o.select("*", F.concat(F.lit("o"), F.col("o_custkey") % 7).alias("owner_oid"), F.concat(F.lit("d"), "o_custkey").alias("document_id"))
    stored = versions.numbered(named.where("o_custkey % 5 = 0"), "document_id", [F.col("o_orderkey")]).select("owner_oid", "document_id", "version")
    requests = named.select(F.col("o_orderkey").alias("request_id"), "owner_oid", F.when(F.col("o_orderkey") % 3 > 0, F.col("document_id")).alias("document_id"), (F.col("o_orderkey") % 12).cast("int").alias("base_version"))
    return versions.save_outcome(requests, stored)


@query("SELECT doc_id, i AS line, x[i] AS content FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1))::INT AS i FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM documents))")
def numbered_lines(spark, sf):
    return versions.number_lines(t(spark, sf, "documents"), "doc_id", "text")


@query("""WITH i AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h, lang AS title, doc_id % 11 = 0 AS restricted FROM documents WHERE doc_id % 3 > 0),
s AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE lang END AS title FROM documents WHERE doc_id % 7 > 0)
SELECT coalesce(i.path, s.path) AS path, CASE WHEN i.path IS NULL THEN 'deleted' WHEN restricted THEN 'restricted' WHEN s.path IS NULL OR i.h <> s.h THEN 'changed' WHEN i.title <> s.title THEN 'metadata' ELSE 'unchanged' END AS action, s.path IS NOT NULL AS known FROM i FULL JOIN s ON i.path = s.path""")
def change_detect(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), "text", "lang")
    null = F.lit(None).cast("string").alias("url")
    items = d.where("doc_id % 3 > 0").select("path", F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("title"), null, (F.col("doc_id") % 11 == 0).alias("restricted"))
    stored = d.where("doc_id % 7 > 0").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"), F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("lang")).alias("title"), null)
    return ingest.changes(items, stored)


@query(f"SELECT count(*) FILTER (action = 'changed') AS changed, count(*) FILTER (action = 'metadata') AS metadata, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'restricted') AS restricted, count(*) FILTER (action = 'deleted' OR (action = 'restricted' AND known)) AS deleted FROM ({ORACLE_SQL['change_detect']})")
def ingest_counters(spark, sf):
    return ingest.counters(change_detect(spark, sf))


@query("SELECT doc_id, n_chars AS v FROM documents WHERE doc_id % 3 > 0 AND doc_id % 10 > 0 UNION ALL SELECT doc_id, -n_chars FROM documents WHERE doc_id % 10 = 0")
def replace_documents(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("v"))
    new = d.where("doc_id % 10 = 0").withColumn("v", -F.col("v"))
    return ingest.replace_documents(d.where("doc_id % 3 > 0"), new, new, ["doc_id"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 4 > 0) GROUP BY 1")
def cascade_delete(spark, sf):
    kept = t(spark, sf, "orders").where("o_custkey % 4 > 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return ingest.cascade(t(spark, sf, "lineitem").select("l_orderkey"), kept, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, source AS source_id, c AS classification_rank FROM documents JOIN (VALUES {CEILING_VALUES}) p(s, c) ON source = s")
def restamp(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id"), F.lit(0).alias("classification_rank"))
    return ingest.restamp(d, values(spark, CEILINGS, "source_id string, new_rank int")).select("doc_id", "source_id", "classification_rank")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NOT NULL THEN b.lang ELSE a.lang END AS lang FROM (SELECT * FROM documents WHERE doc_id % 3 < 2) a FULL JOIN (SELECT doc_id, upper(lang) AS lang FROM documents WHERE doc_id % 3 > 0) b ON a.doc_id = b.doc_id")
def upsert_merge(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang")
    return ingest.upsert(d.where("doc_id % 3 < 2"), d.where("doc_id % 3 > 0").withColumn("lang", F.upper("lang")), ["doc_id"], ["lang"])


@query("""SELECT source AS source_id, lang AS key, min_by('n' || doc_id, doc_id) AS name, min_by('t' || doc_id % 3, doc_id) AS type, arg_max(text, (length(text), -doc_id)) AS description FROM documents GROUP BY 1, 2""")
def longest_description(spark, sf):
    m = t(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("key"), F.concat(F.lit("n"), "doc_id").alias("name"), F.concat(F.lit("t"), F.col("doc_id") % 3).alias("type"), F.col("text").alias("description"), "doc_id")
    return graph.merge_entities(m, F.col("doc_id"))


@query("""SELECT source AS source_id, lang AS key, min_by('n' || doc_id, doc_id) AS name, min_by('t' || doc_id % 3, doc_id) AS type, max(length(text)) AS length, sha256(arg_max(text, (length(text), -doc_id))) AS description_hash FROM documents GROUP BY 1, 2""")
def longest_whole_description(spark, sf):
    """The whole text is the description; its length and hash come out."""
    m = t(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("key"), F.concat(F.lit("n"), "doc_id").alias("name"), F.concat(F.lit("t"), F.col("doc_id") % 3).alias("type"), F.col("text").alias("description"), "doc_id")
    return graph.merge_entities(m, F.col("doc_id")).select("source_id", "key", "name", "type", F.length("description").cast("long").alias("length"), F.sha2("description", 256).alias("description_hash"))


@query("""WITH k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT doc_id, (('0x' || substr(sha256(w), 1, 8))::BIGINT % 64)::INT AS idx, count(*) AS tf FROM k GROUP BY 1, 2)
SELECT doc_id, idx, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 9) AS weight FROM c""")
def hash_embedding(spark, sf):
    return ingest.hash_embedding(t(spark, sf, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 9))


@query(r"SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens, CASE WHEN length(f) > 60 THEN rtrim(left(f, 59), ' ') || '…' ELSE f END AS title, substr(sha256(lower('U' || doc_id)), 1, 32) AS user_key FROM (SELECT *, trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) AS f FROM documents)")
def scalar_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.title(F.col("text")).alias("title"), text.user_key(F.concat(F.lit("U"), "doc_id")).alias("user_key"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'HTTP' || regexp_replace(url, '^https?', '') WHEN 1 THEN 'ftp://a.b/c' WHEN 2 THEN url || '?a b' WHEN 3 THEN replace(url, 'https://', 'https://u@') WHEN 4 THEN url || chr(10) ELSE url END AS url FROM pages)
SELECT page_id, CASE WHEN page_id % 6 IN (0, 3, 5) THEN url END AS safe, page_id % 6 = 5 AND starts_with(url, 'https://') AND regexp_matches(lower(split_part(split_part(split_part(split_part(substring(url, 9), '/', 1), '?', 1), '#', 1), ':', 1)), '^(?:[^.]+\\.example\\.com)$') AS allowed FROM p""".replace("\\\\", "\\"))
def url_checks(spark, sf):
    k, u = F.col("page_id") % 6, F.col("url")
    forms = F.when(k == 0, F.concat(F.lit("HTTP"), F.regexp_replace(u, "^https?", ""))).when(k == 1, "ftp://a.b/c").when(k == 2, F.concat(u, F.lit("?a b"))).when(k == 3, F.replace(u, F.lit("https://"), F.lit("https://u@"))).when(k == 4, F.concat(u, F.lit("\n"))).otherwise(u)
    return t(spark, sf, "pages").select("page_id", forms.alias("url")).select("page_id", text.safe_url(u).alias("safe"), text.host_allowed(u, ["*.example.com"]).alias("allowed"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'media type' WHEN s_suppkey % 11 IN (0, 1) THEN 'name' WHEN s_suppkey % 3 = 0 THEN 'extension' WHEN s_suppkey % 5 = 0 THEN 'empty' WHEN s_suppkey % 7 = 0 THEN 'too large' END AS problem FROM supplier")
def artifact_validate(spark, sf):
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 11 == 0, "-").when(k % 11 == 1, "a..").otherwise("doc "), k, F.when(k % 3 == 0, ".exe").when(k % 2 == 0, ".Markdown").otherwise(".md"))
    size = F.when(k % 5 == 0, 0).when(k % 7 == 0, (1 << 20) + 1).otherwise(5)
    return t(spark, sf, "supplier").select("s_suppkey", text.artifact_problem(name, F.when(k % 4 == 0, "image/png").otherwise("text/markdown"), size).alias("problem"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(source || '/' || doc_id || '.md', '^(?:src1[^/]*/[^/]*\\.md)$') AND NOT regexp_matches(source || '/' || doc_id || '.md', '^(?:(?:.*/)?[^/]7\\.md)$')".replace("\\\\", "\\"))
def glob_select(spark, sf):
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md"))
    return t(spark, sf, "documents").where(text.selected(path, ["src1*/*.md"], ["**/?7.md"])).select("doc_id")


# Policy: customers are personas, of a team each; the team's segment gives roles.
def personas(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("persona"), F.concat(F.lit("team"), F.col("c_nationkey") % 5).alias("team"), F.col("c_mktsegment").alias("segment"))
    identities = c.select("persona", F.lit("group").alias("kind"), F.col("segment").alias("value"))
    return c, identities


BINDINGS = [("everyone", "*", "platform", "user"), ("group", "BUILDING", "platform", "editor"), ("group", "MACHINERY", "team1", "approver"), ("group", "AUTOMOBILE", "team2", "admin")]
INHERITS = [("admin", "approver"), ("approver", "editor"), ("editor", "reader")]
RANKS = [("user", 0), ("reader", 1), ("editor", 1), ("approver", 2), ("admin", 3)]
SOURCES = [("s1", "team1", 2), ("s2", "team2", 3), ("s3", "team3", 1)]
GRANTS = [("user", "ping", "allow"), ("editor", "write", "allow"), ("admin", "*", "allow"), ("approver", "ping", "deny")]
ACCESS = [("s1", "team", "team1"), ("s1", "team", "team4"), ("s2", "role", "editor"), ("s3", "everyone", "*")]
_v = lambda rows: ", ".join(str(tuple(r)) for r in rows)
ROLES_SQL = f"""who AS (SELECT c_custkey AS persona, 'team' || c_nationkey % 5 AS team, c_mktsegment AS segment FROM customer),
bindings(kind, value, scope, role) AS (VALUES {_v(BINDINGS)}), inherits(role, parent) AS (VALUES {_v(INHERITS)}), ranks(role, max_rank) AS (VALUES {_v(RANKS)}), sources(source_id, owner_team, rank) AS (VALUES {_v(SOURCES)}), grants(role, tool, effect) AS (VALUES {_v(GRANTS)}), access(source_id, kind, value) AS (VALUES {_v(ACCESS)}),
roles AS (SELECT persona, scope, role FROM who JOIN bindings ON kind = 'everyone' OR (kind = 'group' AND value = segment) UNION SELECT persona, scope, parent FROM roles JOIN inherits USING (role)),
ceil AS (SELECT w.persona, s.source_id, greatest(coalesce((SELECT max(max_rank) FROM roles r JOIN ranks USING (role) WHERE r.persona = w.persona AND r.scope = 'platform'), 0), coalesce((SELECT max(max_rank) FROM roles r JOIN ranks USING (role) WHERE r.persona = w.persona AND r.scope = s.owner_team), 0)) AS ceiling FROM who w, sources s),
tools AS (SELECT persona, n AS tool, count(*) FILTER (effect = 'deny') = 0 AS allowed FROM roles JOIN grants USING (role) JOIN (VALUES ('ping'), ('write'), ('admin')) x(n) ON tool = n OR tool = '*' GROUP BY 1, 2),
granted AS (SELECT persona, source_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (SELECT persona, source_id, 'team:' || value AS reason FROM who JOIN access ON kind = 'team' AND value = team UNION ALL
  SELECT persona, a.source_id, 'role:' || a.value FROM access a JOIN sources s ON a.source_id = s.source_id JOIN roles r ON a.kind = 'role' AND r.role = a.value AND r.scope = s.owner_team UNION ALL SELECT persona, source_id, 'everyone' FROM who, access WHERE kind = 'everyone') GROUP BY 1, 2)"""


def roles(spark, sf):
    return policy.scoped_roles(personas(spark, sf)[1], values(spark, BINDINGS, "kind string, value string, scope string, role string"), values(spark, INHERITS, "role string, parent string"), len(INHERITS))


def policy_tables(spark):
    return values(spark, SOURCES, "source_id string, owner_team string, rank int"), values(spark, RANKS, "role string, max_rank int"), values(spark, ACCESS, "source_id string, kind string, value string")


def tools(spark, sf):
    return policy.granted_tools(roles(spark, sf), values(spark, GRANTS, "role string, tool string, effect string"), values(spark, [("ping",), ("write",), ("admin",)], "tool string"))


@query(f"WITH RECURSIVE {ROLES_SQL} SELECT persona, scope, role FROM roles")
def policy_resolve(spark, sf):
    return roles(spark, sf)


@query(f"WITH RECURSIVE {ROLES_SQL} SELECT persona, source_id, ceiling FROM ceil")
def policy_ceilings(spark, sf):
    sources, ranks, _ = policy_tables(spark)
    return policy.ceilings(roles(spark, sf), ranks, sources, 0)


@query(f"WITH RECURSIVE {ROLES_SQL} SELECT g.persona, g.source_id, ceiling, reasons FROM granted g JOIN ceil c ON g.persona = c.persona AND g.source_id = c.source_id JOIN sources s ON g.source_id = s.source_id WHERE rank <= ceiling")
def readable_sources(spark, sf):
    sources, ranks, access = policy_tables(spark)
    r = roles(spark, sf)
    given = policy.source_grants(personas(spark, sf)[0].select("persona", "team"), r, sources, access)
    ok = policy.readable(given, policy.ceilings(r, ranks, sources, 0), sources)
    return ok.join(given, ["persona", "source_id"]).select("persona", "source_id", "ceiling", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH RECURSIVE {ROLES_SQL} SELECT persona, tool, allowed FROM tools")
def tool_grants(spark, sf):
    return tools(spark, sf)


@query(f"""WITH RECURSIVE {ROLES_SQL}, calls AS (SELECT o_orderkey AS call_id, o_custkey AS persona, CASE o_orderkey % 3 WHEN 0 THEN 'ping' WHEN 1 THEN 'write' ELSE 'admin' END AS tool, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders)
SELECT call_id, CASE WHEN allowed IS NULL THEN 'not granted' WHEN NOT allowed THEN 'denied' WHEN c.tool = 'write' AND status IS NULL THEN 'missing status' WHEN c.tool = 'write' AND status NOT IN ('O', 'F') THEN 'not allowed status' ELSE 'allow' END AS decision
FROM calls c LEFT JOIN tools t ON c.persona = t.persona AND c.tool = t.tool""")
def authorize_matrix(spark, sf):
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    calls = o.select(k.alias("call_id"), F.col("o_custkey").alias("persona"), F.when(k % 3 == 0, "ping").when(k % 3 == 1, "write").otherwise("admin").alias("tool"), F.when(k % 2 == 0, F.create_map(F.lit("status"), F.col("o_orderstatus"))).otherwise(F.create_map().cast("map<string,string>")).alias("args"))
    limits = personas(spark, sf)[0].select("persona", F.lit("write").alias("tool"), F.lit("status").alias("arg"), F.array(F.lit("O"), F.lit("F")).alias("allowed_values"))
    return policy.authorize(calls, tools(spark, sf), limits)


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN '+' WHEN b.c_custkey IS NULL THEN '-' ELSE '~' END AS change, a.v AS before, b.v AS after FROM (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 5 > 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NONE' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 > 0) b ON a.c_custkey = b.c_custkey WHERE a.v IS DISTINCT FROM b.v")
def permission_diff(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    return policy.differences(c.where("c_custkey % 5 > 0"), c.where("c_custkey % 7 > 0").withColumn("v", F.when(F.col("c_custkey") % 3 == 0, "NONE").otherwise(F.col("v"))), ["c_custkey"], "v")


@query("SELECT persona, coalesce(tool, '*') AS tool, coalesce(m, 120) AS per_minute FROM (SELECT c_custkey AS persona, c_nationkey % 5 AS n FROM customer) LEFT JOIN (VALUES (0, '*', 60), (0, '*', 90), (1, '*', 30)) l(n, tool, m0) USING (n), LATERAL (SELECT CASE n WHEN 0 THEN 90 WHEN 1 THEN 30 END AS m) GROUP BY ALL")
def rate_limits(spark, sf):
    members = personas(spark, sf)[0].select("persona", "team")
    return policy.rate_limits(members, values(spark, [("team0", "*", 60), ("team0", "*", 90), ("team1", "*", 30)], "team string, tool string, per_minute int"), 120)


@query("SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' ELSE 'mismatch' END AS problem FROM (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 9 > 0) a FULL JOIN (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 6 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 8 > 0) b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h")
def bundle_verify(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    changed = F.when(F.col("path") % 6 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return policy.verify_manifest(d.where("path % 9 > 0").select("path", F.sha2("text", 256).alias("sha256")), d.where("path % 8 > 0").select("path", F.sha2(changed, 256).alias("sha256")))


@query("""WITH h AS (SELECT event_type AS source_id, (user_id % 10)::VARCHAR AS path, event_id AS rank, CASE WHEN event_id % 3 > 0 THEN 'u' || event_id END AS url, event_id % 50 = 0 AS g FROM events), b AS (SELECT source_id, path, count(*) AS hits, min(rank) AS first, arg_min(url, rank) FILTER (url IS NOT NULL) AS url, bool_or(g) AS graph FROM h GROUP BY 1, 2)
SELECT source_id, path, hits, url, graph, (SELECT greatest(count(*) - 5, 0) FROM b)::BIGINT AS more FROM b ORDER BY first LIMIT 5""")
def citations_by_doc(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_type").alias("source_id"), (F.col("user_id") % 10).cast("string").alias("path"), F.col("event_id").alias("rank"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("u"), "event_id")).alias("url"), F.when(F.col("event_id") % 50 == 0, "graph").otherwise("vector").alias("via"))
    return rollups.citations(e, 5).withColumn("more", F.col("more").cast("long"))


@query("SELECT CASE l_linenumber % 4 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' WHEN 2 THEN 'nit' END AS severity, count(*) AS n, count(DISTINCT l_suppkey) AS lenses FROM lineitem WHERE l_linenumber % 4 < 3 GROUP BY 1")
def severity_rollup(spark, sf):
    n = F.col("l_linenumber") % 4
    found = t(spark, sf, "lineitem").select(F.when(n == 0, " Blocker").when(n == 1, "MAJOR").when(n == 2, "nit ").otherwise("other").alias("severity"), F.col("l_suppkey").alias("lens"), F.lit("t").alias("title"), F.lit("d").alias("detail"))
    return rollups.by_severity(rollups.clean_findings(found))


@query("""WITH f AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' ELSE 'nit' END AS severity, lang AS lens, source AS w FROM documents), m AS (SELECT min(o_orderkey) AS merge_id, o_custkey AS id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2),
g AS (SELECT f.*, coalesce('m' || merge_id % 40, 'f' || f.id) AS grp FROM f LEFT JOIN (SELECT id, min(merge_id % 40) AS merge_id FROM (SELECT o_custkey AS id, o_orderkey AS merge_id FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1) x ON f.id = x.id)
SELECT grp AS "group", arg_min(severity, CASE severity WHEN 'blocker' THEN 1 WHEN 'major' THEN 2 ELSE 3 END) AS severity, string_agg(DISTINCT lens, ',' ORDER BY lens) AS lenses, count(DISTINCT w) AS places, count(*) AS findings FROM g GROUP BY 1""")
def merge_findings(spark, sf):
    f = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.element_at(F.array(*[F.lit(s) for s in rollups.SEVERITIES]), (F.col("doc_id") % 3 + 1).cast("int")).alias("severity"), F.col("lang").alias("lens"), F.col("source").alias("where"))
    m = t(spark, sf, "orders").where("o_orderkey % 2 = 0").groupBy((F.col("o_orderkey") % 40).alias("merge_id")).agg(F.collect_set("o_custkey").alias("ids"))
    return rollups.merge_findings(f, m).select("group", "severity", F.array_join("lenses", ",").alias("lenses"), F.size(F.split("where", "; ")).cast("long").alias("places"), "findings")


@query("SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'blocked' WHEN c_custkey % 7 = 0 THEN 'not_configured' WHEN DATE '2024-01-01' + (c_custkey % 60)::INT < DATE '2024-01-20' THEN 'expired' WHEN c_custkey % 2 = 0 AND (c_custkey % 3 = 0 OR DATE '2023-12-15' + (c_custkey % 40)::INT < DATE '2024-01-06') THEN 'rejected' END AS problem FROM customer")
def reconcile_connections(spark, sf):
    k = F.col("c_custkey")
    day = lambda base, n: F.date_add(F.lit(base).cast("date"), (k % n).cast("int")).cast("string")
    c = t(spark, sf, "customer").select("c_custkey", (k % 11 == 0).alias("blocked"), (k % 7 != 0).alias("configured"), day("2024-01-01", 60).alias("expires_at"), F.when(k % 2 == 0, "bad").otherwise("ok").alias("status"), F.when(k % 3 == 0, "?").otherwise(day("2023-12-15", 40)).alias("verified_at"))
    return c.select("c_custkey", rollups.connection_problem(F.lit("2024-01-20").cast("date")).alias("problem"))


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING max(event_id) < 9900)")
def retention_purge(spark, sf):
    e = t(spark, sf, "events")
    return rollups.purge(e.select("event_id", "user_id"), e, "user_id", F.lit(9900), "event_id").select("event_id")


@query(r"WITH c AS (SELECT conv_id, max(turn) AS turns, arg_min(text, turn) FILTER (role = 'user') AS f FROM conversations GROUP BY 1 ORDER BY 1 DESC LIMIT 60), z AS (SELECT conv_id, turns, trim(regexp_replace(coalesce(f, ''), '[\s\x0b]+', ' ', 'g')) AS f FROM c) SELECT conv_id, turns, CASE WHEN length(f) > 60 THEN rtrim(left(f, 59), ' ') || '…' ELSE f END AS title FROM z WHERE f <> '' ORDER BY 1 DESC LIMIT 30")
def thread_list(spark, sf):
    return rollups.threads(t(spark, sf, "conversations"), text.title(F.col("first")))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def sliding_call_count(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rollups.calls_in_window(e, 60).select("event_id", "recent")


@query("SELECT event_id AS call_id, CASE WHEN event_id % 13 = 0 THEN 'unauthenticated' WHEN event_id % 5 = 0 THEN 'deny' WHEN event_id % 7 = 0 THEN 'rate_limited' WHEN value > 90 THEN 'error' WHEN value > 80 THEN 'tool_error' ELSE 'ok' END AS outcome FROM events")
def call_outcomes(spark, sf):
    k = F.col("event_id")
    e = t(spark, sf, "events").select(k.alias("call_id"), F.when(k % 13 != 0, F.col("user_id")).alias("oid"), F.when(k % 5 == 0, "deny").otherwise("allow").alias("decision"), (k % 7 != 0).alias("within_rate"), (F.col("value") > 90).alias("failed"), (F.col("value") > 80).alias("tool_failed"))
    return rollups.call_outcomes(e)


METRICS_SQL = """WITH v AS (SELECT vec_id AS doc, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
r AS (SELECT q.doc AS q, q.label AS label, d.doc, d.label AS dl, row_number() OVER (PARTITION BY q.doc ORDER BY coalesce(round(list_dot_product(q.v, d.v) / nullif(sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v)), 0), 9), -2) DESC, d.doc) AS rank FROM v q JOIN v d ON q.doc <> d.doc WHERE q.doc % 50 = 0),
e AS (SELECT q, label, avg((rank <= 3)::INT) AS r3, avg((rank <= 5)::INT) AS r5, avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END) AS rr FROM r WHERE dl = label GROUP BY 1, 2)
SELECT label, count(*) AS questions, round(avg(r3), 9) AS recall_3, round(avg(r5), 9) AS recall_5, round(avg(rr), 9) AS mrr FROM e GROUP BY 1"""


@query(METRICS_SQL)
def retrieval_metrics(spark, sf):
    """Every vector with an id divisible by 50 asks all others; expected are all others of its label."""
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), "label", F.col("embedding").alias("v"))
    q = e.where("doc % 50 = 0").withColumnRenamed("doc", "q")
    expected = e.select("doc", "label").join(q.select("q", "label"), "label").where("doc <> q").select("q", "doc", "label")
    m = retrieval.retrieval_metrics(retrieval.neighbours_of(e, q, 10), expected, ["label"])
    return m.select("label", "questions", *[F.round(c, 9).alias(c) for c in ("recall_3", "recall_5", "mrr")])


@query(METRICS_SQL)
def retrieval_metrics_all(spark, sf):
    """The same, under the name that it had while retrieval_metrics asked twenty questions."""
    return retrieval_metrics(spark, sf)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def set_difference(spark, sf):
    return rollups.uncovered(t(spark, sf, "part").select(F.col("p_partkey").alias("requirement")), t(spark, sf, "lineitem").where("l_quantity > 48").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("satisfies"))).select(F.col("requirement").alias("p_partkey"))


@query()
def chunk_fixed(spark, sf):
    return chunking.chunk(t(spark, sf, "documents"), "doc_id")


@query()
def html_to_markdown(spark, sf):
    return t(spark, sf, "pages").select("page_id", markup.html_markdown(F.col("html")).alias("markdown"))


@query()
def chunk_markdown(spark, sf):
    return chunking.chunk(html_to_markdown(spark, sf), "page_id", "markdown", strategy="markdown")


@query()
def rate_limit(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_id").alias("call_id"), "user_id", F.col("event_type").alias("tool"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return limiter.limit_calls(e, {"*": 3, "purchase": 1})
