"""Queries of the stored indexes, the store and the whole graph answer, each with its SQL. The index is written from the whole table, and searched with every document whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import extraction, graph, keyword_index, scope, store, vector_index
from ..session import materialize, scratch
from ..sources import loaders
from ..streaming import ingest as stream
from .queries import CEILING_VALUES, CEILINGS, CHUNKS_SQL, COSINE_SQL, ENTITIES_SQL, KEYWORD_SQL, ORACLE_SQL, TERMS, VECTOR, chunks, docs, edges, entities, query, t, values

WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
#: Letters of a word that is searched for beside the identifiers.
LONG = 10
#: Identifier terms and long words of the searching documents, one to a row.
ASKED_SQL = ORACLE_SQL["keyword_terms"].replace("SELECT doc_id, count(*)::INT AS n, string_agg(w, ' ' ORDER BY i) AS terms FROM (", "SELECT doc_id AS search, w FROM (", 1).replace("WHERE k <= 12 GROUP BY doc_id", "WHERE k <= 12 AND doc_id % 50 = 0")
LONG_SQL = f"SELECT doc_id, unnest(list_sort(list_distinct(list_filter({WORDS.format("text")}, lambda x: length(x) >= {LONG})))[1:12]) FROM documents WHERE doc_id % 50 = 0"


@query(rf"""WITH asked AS ({ASKED_SQL} UNION ALL {LONG_SQL}),
permitted AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS content FROM documents JOIN (VALUES {CEILING_VALUES}) p(s, c) ON source = s AND doc_id % 4 <= c),
placed AS (SELECT chunk_id, unnest(x) AS token, unnest(range(len(x))) AS place FROM (SELECT chunk_id, {WORDS.format("content")} AS x FROM permitted)),
phrase AS (SELECT DISTINCT search, p FROM (SELECT search, {WORDS.format("w")} AS p FROM asked) WHERE len(p) > 0),
word AS (SELECT search, p, unnest(p) AS token, unnest(range(len(p))) AS nth FROM phrase),
win AS (SELECT search, chunk_id, place - nth AS a, place - nth + len(p) - 1 AS z FROM word JOIN placed USING (token) GROUP BY search, chunk_id, p, place - nth HAVING count(*) = len(p)),
shortest AS (SELECT search, chunk_id, z, max(a) AS a FROM win GROUP BY ALL),
cover AS (SELECT search, chunk_id, a > coalesce(max(a) OVER (PARTITION BY search, chunk_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_cover FROM shortest),
n AS (SELECT search, chunk_id, count(*)::INT AS covers FROM cover WHERE is_cover GROUP BY ALL)
SELECT search, chunk_id, covers, round(covers * 0.1, 6)::DOUBLE AS keyword_score, (row_number() OVER (PARTITION BY search ORDER BY covers DESC, chunk_id))::INT AS rank FROM n QUALIFY rank <= 20""")
def keyword_index_search(spark, sf):
    chunks = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "source_id", "classification_rank", F.col("text").alias("content"))
    folder = keyword_index.write_index(chunks)
    long_words = F.slice(F.array_sort(F.array_distinct(F.filter(text.simple_tokens(F.col("text")), lambda w: F.length(w) >= LONG))), 1, text.MAX_TERMS)
    searches = t(spark, sf, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("search"), F.concat(text.identifier_terms(F.col("text")), long_words).alias("terms"))
    searches = materialize(searches, "searches")
    index = keyword_index.read_index(spark, folder, F.broadcast(values(spark, CEILINGS, "source_id string, ceiling int")))
    asked = materialize(keyword_index.asked_of(index, searches), "asked")
    return keyword_index.search(asked, searches).select("search", "chunk_id", "covers", F.round("keyword_score", 6).alias("keyword_score"), "rank")


@query()
def vector_index_search(spark, sf):
    """The ten best permitted chunks for every vector whose id is divisible by 50, from as many lists as measurement asks for; its recall is tested against brute force."""
    ranked = t(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("source_id"), F.pmod("doc_id", F.lit(4)).alias("classification_rank"))
    chunks = t(spark, sf, "embeddings").join(ranked, "vec_id").select(F.col("vec_id").alias("chunk_id"), "source_id", F.col("classification_rank").cast("int").alias("classification_rank"), "embedding")
    folder = vector_index.write_index(chunks)
    searches = t(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("search"), F.col("embedding").alias("vector"))
    policy = values(spark, CEILINGS, "source_id string, ceiling int")
    found = vector_index.search(spark, folder, searches, policy, opened=vector_index.opened_for(spark, folder, searches, policy))
    return found.select("search", F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


SCHEMAS = {
    "documents": "document_id long, source_id string, path string",
    "chunks": "chunk_id long, document_id long, source_id string",
    "entities": "entity_id long, source_id string, key string",
    "mentions": "entity_id long, chunk_id long, source_id string",
    "edges": "src_id long, dst_id long, relation string, chunk_id long, source_id string",
}


@query("""WITH d AS (SELECT doc_id AS document_id, source AS source_id FROM documents WHERE source IS NOT NULL AND doc_id % 3 <> 0),
c AS (SELECT document_id AS chunk_id, source_id, substr(source_id, 4)::BIGINT * 100 AS base, label FROM d JOIN embeddings ON vec_id = document_id),
m AS (SELECT base + label AS entity_id, chunk_id, source_id FROM c UNION SELECT base + (label + 1) % 10, chunk_id, source_id FROM c),
rows AS (SELECT 'documents' AS "table", source_id, document_id AS id FROM d UNION ALL SELECT 'chunks', source_id, chunk_id FROM c UNION ALL SELECT DISTINCT 'entities', source_id, entity_id FROM m
  UNION ALL SELECT 'mentions', source_id, chunk_id FROM m UNION ALL SELECT 'edges', source_id, base + label FROM c)
SELECT "table", source_id, count(*) AS n, sum(id)::BIGINT AS ids FROM rows GROUP BY ALL""")
def store_deletes(spark, sf):
    """All documents with chunks, entities, mentions and edges are written, then every third document is deleted with what hangs on it: what the store holds after that."""
    d = t(spark, sf, "documents").where("source is not null").select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_id"), F.concat_ws("/", "source", "doc_id").alias("path"))
    c = d.join(t(spark, sf, "embeddings").withColumnRenamed("vec_id", "document_id"), "document_id").select(F.col("document_id").alias("chunk_id"), "document_id", "source_id", (F.substr("source_id", F.lit(4)).cast("long") * 100).alias("base"), "label")
    mentions = c.select(F.explode(F.array(F.col("base") + F.col("label"), F.col("base") + (F.col("label") + 1) % 10)).alias("entity_id"), "chunk_id", "source_id").distinct()
    entities = mentions.select("entity_id", "source_id", F.col("entity_id").cast("string").alias("key")).distinct()
    edges = c.select((F.col("base") + F.col("label")).alias("src_id"), (F.col("base") + (F.col("label") + 1) % 10).alias("dst_id"), F.lit("near").alias("relation"), "chunk_id", "source_id")
    root = scratch(spark, "store")
    store.replace_documents(spark, root, SCHEMAS, d.select("source_id", "path").limit(0), {"documents": d, "chunks": c, "entities": entities, "mentions": mentions, "edges": edges})
    store.replace_documents(spark, root, SCHEMAS, d.where("document_id % 3 = 0").select("source_id", "path"))
    key = {"documents": "document_id", "chunks": "chunk_id", "entities": "entity_id", "mentions": "chunk_id", "edges": "src_id"}
    held = [store.read(spark, root, name, SCHEMAS[name]).select(F.lit(name).alias("table"), "source_id", F.col(key[name]).alias("id")) for name in store.TABLES]
    whole = held[0]
    for each in held[1:]:
        whole = whole.unionByName(each)
    return whole.groupBy("table", "source_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


QUESTION = "Which supplier is in France, and what is part of Europe?"


@query(rf"""WITH RECURSIVE {CHUNKS_SQL.replace("source || '/' || doc_id AS path", "source || '/' || (doc_id // 3) AS path")}, {KEYWORD_SQL}, {ENTITIES_SQL},
own AS (SELECT entity_id + 10000000000 * n AS id, entity_id AS base, name, key, 'src' || n AS source_id, CASE WHEN entity_id >= 2000000000 THEN 'region' WHEN entity_id >= 1000000000 THEN 'nation' ELSE 'supplier' END AS type FROM entities, (VALUES (0), (1)) v(n)),
cos AS (SELECT chunk_id, source_id, path, {COSINE_SQL} AS score FROM chunks), vec AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM cos QUALIFY rank <= 20),
lists AS (SELECT chunk_id, sum(1 / (60 + rank)) AS f, min(rank) AS best, count(*) AS n, min(l) AS l FROM (SELECT chunk_id, rank, 0 AS l FROM vec UNION ALL SELECT chunk_id, rank, 1 FROM keyword) GROUP BY chunk_id),
top AS (SELECT chunk_id FROM lists ORDER BY f DESC, best, chunk_id LIMIT 3),
seeds AS (SELECT key FROM own JOIN top ON base = chunk_id UNION SELECT key FROM own WHERE length(key) >= 4 AND contains('-which-supplier-is-in-france-and-what-is-part-of-europe-', '-' || key || '-')),
steps AS (SELECT key, 0 AS depth FROM seeds UNION SELECT b, depth + 1 FROM steps JOIN pairs ON a = key WHERE depth < 2),
walk AS (SELECT key, min(depth) AS depth FROM steps GROUP BY key ORDER BY 2, 1 LIMIT 40), reach AS (SELECT base AS chunk_id, min(depth) AS depth FROM walk JOIN own USING (key) GROUP BY 1),
scored AS (SELECT c.chunk_id, c.path, c.source_id, CASE WHEN depth IS NOT NULL THEN 'graph' WHEN n > 1 THEN 'both' WHEN l = 0 THEN 'vector' ELSE 'keyword' END AS via,
  c.score + CASE depth WHEN 0 THEN 0.06 WHEN 1 THEN 0.04 WHEN 2 THEN 0.02 ELSE 0 END + coalesce(0.8 / (9 + k.rank), 0) + CASE c.source_id WHEN 'src0' THEN 0.03 ELSE 0 END AS s
  FROM cos c LEFT JOIN lists USING (chunk_id) LEFT JOIN reach USING (chunk_id) LEFT JOIN keyword k USING (chunk_id) WHERE n IS NOT NULL OR depth IS NOT NULL),
hits AS (SELECT * FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY source_id, path ORDER BY s DESC, chunk_id) = 1) ORDER BY s DESC, chunk_id LIMIT 20),
rel AS (SELECT DISTINCT na, relation, nb, 'src' || n AS source_id FROM named JOIN walk w ON ka = w.key JOIN walk x ON kb = x.key, (VALUES (0), (1)) v(n) ORDER BY 1, 2, 3, 4 LIMIT 60)
SELECT 'result' AS part, (row_number() OVER (ORDER BY s DESC, chunk_id) - 1)::INT AS place, path AS name, via AS kind, source_id AS source, NULL AS target, round(s, 4) AS value FROM hits
UNION ALL SELECT 'seed', (row_number() OVER (ORDER BY key) - 1)::INT, key, NULL, NULL, NULL, NULL FROM seeds
UNION ALL SELECT 'entity', (row_number() OVER (ORDER BY key, source_id, id) - 1)::INT AS place, name, type, source_id, NULL, depth FROM own JOIN walk USING (key) QUALIFY place < 40
UNION ALL SELECT 'relation', (row_number() OVER (ORDER BY na, relation, nb, source_id) - 1)::INT, na, relation, source_id, nb, NULL FROM rel""")
def graph_answer(spark, sf):
    """The whole answer to a question, one row a part: documents of up to three chunks, two sources with the same edges, and a third that the caller may not read."""
    policy = values(spark, CEILINGS, "source_id string, ceiling int")
    three = values(spark, [(0, "src0"), (1, "src1"), (9, "src9")], "n long, source_id string")
    kind = F.when(F.col("entity_id") >= 2 * 10**9, "region").when(F.col("entity_id") >= 10**9, "nation").otherwise("supplier")
    shift = lambda c: (F.col(c) + F.col("n") * 10**10).alias(c)
    permitted = lambda df: scope.scoped(df.withColumn("classification_rank", F.lit(0)), policy)
    e = permitted(entities(spark, sf).crossJoin(F.broadcast(three)).select(shift("entity_id"), F.col("entity_id").alias("base"), "name", "key", "source_id", kind.alias("type"), F.lit(None).cast("string").alias("description")))
    links = permitted(edges(spark, sf).crossJoin(F.broadcast(three)).select(shift("src_id"), shift("dst_id"), "relation", "source_id"))
    pieces = chunks(spark, sf).withColumn("path", F.concat_ws("/", "source_id", F.floor(F.col("chunk_id") / 3)))
    found = graph.answer(pieces, e, e.select("entity_id", F.col("base").alias("chunk_id")), links, VECTOR, TERMS, QUESTION, 50, 2, ["src0"])
    none = F.lit(None).cast("string")
    parts = []
    for name, column, fields in (
        ("result", "results", ("c.path", "c.via", "c.source", none, "c.score")),
        ("seed", "seeds", ("c", none, none, none, F.lit(None))),
        ("entity", "entities", ("c.name", "c.type", "c.source", none, "c.hops")),
        ("relation", "relations", ("c.from", "c.relation", "c.source", "c.to", F.lit(None))),
    ):
        each = found.select(F.posexplode(column).alias("place", "c"))
        cells = [F.col(f) if isinstance(f, str) else f for f in fields]
        parts.append(each.select(F.lit(name).alias("part"), "place", *[x.alias(n) for x, n in zip(cells[:4], ("name", "kind", "source", "target"))], cells[4].cast("double").alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


VOCABULARY = {"the": "article", "data": "noun", "water": "noun", "model": "noun"}


class Flaky(extraction.Vocabulary):
    """A vocabulary that gives no answer to texts whose length is a multiple of 7."""

    def __call__(self, text: str) -> str:
        return super().__call__(text) if len(text) % 7 else "no answer"


@query(rf"""WITH d AS (SELECT source AS source_id, doc_id // 5 AS path, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, length(t) % 7 = 0 AS bad, {" + ".join(rf"regexp_matches(lower(t), '(^|[^a-z0-9_-]){w}($|[^a-z0-9_-])')::INT" for w in VOCABULARY)} AS n FROM d)
SELECT source_id, path, count(*) AS chunks, count_if(bad) AS n_failed, CASE WHEN bool_or(bad) THEN NULL ELSE sum(n)::BIGINT END AS entities,
  (SELECT count(DISTINCT t) FROM e) AS asked, (SELECT count(DISTINCT t) FROM e WHERE bad) AS asked_again FROM e GROUP BY source_id, path""")
def extraction_misses(spark, sf):
    """All documents go through an extractor that fails for some, twice: the second run asks for the failed texts only, and documents with a failed one are held back."""
    d = t(spark, sf, "documents").select(F.col("source").alias("source_id"), F.floor(F.col("doc_id") / 5).cast("string").alias("path"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    cache = scratch(spark, "extractions") + "/cache"
    runs = [extraction.extract(d, cache, Flaky(VOCABULARY), "1", "vocabulary", sorted(set(VOCABULARY.values())), []) for _ in range(2)]
    n = F.count("*").alias("chunks")
    good = runs[1].found.groupBy("source_id", "path").agg(n, F.lit(0).cast("long").alias("n_failed"), F.sum(F.size("entities")).alias("entities"))
    whole = d.groupBy("source_id", "path").agg(n)
    same = whole["source_id"].eqNullSafe(runs[1].failed["source_id"]) & whole["path"].eqNullSafe(runs[1].failed["path"])
    bad = whole.join(runs[1].failed, same).select(whole["source_id"], whole["path"], "chunks", "n_failed", F.lit(None).cast("long").alias("entities"))
    return good.unionByName(bad).withColumns({"path": F.col("path").cast("long"), "asked": F.lit(runs[0].asked).cast("long"), "asked_again": F.lit(runs[1].asked).cast("long")})


@query("""WITH d AS (SELECT source AS source_id, doc_id, coalesce(text, '') AS text FROM documents WHERE source IS NOT NULL),
s AS (SELECT *, doc_id % 10 = 0 AS gone, doc_id % 10 = 1 AND source_id <> 'src1' AS edited, doc_id % 10 = 2 AS renamed FROM d)
SELECT source_id, count(*) FILTER (NOT (gone AND source_id NOT IN ('src1', 'src2'))) AS documents,
  count(*) FILTER (edited) AS edited, count(*) FILTER (renamed AND source_id <> 'src1') AS renamed,
  CASE source_id WHEN 'src1' THEN 'one' WHEN 'src2' THEN 'one' ELSE 'two' END AS cursor FROM s GROUP BY source_id""")
def ingest_batches(spark, sf):
    """All documents come in one batch, then every tenth is gone, edited or renamed in a second one, which is run twice; src1's second listing fails, src2's has no end."""
    d = t(spark, sf, "documents").where("source IS NOT NULL").select(F.col("source").alias("source_id"), "doc_id", "text")
    item = lambda df, text, title: df.select("source_id", F.lit("item").alias("kind"), F.concat("doc_id", F.lit(".md")).alias("path"), F.sha2(text, 256).alias("content_hash"), F.lit("text/markdown").alias("media_type"), title.alias("title"), F.lit(None).cast("string").alias("url"), F.lit(False).alias("restricted"), text.alias("text"), F.lit(None).cast("string").alias("cursor"))
    body, at = F.coalesce("text", F.lit("")), F.col("doc_id") % 10
    sources = d.select("source_id").distinct()
    note = lambda df, kind, cursor: df.select("source_id", *[F.lit({"kind": kind, "cursor": cursor}.get(n)).cast(k).alias(n) for n, k in (x.split() for x in stream.FOUND.split(", ")[1:])])
    first = item(d, body, F.lit("a")).unionByName(note(sources, "end", "one"))
    later = item(d.where(at != 0), F.concat(body, F.when(at == 1, "\nedited").otherwise("")), F.when(at == 2, "b").otherwise("a"))
    ends = note(sources.where("source_id NOT IN ('src1', 'src2')"), "end", "two").unionByName(note(sources.where("source_id = 'src1'"), "error", None))
    root = scratch(spark, "ingest")
    for number, batch in ((0, first), (1, later.unionByName(ends)), (1, first)):
        stream.apply(spark, root, batch, "documents", number)
    held = store.read(spark, root, store.DOCUMENTS, stream.SCHEMAS[store.DOCUMENTS])
    ends_edited = store.read(spark, root, store.CHUNKS, stream.SCHEMAS[store.CHUNKS]).where(F.col("content").endswith("edited")).select("document_id").distinct().withColumn("e", F.lit(1))
    marks = store.marks(spark, root)
    cursors = values(spark, [(k[7:], v) for k, v in marks.items() if k.startswith("cursor ")], "source_id string, cursor string")
    n = held.join(ends_edited, "document_id", "left").groupBy("source_id").agg(F.count("*").alias("documents"), F.count("e").alias("edited"), F.count_if(F.col("title") == "b").alias("renamed"))
    return cursors.join(n, "source_id", "left").fillna(0)


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN '{"n":' || user_id || '}' WHEN 1 THEN '{"n":' || user_id || ',"result":{}}' WHEN 2 THEN '{"n":' || user_id || '}'
  WHEN 4 THEN '{"n":' || user_id || ',"structuredContent":null}' END AS payload FROM events""")
def tool_payloads(spark, sf):
    """A tool's response for every event, in seven forms: a result alone, a result among others, JSON in a text, a text that is none, the object itself, broken JSON, an array."""
    n = lambda before, after: F.concat(F.lit(before), F.col("user_id").cast("string"), F.lit(after))
    forms = [
        n('{"structuredContent": {"result": {"n": ', "}}}"),
        n('{"structuredContent": {"result": {}, "n": ', "}}"),
        n('{"content": [{"type": "image"}, {"text": 1}, {"text": "{\\"n\\": ', '}"}, {"text": "{}"}]}'),
        n('{"content": [{"text": "seen ', ' times"}, {"text": "{}"}]}'),
        n('{"structuredContent": null, "n": ', "}"),
        n('{"n": ', ""),
        n("[", "]"),
    ]
    raw = F.get(F.array(*forms), (F.col("event_id") % 7).cast("int"))
    return t(spark, sf, "events").select("event_id", F.to_json(text.tool_payload(raw)).alias("payload"))


WORDS_OF = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))"


def _words_of():
    return F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))


def _exported(spark, made):
    folder = scratch(spark, "export")
    made.select(F.to_json("o").alias("value")).write.mode("append").text(folder)
    return folder


@query(rf"""WITH d AS (SELECT doc_id, {WORDS_OF} AS words, doc_id % 23 = 0 OR doc_id % 31 = 0 AS own, CASE WHEN doc_id % 10 > 0 THEN doc_id - doc_id % 10 END AS parent FROM documents),
told AS (SELECT d.*, d.own OR (d.parent IS NOT NULL AND coalesce(p.own, true)) AS restricted FROM d LEFT JOIN d p ON p.doc_id = d.parent),
made AS (SELECT *, '# Page ' || doc_id || chr(10) || chr(10) || CASE WHEN parent IS NOT NULL THEN 'Path: Page ' || parent || ' > Page ' || doc_id || chr(10) || chr(10) ELSE '' END || words AS body FROM told)
SELECT 'DOCS/' || doc_id AS path, CASE WHEN restricted THEN '' ELSE sha256(body) END AS content_hash, CASE WHEN NOT restricted THEN 'Page ' || doc_id END AS title, CASE WHEN NOT restricted THEN 'https://wiki.example.org/pages/' || doc_id END AS url, restricted
FROM made WHERE restricted OR (doc_id % 3 > 0 AND strlen(body) <= 1000000)""")
def wiki_pages(spark, sf):
    """Every document as a page of an export, under a cursor that knows a third of them; pages below restricted ones are restricted too."""
    k = F.col("doc_id")
    parent = F.when(k % 10 > 0, (k - k % 10).cast("string"))
    read = F.struct(F.struct(F.struct(F.when(k % 23 == 0, F.array(F.lit("someone"))).otherwise(F.array().cast("array<string>")).alias("results")).alias("user")).alias("restrictions"))
    page = F.struct(
        k.cast("string").alias("id"), F.concat(F.lit("Page "), k).alias("title"), F.struct((k % 7).cast("long").alias("number")).alias("version"),
        F.when(parent.isNotNull(), F.array(F.struct(parent.alias("id"), F.concat(F.lit("Page "), parent).alias("title")))).alias("ancestors"), F.when(k % 31 > 0, F.struct(read.alias("read"))).alias("restrictions"),
        F.struct(F.struct(F.concat(F.lit("<p>"), _words_of(), F.lit("</p>")).alias("value")).alias("storage")).alias("body"), F.struct(F.concat(F.lit("/pages/"), k).alias("webui")).alias("_links"))
    source = loaders.Source("confluence", _exported(spark, t(spark, sf, "documents").select(page.alias("o"))), options={"space": "DOCS", "web": "https://wiki.example.org"})
    known = t(spark, sf, "documents").where(k % 3 < 2).select(F.lit(loaders.selection(source)).alias("selection"), F.concat(F.lit("DOCS/"), k).alias("path"), F.when(k % 3 == 0, k % 7).otherwise(99).cast("string").alias("generation"))
    return loaders.load(spark, source, known).items.select("path", "content_hash", "title", "url", "restricted")


@query(rf"""WITH made AS (SELECT doc_id, doc_id % 19 = 0 AS restricted, '# DOC-' || doc_id || ': Issue ' || doc_id || chr(10) || chr(10) || concat_ws(' · ', 'Type: ' || nullif(source, ''), 'Status: ' || nullif(lang, '')) || CASE WHEN nullif(source, '') IS NULL AND nullif(lang, '') IS NULL THEN '' ELSE chr(10) END
|| 'Components: c' || doc_id % 4 || ', c' || doc_id % 5 || chr(10) || 'Labels: l' || doc_id % 3 || chr(10) || 'Links: ' || CASE WHEN doc_id % 2 = 0 THEN 'blocks' ELSE 'is blocked by' END || ' DOC-' || doc_id // 2 || chr(10)
|| CASE WHEN {WORDS_OF} <> '' THEN chr(10) || '## Description' || chr(10) || chr(10) || {WORDS_OF} || chr(10) ELSE '' END AS body FROM documents)
SELECT 'DOC-' || doc_id AS path, CASE WHEN restricted THEN '' ELSE sha256(body) END AS content_hash, CASE WHEN NOT restricted THEN 'DOC-' || doc_id || ': Issue ' || doc_id END AS title, restricted
FROM made WHERE restricted OR (doc_id % 4 > 0 AND strlen(body) <= 1000000)""")
def tracker_issues(spark, sf):
    """Every document as an issue of an export, under a cursor that knows a quarter of them."""
    k = F.col("doc_id")
    name = lambda c: F.struct(c.alias("name"))
    other = F.struct(F.concat(F.lit("DOC-"), F.floor(k / 2)).alias("key"))
    link = F.struct(F.struct(F.lit("blocks").alias("outward"), F.lit("is blocked by").alias("inward")).alias("type"), F.when(k % 2 == 0, other).alias("outwardIssue"), F.when(k % 2 == 1, other).alias("inwardIssue"))
    fields = F.struct(
        F.concat(F.lit("Issue "), k).alias("summary"), F.concat(F.lit("u"), k % 5).alias("updated"), F.when(k % 19 == 0, name(F.lit("internal"))).alias("security"), name(F.col("source")).alias("issuetype"), F.col("lang").alias("status"),
        F.array(name(F.concat(F.lit("c"), k % 4)), name(F.concat(F.lit("c"), k % 5))).alias("components"), F.array(F.concat(F.lit("l"), k % 3)).alias("labels"), F.array(link).alias("issuelinks"), _words_of().alias("description"))
    source = loaders.Source("jira", _exported(spark, t(spark, sf, "documents").select(F.struct(F.concat(F.lit("DOC-"), k).alias("key"), fields.alias("fields")).alias("o"))), options={"edition": "server"})
    known = t(spark, sf, "documents").where(k % 4 == 0).select(F.lit(loaders.selection(source)).alias("selection"), F.concat(F.lit("DOC-"), k).alias("path"), F.concat(F.lit("u"), k % 5).alias("generation"))
    return loaders.load(spark, source, known).items.select("path", "content_hash", "title", "restricted")
