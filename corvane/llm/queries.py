"""The registered queries opN_<name> and their SQL. Each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import infill, langid, lm, mixing, negatives, packing, pii, quality, search, secrets, simhash, toxicity, warc
from .common import n_words
from ..session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    scores = F.array_join(F.transform("pii", lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.join_spans(base), 256).alias("base_sha256"), pii.join_spans(F.col("pii")).alias("spans"), scores.alias("scores"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = warc.new_folder(spark)
    records = warc.read(warc.write(pages, folder), folder, payloads=False)
    return records.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url", "intact")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, keep_text=False).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_held_out(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("__n"))
    return mixing.mix(materialize(sized, "sized"), size="__n").select("doc_id", "size", "source_size", "target", "taken")


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.where("doc_id % 50 = 0")).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(materialize(pieces, "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, drop=("text",))
    base = [r.name for r in secrets.RULES if r.base]
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(secrets.join_spans(F.filter("secrets", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"), secrets.join_spans(F.col("secrets")).alias("spans"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.assess(docs, labels, drop=("text",)).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rebuilt = infill.restore(F.col("output"), F.col("form"))
    return infill.transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    steps = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return negatives.mine(rows.select("vec_id", label.alias("label"), steps.alias("embedding")), F.col("vec_id") % 50 == 0, "vec_id", "label", "embedding")


QUERIES = {"op1_warc": op1_warc, "op2_simhash": op2_simhash, "op3_quality": op3_quality, "op4_lm": op4_lm, "op5_mixing": op5_mixing, "op6_search": op6_search, "op7_pii": op7_pii, "op8_packing": op8_packing, "op9_langid": op9_langid, "op10_secrets": op10_secrets, "op11_toxicity": op11_toxicity, "op12_infill": op12_infill, "op13_negatives": op13_negatives}

BLANK = r"[\x20\x09-\x0D]"

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{BLANK}+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM twice, range(3) AS s(k)) GROUP BY r),
m AS (SELECT w.r, doc_id, t, ws, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON w.r = rep.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
    OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_repeat_words > 3 * n_words
    OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) < 8 * n_words
    OR 10 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) > 3 * n_lines
    OR 10 * len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•][\x20\x09]'))) > 9 * n_lines) AS kept
FROM b
"""


def _kind_sql(kind: str, k: int, pattern: str, check: str, score: float, context: str, base: bool) -> str:
    """Spans of one kind as rows; h: the matched strings, g: what lies between them."""
    keep = "" if base else f" AND s >= {pii.THRESHOLD}"
    return rf"""
SELECT r, {k} AS k, '{kind}' AS kind, a, z, s FROM (
  SELECT r, x, a, z, {score} + CASE WHEN regexp_matches(lower(substring(t, greatest(a - {pii.BEFORE}, 0) + 1, least(a, {pii.BEFORE})) || ' ' || substring(t, z + 1, {pii.AFTER})), '{context}') THEN 0.3 ELSE 0 END AS s
  FROM (SELECT r, t, h[i] AS x, list_sum(list_transform(g[1:i], lambda v: length(v)))::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda v: length(v))), 0)::BIGINT AS a, a + length(h[i]) AS z
    FROM (SELECT r, t, h, g, unnest(range(1, len(h) + 1)) AS i
      FROM (SELECT r, t, regexp_extract_all(t, '{pattern}') AS h, regexp_split_to_array(t, '{pattern}') AS g FROM d)))
) WHERE {check}{keep}"""


_D = "regexp_replace(x, '[^0-9]', '', 'g')"
_I = "replace(x, ' ', '')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substring(reverse({_D}), i, 1)::INT ELSE substring(reverse({_D}), i, 1)::INT * 2 - CASE WHEN substring(reverse({_D}), i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
_MOD97 = rf"list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(substring({_I}, 5) || substring({_I}, 1, 4), ''), lambda c: (CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)::HUGEINT)), lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1"
_PARTS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR right('0' || p, 3)::INT > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_D}) BETWEEN 16 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) BETWEEN 8 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", f"length({_I}) BETWEEN 15 AND 34 AND {_MOD97}"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(x, '^(?:000|666|9)|-00-|-0000$')"),
)
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_kind_sql(n, k, p, c, kind.score, kind.context, kind.base) for k, ((n, p, c), kind) in enumerate(zip(_PARTS, pii.KINDS, strict=True)))}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)},
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) FILTER (k < {len(pii.BASE)}) AS b,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) AS spans, string_agg(round(s * 100)::INT::VARCHAR, ',' ORDER BY k, a) AS scores FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in pii.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g ON d.r = g.r
"""

OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, url FROM pages),
d AS (SELECT *, upper(sha1(h)) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substring(x, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to, url, true AS intact
FROM d
"""


def _secret_sql(kind: str, k: int, pattern: str, check: str) -> str:
    return f"""
SELECT r, {k} AS k, '{kind}' AS kind, a, z FROM (
  SELECT r, h[i] AS x, list_sum(list_transform(g[1:i], lambda v: length(v)))::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda v: length(v))), 0)::BIGINT AS a, a + length(h[i]) AS z
  FROM (SELECT r, h, g, unnest(range(1, len(h) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS h, regexp_split_to_array(t, '{pattern}') AS g FROM d))
) WHERE {check}"""


_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_ANY_CASE})["'']?\x20*[:=]\x20*["'']?"""
PLAIN_JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
_SECRET_PARTS = (
    ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(x, '^{_ASSIGN}', '')) >= 6"),
    *((r.name, PLAIN_JWT if r.name == "jwt" else r.pattern, f"length(x) >= {r.least}") for r in secrets.RULES[1:]),
)
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_secret_sql(n, k, p, c) for k, (n, p, c) in enumerate(_SECRET_PARTS))}),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (k < 3) AS b, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.r = g.r
"""

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANK}+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
p AS (SELECT r, doc_id, len(any_value(ws)) AS len, w, count(*) AS tf FROM (SELECT r, doc_id, ws, unnest(ws) AS w FROM d) GROUP BY r, doc_id, w),
f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
q AS (SELECT r AS query, doc_id AS query_id, w, tf * ln(1 + (n - df + 0.5) / (df + 0.5)) AS x FROM p JOIN f USING (w), g WHERE doc_id % 50 = 0),
s AS (SELECT query, query_id, r, doc_id, sum(x * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM p JOIN q USING (w), g GROUP BY query, query_id, r, doc_id)
SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us, list_transform(range(4), lambda k: ('0x' || substr(x, 8 * k + 1, 8))::BIGINT) AS h FROM d),
c AS (SELECT doc_id, t, len(us)::BIGINT AS n, h,
        array_to_string(us[1:least(h[1] % (len(us) + 1), h[2] % (len(us) + 1))], '') AS p,
        array_to_string(us[1:greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1))], '') AS pm FROM u),
f AS (SELECT *, substr(pm, length(p) + 1) AS m, substr(t, length(pm) + 1) AS s,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""

OP13_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, id AS positive_id, s AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, id, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, anchor_id, positive_id, positive_score, id, s, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s DESC, id, s.b) AS k FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score)
SELECT anchor_id, positive_id, k::INT AS rank, id AS negative_id, positive_score, s AS negative_score FROM n WHERE k <= 3
"""

ORACLE_SQL = {"op1_warc": OP1_SQL, "op6_search": OP6_SQL, "op3_quality": OP3_SQL, "op7_pii": OP7_SQL, "op10_secrets": OP10_SQL, "op12_infill": OP12_SQL, "op13_negatives": OP13_SQL}
