"""Queries of the policy, connection, audit, graph and text operators that the first module leaves out, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, connections, graph, policy, retrieval, rollups
from ..sources import files
from .queries import CHUNKS_SQL, COSINE_SQL, VECTOR, chunks, query, t, values

TODAY_SQL = "DATE '2024-01-20'"


def today():
    return F.lit("2024-01-20").cast("date")


def customers(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return t(spark, sf, "customer").select(k.alias("persona"), k, n, "c_mktsegment")


def members(spark, sf):
    """Each customer is in a team, every other one in a second."""
    c = customers(spark, sf)
    one = c.select("persona", F.concat(F.lit("team"), F.col("c_nationkey") % 5).alias("team"), F.lit(False).alias("is_default"))
    two = c.where("persona % 2 = 0").select("persona", F.concat(F.lit("team"), (F.col("c_nationkey") + 1) % 5).alias("team"), (F.col("persona") % 4 == 0).alias("is_default"))
    return one.unionByName(two)


MEMBERS_SQL = "members AS (SELECT c_custkey AS persona, 'team' || c_nationkey % 5 AS team, false AS is_default FROM customer UNION ALL SELECT c_custkey, 'team' || (c_nationkey + 1) % 5, c_custkey % 4 = 0 FROM customer WHERE c_custkey % 2 = 0)"
CONSTRAINTS = [("team0", "write", "status", "O"), ("team0", "write", "status", "F"), ("team1", "write", "status", "P"), ("team1", "write", "area", "x"), ("team2", "read", "area", "y")]
GRANTS_SQL = "grants AS (SELECT c_custkey AS persona, CASE WHEN c_custkey % 2 = 0 THEN 'write' ELSE 'read' END AS tool, CASE WHEN c_custkey % 3 = 0 THEN 'platform' ELSE 'team' || c_nationkey % 5 END AS scope, c_custkey % 7 = 0 AS unconstrained FROM customer)"


@query(f"""WITH {MEMBERS_SQL}, {GRANTS_SQL}, c(team, tool, arg, value) AS (VALUES {", ".join(map(str, CONSTRAINTS))}),
l AS (SELECT g.persona, g.tool, m.team FROM grants g JOIN members m USING (persona) WHERE NOT unconstrained AND scope = 'platform' UNION SELECT persona, tool, scope FROM grants WHERE NOT unconstrained AND scope <> 'platform')
SELECT persona, l.tool, arg, string_agg(DISTINCT value, ',' ORDER BY value) AS allowed_values FROM l JOIN c ON l.team = c.team AND l.tool = c.tool GROUP BY ALL""")
def argument_limits(spark, sf):
    c, k = customers(spark, sf), F.col("persona")
    grants = c.select("persona", F.when(k % 2 == 0, "write").otherwise("read").alias("tool"), F.when(k % 3 == 0, "platform").otherwise(F.concat(F.lit("team"), F.col("c_nationkey") % 5)).alias("scope"), (k % 7 == 0).alias("unconstrained"))
    found = policy.argument_limits(grants, members(spark, sf), values(spark, CONSTRAINTS, "team string, tool string, arg string, value string"))
    return found.withColumn("allowed_values", F.array_join("allowed_values", ","))


SKILLS = [("deploy", None, ["ops"], [], []), ("review", None, [], ["lead"], []), ("triage", "team1", [], [], ["team1", "team2"]), ("report", "team2", ["doc"], ["lead"], []), ("secret", None, [], [], []), ("local", "team3", [], [], [])]
SKILL_GRANTS = [("user", "tag:ops"), ("lead", "review"), ("user", "review"), ("root", "*")]
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
SKILLS_SQL = "skills(skill, team, tags, acc_r, acc_t) AS (VALUES " + ", ".join(f"('{s}', {'NULL' if team is None else repr(team)}, {_list(a)}, {_list(b)}, {_list(c)})" for s, team, a, b, c in SKILLS) + ")"
HELD_SQL = "held AS (SELECT c_custkey AS persona, 'platform' AS scope, 'user' AS role FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, 'team' || c_nationkey % 5, 'lead' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'platform', 'root' FROM customer WHERE c_custkey % 11 = 0)"
VISIBLE_SQL = f"""{MEMBERS_SQL}, {SKILLS_SQL}, {HELD_SQL}, sg(role, g) AS (VALUES {", ".join(map(str, SKILL_GRANTS))}),
e AS (SELECT DISTINCT persona FROM held), d AS (SELECT e.persona, s.*,
  EXISTS (SELECT 1 FROM held h JOIN sg ON h.role = sg.role WHERE h.persona = e.persona AND (g = '*' OR g = s.skill OR list_contains(list_transform(s.tags, lambda x: 'tag:' || x), g))) AS granted,
  EXISTS (SELECT 1 FROM held h JOIN sg ON h.role = sg.role WHERE h.persona = e.persona AND g = '*') AS everything,
  EXISTS (SELECT 1 FROM members m WHERE m.persona = e.persona AND m.team = s.team) AS member,
  EXISTS (SELECT 1 FROM held h WHERE h.persona = e.persona AND list_contains(s.acc_r, h.role) AND (s.team IS NULL OR h.scope = s.team OR h.scope = 'platform')) OR EXISTS (SELECT 1 FROM members m WHERE m.persona = e.persona AND list_contains(s.acc_t, m.team)) AS access FROM e, skills s),
visible AS (SELECT persona, skill, team, CASE WHEN team IS NULL AND NOT granted THEN 'not granted' WHEN team IS NOT NULL AND NOT member AND NOT everything THEN 'not a member' WHEN len(acc_r) + len(acc_t) > 0 AND NOT access THEN 'no access' ELSE 'visible' END AS decision FROM d)"""


def held(spark, sf):
    c, k = customers(spark, sf), F.col("persona")
    row = lambda where, scope, role: c.where(where).select("persona", scope.alias("scope"), F.lit(role).alias("role"))
    return row(k % 5 > 0, F.lit("platform"), "user").unionByName(row(k % 3 == 0, F.concat(F.lit("team"), F.col("c_nationkey") % 5), "lead")).unionByName(row(k % 11 == 0, F.lit("platform"), "root"))


def skills_of(spark, sf):
    skills = values(spark, SKILLS, "skill string, team string, tags array<string>, access_roles array<string>, access_teams array<string>")
    return policy.visible_skills(skills, held(spark, sf), values(spark, SKILL_GRANTS, "role string, grant string"), members(spark, sf))


@query(f"WITH {VISIBLE_SQL} SELECT persona, skill, decision FROM visible")
def skill_decisions(spark, sf):
    return skills_of(spark, sf).select("persona", "skill", "decision")


FLOWS = [("team0", ["triage", "deploy"], 3), ("team1", None, 9), ("team2", [], None)]


@query(f"""WITH {VISIBLE_SQL}, f(team, lenses, cap) AS (VALUES ('team0', ['triage', 'deploy'], 3), ('team1', NULL, 9), ('team2', [], NULL)),
o AS (SELECT persona, m.team, CASE WHEN coalesce(len(lenses), 0) > 0 THEN lenses ELSE ['deploy', 'review', 'report'] END AS l, least(coalesce(cap, 5), 5)::INT AS cap FROM members m LEFT JOIN f ON m.team = f.team),
u AS (SELECT persona, team, cap, i, l[i] AS skill FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM o))
SELECT u.persona, u.team, u.cap, coalesce(string_agg(u.skill, ',' ORDER BY i) FILTER (decision = 'visible'), '') AS lenses FROM u LEFT JOIN visible v ON u.persona = v.persona AND u.skill = v.skill GROUP BY ALL""")
def document_flow(spark, sf):
    platform = values(spark, [(["deploy", "review", "report"], 5)], "lenses array<string>, cap int")
    found = policy.document_flow(members(spark, sf).select("persona", "team"), platform, values(spark, FLOWS, "team string, lenses array<string>, cap int"), skills_of(spark, sf).where("decision = 'visible'"))
    return found.withColumn("lenses", F.array_join("lenses", ","))


@query("""WITH l AS (SELECT o_orderkey, list_distinct(['a', 's' || o_custkey % 3]) AS r, ['s' || o_custkey % 4, 'a', 'z' || o_orderkey % 2] AS c FROM orders), e AS (SELECT o_orderkey, len(list_distinct(list_concat(r, c))) AS n FROM l)
SELECT o_orderkey, n::INT AS n, CASE WHEN n > 3 THEN 'more than 3 lenses' END AS problem FROM e""")
def lens_plan(spark, sf):
    o = t(spark, sf, "orders")
    s = lambda n: F.concat(F.lit("s"), F.col("o_custkey") % n)
    plan = policy.lens_plan(F.array(F.lit("a"), s(3)), F.array(s(4), F.lit("a"), F.concat(F.lit("z"), F.col("o_orderkey") % 2)), F.lit(3))
    return o.select("o_orderkey", plan.alias("p")).select("o_orderkey", F.size("p.lenses").alias("n"), "p.problem")


@query(f"WITH {MEMBERS_SQL}, {HELD_SQL} SELECT DISTINCT m.persona, m.team, role FROM members m JOIN held h ON m.persona = h.persona AND (scope = 'platform' OR scope = m.team)")
def team_roles(spark, sf):
    return policy.roles_in(held(spark, sf), members(spark, sf).select("persona", "team"))


ENTRIES_SQL = "entries AS (SELECT c_custkey AS oid, CASE WHEN c_custkey % 2 = 0 THEN 'jira' ELSE 'wiki' END AS connection_id, CASE WHEN c_custkey % 5 > 0 THEN DATE '2024-01-01' + (c_custkey % 60)::INT END AS expires_at, CASE WHEN c_custkey % 7 = 0 THEN 'rejected' ELSE 'ok' END AS status FROM customer WHERE c_custkey % 3 > 0)"


def entries(spark, sf):
    k = F.col("c_custkey")
    return t(spark, sf, "customer").where(k % 3 > 0).select(k.alias("oid"), F.when(k % 2 == 0, "jira").otherwise("wiki").alias("connection_id"), F.when(k % 5 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))).alias("expires_at"), F.when(k % 7 == 0, "rejected").otherwise("ok").alias("status"))


@query(f"""WITH {ENTRIES_SQL} SELECT c_custkey AS oid, k.id AS connection_id, e.oid IS NOT NULL AS connected, CASE WHEN e.oid IS NOT NULL THEN coalesce(expires_at < {TODAY_SQL}, false) END AS expired,
CASE WHEN e.oid IS NOT NULL THEN coalesce(expires_at BETWEEN {TODAY_SQL} AND {TODAY_SQL} + 14, false) END AS expiring_soon FROM customer CROSS JOIN (VALUES ('jira'), ('wiki'), ('code')) k(id) LEFT JOIN entries e ON e.oid = c_custkey AND e.connection_id = k.id""")
def connection_status(spark, sf):
    users = t(spark, sf, "customer").select(F.col("c_custkey").alias("oid"))
    return connections.status(users, values(spark, [("jira",), ("wiki",), ("code",)], "connection_id string"), entries(spark, sf), today()).drop("expires_at")


@query(f"""WITH {ENTRIES_SQL}, r AS (SELECT o_orderkey AS request_id, o_custkey AS oid, CASE o_orderkey % 3 WHEN 0 THEN 'jira' WHEN 1 THEN 'wiki' ELSE 'none' END AS connection_id FROM orders)
SELECT request_id, CASE WHEN r.connection_id = 'none' THEN 'not configured' WHEN e.oid IS NULL THEN 'not connected' WHEN status <> 'ok' THEN 'rejected' WHEN expires_at < {TODAY_SQL} THEN 'expired' ELSE 'ok' END AS outcome FROM r LEFT JOIN entries e USING (oid, connection_id)""")
def credential_eligibility(spark, sf):
    k = F.col("o_orderkey")
    asked = t(spark, sf, "orders").select(k.alias("request_id"), F.col("o_custkey").alias("oid"), F.when(k % 3 == 0, "jira").when(k % 3 == 1, "wiki").otherwise("none").alias("connection_id"))
    return connections.eligibility(asked, values(spark, [("jira",), ("wiki",)], "connection_id string"), entries(spark, sf), today())


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'schema' WHEN c_custkey % 3 = 0 THEN 'owner' END AS problem FROM customer")
def owner_integrity(spark, sf):
    k = F.col("c_custkey")
    stored = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("U"), k).alias("oid"), F.when(k % 3 == 0, "other").otherwise(text.user_key(F.concat(F.lit("u"), k))).alias("key"), F.when(k % 5 == 0, 2).otherwise(1).alias("schema"))
    return connections.readable_entries(stored).select("c_custkey", "problem")


SEEN_SQL = "seen AS (SELECT l_orderkey AS call_id, coalesce(list_sort(list_distinct(list('p' || l_partkey % 20) FILTER (l_quantity > 20))), []) AS visible, count(*) FILTER (l_quantity <= 20) AS hidden FROM lineitem GROUP BY 1)"


def seen(spark, sf):
    line = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.concat(F.lit("p"), F.col("l_partkey") % 20).alias("name"), (F.col("l_quantity") > 20).alias("allowed"))
    return audit.seen_lists(line)


@query(f"WITH {SEEN_SQL} SELECT call_id, array_to_string(visible, ',') AS visible, hidden FROM seen")
def audit_lists(spark, sf):
    return seen(spark, sf).withColumn("visible", F.array_join("visible", ","))


@query(f"""WITH {SEEN_SQL} SELECT call_id, '{{"event":"tools_list","who":"u' || call_id % 9 || '","visible":[' || array_to_string(list_transform(visible, lambda x: '"' || x || '"'), ',') || '],"hidden":' || hidden || '}}' AS line FROM seen""")
def audit_records(spark, sf):
    return seen(spark, sf).select("call_id", audit.record("tools_list", F.concat(F.lit("u"), F.col("call_id") % 9)).alias("line"))


REASONS = ["missing_token", "malformed_token", "malformed_token", "malformed_token", "blocked", "expired", "wrong_tenant", "wrong_issuer", "wrong_audience", "missing_scope", "invalid_token"]


@query("SELECT event_id, CASE event_id % 11 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(REASONS)) + " END AS problem FROM events")
def auth_failures(spark, sf):
    """Each event has a header of its own; tokens lack one claim more each, from the last to the fourth."""
    k = F.col("event_id") % 11
    claim = lambda name, at, good, bad: F.concat(F.lit(f',"{name}":'), F.when(k == at, bad).otherwise(good))
    body = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), claim("oid", 4, '"U1"', '"B2"'), claim("exp", 5, "2000", "999.5"), claim("tid", 6, '"t"', "null"), claim("iss", 7, '"i"', '"j"'), claim("aud", 8, '"a"', '"c"'), claim("scp", 9, '"read write"', '"write"'), F.lit("}"))
    token = F.concat(F.lit("bearer aa."), F.translate(F.base64(body.cast("binary")), "+/=\r\n", "-_"), F.lit(".cc"))
    header = F.when(k == 1, " ").when(k == 2, "Basic abc").when(k == 3, "Bearer abc").when(k > 3, token)
    return t(spark, sf, "events").select("event_id", audit.auth_failure(header, F.lit(1000.0), ["b2"], "t", "i", ["a", "b"], ["read"]).alias("problem"))


# Extraction: a customer is a document; its orders name entities of a few types, and relations between them.
FOUND_SQL = """found AS (SELECT o_custkey AS doc, o_orderkey AS pos, ' Svc ' || o_orderkey % 40 AS name, 'svc-' || o_orderkey % 40 AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'service' END AS type FROM orders),
ents AS (SELECT * FROM (SELECT doc, key, trim(arg_min(name, pos)) AS name, min(pos) AS pos FROM found WHERE type = 'service' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY pos) <= 25),
rels AS (SELECT DISTINCT o_custkey AS doc, 'svc-' || o_orderkey % 40 AS s, CASE o_orderkey % 3 WHEN 0 THEN 'uses' WHEN 1 THEN 'owns' ELSE 'guesses' END AS relation, 'svc-' || o_orderkey % 17 AS t FROM orders)"""


def extracted(spark, sf):
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders")
    found = o.select(F.col("o_custkey").alias("doc"), k.alias("pos"), F.concat(F.lit(" Svc "), k % 40).alias("name"), F.when(k % 5 == 0, "other").otherwise("service").alias("type"), F.lit("d").alias("description"))
    relations = o.select(F.col("o_custkey").alias("doc"), F.concat(F.lit("svc_"), k % 40).alias("source"), F.when(k % 3 == 0, "uses").when(k % 3 == 1, "owns").otherwise("guesses").alias("relation"), F.concat(F.lit("Svc "), k % 17).alias("target"))
    return graph.clean_extraction(found, ["service"]), relations


@query(f"WITH {FOUND_SQL} SELECT r.doc, a.name AS source, relation, b.name AS target FROM rels r JOIN ents a ON r.doc = a.doc AND s = a.key JOIN ents b ON r.doc = b.doc AND t = b.key WHERE relation <> 'guesses' AND s <> t")
def extraction_relations(spark, sf):
    cleaned, relations = extracted(spark, sf)
    return graph.clean_relations(relations, cleaned, ["uses", "owns"])


GRAPH_SQL = """men AS (SELECT 's' || o_custkey % 3 AS source_id, o_orderkey AS chunk_id, 'k' || lpad((o_custkey % 97)::VARCHAR, 3, '0') AS key FROM orders), known AS (SELECT DISTINCT source_id, key, substr(key, 2)::BIGINT AS entity_id FROM men WHERE substr(key, 2)::INT % 4 = 0),
fresh AS (SELECT source_id, key, (SELECT max(entity_id) FROM known) + row_number() OVER (ORDER BY source_id, key) AS entity_id FROM (SELECT DISTINCT source_id, key FROM men) m WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source_id = m.source_id AND k.key = m.key)),
ids AS (SELECT * FROM known UNION ALL SELECT * FROM fresh)"""


def written(spark, sf):
    o = t(spark, sf, "orders")
    key = lambda c: F.concat(F.lit("k"), F.lpad((c % 97).cast("string"), 3, "0"))
    found = o.select(F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("source_id"), F.col("o_orderkey").alias("chunk_id"), key(F.col("o_custkey")).alias("key"))
    every = found.withColumns({"name": F.col("key"), "type": F.lit("t"), "description": F.lit("d")})
    known = found.select("source_id", "key", F.substr("key", F.lit(2)).cast("long").alias("entity_id")).where("entity_id % 4 = 0").distinct()
    relations = found.select("source_id", "chunk_id", F.col("key").alias("src_key"), F.lit("near").alias("relation"), key(F.col("chunk_id")).alias("dst_key"))
    return graph.write_graph(every.unionByName(every), relations, known)


@query(f"WITH {GRAPH_SQL} SELECT source_id, key, entity_id FROM fresh")
def graph_new_entities(spark, sf):
    return written(spark, sf)[0].select("source_id", "key", "entity_id")


@query(f"WITH {GRAPH_SQL} SELECT DISTINCT m.source_id, entity_id, chunk_id FROM men m JOIN ids i ON m.source_id = i.source_id AND m.key = i.key")
def graph_mentions(spark, sf):
    return written(spark, sf)[1]


@query(f"WITH {GRAPH_SQL} SELECT DISTINCT m.source_id, a.entity_id AS src_id, 'near' AS relation, b.entity_id AS dst_id, chunk_id FROM men m JOIN ids a ON m.source_id = a.source_id AND m.key = a.key JOIN ids b ON m.source_id = b.source_id AND b.key = 'k' || lpad((chunk_id % 97)::VARCHAR, 3, '0')")
def graph_edges_written(spark, sf):
    return written(spark, sf)[2]


@query("SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS cached FROM documents")
def extraction_cache(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", graph.cache_key("1", "m", ["b", "a"], ["r"], F.col("text")).alias("cache_key"))
    cache = d.where("doc_id % 3 = 0").select("cache_key", F.lit("{}").alias("result")).distinct()
    return graph.cache_lookup(d, cache).select("doc_id", "cached")


@query(f"""WITH {CHUNKS_SQL}, s AS (SELECT source_id, source_id || '/' || chunk_id % 5 AS path, chunk_id, {COSINE_SQL} AS score FROM chunks) SELECT chunk_id, path, round(score, 6) AS score FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source_id, path ORDER BY score DESC, chunk_id) = 1) ORDER BY score DESC, chunk_id LIMIT 10""")
def one_per_document(spark, sf):
    c = chunks(spark, sf).withColumns({"path": F.concat_ws("/", "source_id", (F.col("chunk_id") % 5).cast("string")), "score": retrieval.cosine(F.col("embedding"), VECTOR)})
    return retrieval.one_per_document(c, 10, [F.desc("score"), F.col("chunk_id")]).select("chunk_id", "path", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'vector' ELSE 'hybrid' END AS variant, event_type AS q, row_number() OVER (PARTITION BY event_id % 2, event_type ORDER BY event_id)::INT AS rank, (user_id % 40)::VARCHAR AS doc FROM events),
d AS (SELECT variant || '+dedup' AS variant, q, row_number() OVER (PARTITION BY variant, q ORDER BY min(rank), doc)::INT AS rank, doc FROM h GROUP BY variant, q, doc) SELECT * FROM h WHERE rank <= 10 UNION ALL SELECT * FROM d WHERE rank <= 10""")
def retrieval_variants(spark, sf):
    from pyspark.sql import Window

    e, k = t(spark, sf, "events"), F.col("event_id") % 2
    hits = e.select(F.when(k == 0, "vector").otherwise("hybrid").alias("variant"), F.col("event_type").alias("q"), F.row_number().over(Window.partitionBy(k, "event_type").orderBy("event_id")).alias("rank"), (F.col("user_id") % 40).cast("string").alias("doc"))
    return retrieval.variants(hits, 10)


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 9 > 0) a FULL JOIN (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 6 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 8 > 0) b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def listing_diff(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    changed = F.when(F.col("path") % 6 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return files.changed_paths(d.where("path % 9 > 0").select("path", F.sha2("text", 256).alias("content_hash")), d.where("path % 8 > 0").select("path", F.sha2(changed, 256).alias("content_hash")))


@query("""WITH c AS (SELECT o_custkey, o_orderkey % 50 AS s, (o_orderkey % 50) + (o_orderkey % 4) - 1 AS e, trim(CASE WHEN o_orderkey % 6 = 0 THEN '  ' ELSE ' note ' || o_orderkey || ' ' END) AS x FROM orders), g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s, e, x) AS k FROM c WHERE x <> '' AND s >= 1 AND e >= s)
SELECT o_custkey, count(*) AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM g WHERE k <= 50 GROUP BY 1""")
def comment_cleaning(spark, sf):
    k = F.col("o_orderkey")
    c = t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct((k % 50).alias("start"), (k % 50 + k % 4 - 1).alias("end"), F.when(k % 6 == 0, "  ").otherwise(F.concat(F.lit(" note "), k, F.lit(" "))).alias("text"))).alias("c"))
    total = lambda f: F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x[f])
    return c.select("o_custkey", text.clean_comments(F.col("c")).alias("x")).where(F.size("x") > 0).select("o_custkey", F.size("x").cast("long").alias("n"), total("start").alias("starts"), total("end").alias("ends"))


@query("""SELECT p_partkey, left(p_name, 12) AS cut, length(p_name) > 12 AS truncated, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END::INT AS rank, 'bkt' || p_partkey % 3 AS bucket, CASE WHEN p_partkey % 2 = 0 THEN 'a/b/' ELSE '' END AS prefix,
  CASE p_partkey % 4 WHEN 0 THEN 'https://h.x/o/r' || p_partkey || '/blob/c1/d%20e/~f%2A.py' WHEN 1 THEN 'https://h.x/o/r' || p_partkey || '/src/c1/d%20e/~f%2A.py' WHEN 2 THEN 'https://h.x/ctx/projects/O/repos/r' || p_partkey || '/browse/d%20e/~f%2A.py?at=c1' END AS link,
  'n' || p_partkey AS field, 'title: t' || p_partkey || chr(10) AS meta, 'rest' || p_partkey AS under FROM part""")
def source_texts(spark, sf):
    k = F.col("p_partkey")
    s = k.cast("string")
    location = F.when(k % 4 == 2, F.concat(F.lit("https://h.x/ctx/scm/o/r"), s, F.lit(".git"))).otherwise(F.concat(F.lit("https://h.x/o/r"), s, F.lit(".git")))
    provider = F.when(k % 4 == 0, "github").when(k % 4 == 1, "bitbucket-cloud").when(k % 4 == 2, "bitbucket-dc")
    json = F.when(k % 3 == 0, F.concat(F.lit('{"f":{"name":"n'), s, F.lit('"}}'))).when(k % 3 == 1, F.concat(F.lit('{"f":{"value":"n'), s, F.lit('"}}'))).otherwise(F.concat(F.lit('{"f":"n'), s, F.lit('"}')))
    page = F.concat(F.lit("---\ntitle: t"), s, F.lit("\n---\n# A\n## Notes\nrest"), s, F.lit("\n## Other\nx"))
    bucket = text.bucket_location(F.concat(F.lit("gs://bkt"), (k % 3).cast("string"), F.when(k % 2 == 0, "//a/b").otherwise("")))
    cut = text.cut_text(F.col("p_name"), 12)
    rank = text.level_rank(F.element_at(F.array(F.lit("public"), F.lit("internal"), F.lit("secret"), F.lit("none")), (k % 4 + 1).cast("int")), ["public", "internal", "secret"])
    front = text.frontmatter(page)
    return t(spark, sf, "part").select(
        "p_partkey", cut["text"].alias("cut"), cut["truncated"].alias("truncated"), rank.cast("int").alias("rank"), bucket["bucket"].alias("bucket"), bucket["prefix"].alias("prefix"),
        text.deep_link(provider, location, F.lit("c1"), F.lit("d e/~f*.py")).alias("link"), text.named_value(json, "f").alias("field"), front["meta"].alias("meta"), text.section_under(front["body"], "Notes").alias("under"))


@query(f"""WITH {MEMBERS_SQL}, h AS (SELECT c_custkey AS persona, 0 AS n, lower(left(c_mktsegment || ' in ' || n_name, 200)) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey), k(team, keyword) AS (VALUES ('team0', 'building'), ('team1', 'france'), ('team1', 'machinery'), ('team2', 'in'), ('team2', 'building'), ('team3', 'furniture in'), ('team4', 'household')),
f AS (SELECT h.persona, list_sort(list(DISTINCT m.team)) AS found FROM h JOIN members m USING (persona) JOIN k ON k.team = m.team AND length(keyword) >= 3 AND regexp_matches(x, '(?:^|[^a-z0-9])' || keyword || '(?:$|[^a-z0-9])') GROUP BY 1),
o AS (SELECT persona, list_sort(list(DISTINCT team)) AS own, min(team) FILTER (is_default) AS d FROM members GROUP BY 1)
SELECT h.persona, CASE WHEN len(found) = 1 THEN 'one' WHEN len(found) > 1 THEN 'ambiguous' WHEN len(own) = 1 THEN 'only team' WHEN d IS NOT NULL THEN 'default team' ELSE 'none' END AS outcome,
  array_to_string(CASE WHEN found IS NOT NULL THEN found WHEN len(own) = 1 THEN own WHEN d IS NOT NULL THEN [d] ELSE coalesce(own, []) END, ',') AS teams FROM h LEFT JOIN o USING (persona) LEFT JOIN f USING (persona)""")
def team_match(spark, sf):
    hints = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("persona"), F.lit(0).alias("n"), F.concat_ws(" in ", "c_mktsegment", "n_name").alias("text"))
    words = [("team0", "building"), ("team1", "france"), ("team1", "machinery"), ("team2", "in"), ("team2", "building"), ("team3", "furniture in"), ("team4", "household")]
    found = policy.match_teams(hints, values(spark, words, "team string, keyword string"), members(spark, sf))
    return found.withColumn("teams", F.array_join("teams", ","))


@query(f"""WITH {ENTRIES_SQL}, w AS (SELECT o_custkey AS oid, CASE WHEN o_orderkey % 2 = 0 THEN 'jira' ELSE 'wiki' END AS connection_id, CASE WHEN o_orderkey % 29 = 0 THEN 'forget' WHEN o_orderkey % 5 = 0 THEN 'disconnect' ELSE 'invalid' END AS action FROM orders WHERE o_orderkey % 3 = 0)
SELECT oid, connection_id, CASE WHEN EXISTS (FROM w WHERE w.oid = e.oid AND w.connection_id = e.connection_id AND action = 'invalid') THEN 'invalid' ELSE status END AS status FROM entries e
WHERE NOT EXISTS (FROM w WHERE w.oid = e.oid AND (action = 'forget' OR (action = 'disconnect' AND w.connection_id = e.connection_id)))""")
def connection_writes(spark, sf):
    k = F.col("o_orderkey")
    action = F.when(k % 29 == 0, "forget").when(k % 5 == 0, "disconnect").otherwise("invalid")
    writes = t(spark, sf, "orders").where(k % 3 == 0).select(F.col("o_custkey").alias("oid"), F.when(k % 2 == 0, "jira").otherwise("wiki").alias("connection_id"), action.alias("action"))
    return connections.written(entries(spark, sf).drop("expires_at"), writes)


@query("""WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN 'kind' || s_nationkey % 3 END AS kind, 'n' || s_nationkey AS name FROM supplier)
SELECT kind, name, string_agg('sources/' || id || '.yaml', ',' ORDER BY 'sources/' || id || '.yaml') AS used_by FROM s WHERE kind IS NOT NULL GROUP BY ALL""")
def secret_uses(spark, sf):
    n = F.col("s_nationkey")
    sources = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("kind"), n % 3)).alias("kind"), F.concat(F.lit("n"), n).alias("name"))
    return policy.secret_references(sources).withColumn("used_by", F.array_join("used_by", ","))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'a' || p_size || '/x.md' WHEN 1 THEN 'y.md' WHEN 2 THEN 'z' || p_size || '.md' WHEN 3 THEN 'a' || p_size || '/b/w.md' WHEN 4 THEN 'c/v.md' END AS target FROM part""")
def resolved_links(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    forms = [F.lit("../x.md"), F.lit(".././../y.md#top"), F.concat(F.lit("/z"), n, F.lit(".md")), F.lit("./w.md"), F.lit("/a/../c//v.md"), F.lit("https://example.org/x.md"), F.lit("#top"), F.lit("../../../out.md")]
    own = F.concat(F.lit("a"), n, F.lit("/b/doc.md"))
    return t(spark, sf, "part").select("p_partkey", text.resolved_target(own, F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))).alias("target"))


@query("""WITH f AS (SELECT l_orderkey AS r, CASE l_partkey % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' ELSE 'nit' END AS s, l_linenumber AS id, 'T' || l_partkey || '** (a, b)' || CASE WHEN l_partkey % 2 = 0 THEN chr(10) || '- Where: p' || l_suppkey ELSE '' END || CASE WHEN l_partkey % 5 > 0 THEN chr(10) || '- Why: d' ELSE '' END AS body FROM lineitem WHERE l_quantity > 30),
n AS (SELECT r, s, count(*) AS n, string_agg(chr(10) || chr(10) || '**' || upper(s[1]) || i || '. ' || body, '' ORDER BY i) AS items FROM (SELECT *, row_number() OVER (PARTITION BY r, s ORDER BY id, body) AS i FROM f) GROUP BY ALL)
SELECT o_orderkey AS review_id, k.s AS severity, '## ' || upper(k.s[1]) || k.s[2:] || ' (' || coalesce(n, 0) || ')' || coalesce(items, chr(10) || 'None.') AS section FROM orders CROSS JOIN (VALUES ('blocker'), ('major'), ('nit')) k(s) LEFT JOIN n ON r = o_orderkey AND n.s = k.s""")
def review_report(spark, sf):
    p = F.col("l_partkey")
    level = F.when(p % 3 == 0, "blocker").when(p % 3 == 1, "major").otherwise("nit")
    where = F.when(p % 2 == 0, F.concat(F.lit("p"), F.col("l_suppkey")))
    found = t(spark, sf, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").alias("id"), level.alias("severity"), F.concat(F.lit("T"), p).alias("title"), F.array(F.lit("a"), F.lit("b")).alias("lenses"), where.alias("where"), F.when(p % 5 > 0, "d").alias("detail"), F.lit("").alias("suggestion"))
    return rollups.report_sections(t(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id")), found)


@query("""WITH p AS (SELECT 'role' || c_custkey % 50 AS role, min('b' || c_custkey) AS granted_by FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1)
SELECT DISTINCT 'm' || s_suppkey AS rule, role, granted_by FROM supplier JOIN p ON role = 'role' || s_suppkey % 60""")
def role_scopes(spark, sf):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    platform = t(spark, sf, "customer").where(c % 2 == 0).select(F.concat(F.lit("b"), c).alias("rule"), F.concat(F.lit("role"), c % 50).alias("role"))
    return policy.mixed_scopes(platform, t(spark, sf, "supplier").select(F.concat(F.lit("m"), s).alias("rule"), F.concat(F.lit("role"), s % 60).alias("role")))


@query(f"""WITH {MEMBERS_SQL}, i(team, n, said) AS (VALUES ('team0', 1, 'be brief'), ('team0', 2, 'cite'), ('team1', 1, 'use tables'), ('team3', 1, 'ask first')),
q AS (SELECT o_orderkey AS request_id, o_custkey AS persona, CASE WHEN o_orderkey % 3 > 0 THEN 'team' || o_orderkey % 5 END AS team FROM orders),
w AS (SELECT *, team IS NOT NULL AND NOT EXISTS (FROM members m WHERE m.persona = q.persona AND m.team = q.team) AS wrong FROM q)
SELECT request_id, CASE WHEN wrong THEN 'unknown team' END AS problem,
  CASE WHEN wrong THEN '' ELSE coalesce((SELECT string_agg(m.team, ',' ORDER BY m.team) FROM members m WHERE m.persona = w.persona), '') END AS teams,
  CASE WHEN wrong THEN '' ELSE coalesce((SELECT string_agg(said, ',' ORDER BY i.team, n) FROM members m JOIN i ON m.team = i.team WHERE m.persona = w.persona AND (w.team IS NULL OR w.team = i.team)), '') END AS instructions FROM w""")
def agent_context(spark, sf):
    k = F.col("o_orderkey")
    asked = t(spark, sf, "orders").select(k.alias("request_id"), F.col("o_custkey").alias("persona"), F.when(k % 3 > 0, F.concat(F.lit("team"), k % 5)).alias("team"))
    told = values(spark, [("team0", 1, "be brief"), ("team0", 2, "cite"), ("team1", 1, "use tables"), ("team3", 1, "ask first")], "team string, n int, text string")
    found = policy.agent_context(asked, members(spark, sf), told)
    return found.withColumns({"teams": F.array_join("teams", ","), "instructions": F.array_join("instructions", ",")})


@query("""WITH s AS (SELECT 'sources/s' || s_suppkey || '.yaml' AS file, 's' || (CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey - 1 ELSE s_suppkey END) AS id, s_suppkey AS k, s_nationkey AS n FROM supplier),
r AS (SELECT *, min(file) OVER (PARTITION BY id) AS first FROM s), a AS (SELECT *, first < file AS again, first < file OR k % 4 = 3 AS lost FROM r)
SELECT file, 'the id isn''t the file''s name' AS problem FROM a WHERE k % 7 = 0
UNION ALL SELECT file, 'duplicate of ' || first FROM a WHERE again
UNION ALL SELECT file, 'unknown owner team team5' FROM a WHERE NOT again AND n % 6 = 5
UNION ALL SELECT file, 'unknown level none' FROM a WHERE NOT again AND k % 4 = 3
UNION ALL SELECT file, CASE WHEN k % 2 = 0 THEN 'git needs a ref' ELSE 'only git has a ref' END FROM a WHERE NOT lost AND (k % 2 = 0) = (k % 3 = 0)
UNION ALL SELECT file, 'access of unknown team team' || n % 7 FROM a WHERE NOT lost AND n % 7 > 4
UNION ALL SELECT file, 'access of unknown role role2' FROM a WHERE NOT lost AND k % 3 = 2""")
def source_checks(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    level = F.element_at(F.array(F.lit("public"), F.lit("internal"), F.lit("secret"), F.lit("none")), (k % 4 + 1).cast("int"))
    sources = t(spark, sf, "supplier").select(
        F.concat(F.lit("sources/s"), k, F.lit(".yaml")).alias("file"), F.concat(F.lit("s"), F.when(k % 7 == 0, k - 1).otherwise(k)).alias("source_id"), F.concat(F.lit("team"), n % 6).alias("owner_team"), level.alias("level"),
        F.when(k % 2 == 0, "git").otherwise("bucket").alias("kind"), F.when(k % 3 > 0, "c1").alias("ref"), F.array(F.concat(F.lit("team"), n % 7), F.lit("team0")).alias("access_teams"), F.array(F.concat(F.lit("role"), k % 3)).alias("access_roles"))
    known = lambda c, names: values(spark, [(x,) for x in names], f"{c} string")
    return policy.source_problems(sources, known("team", [f"team{i}" for i in range(5)]), known("level", ["public", "internal", "secret"]), known("role", ["role0", "role1"]))


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_nationkey AS role, 'r' || (n_nationkey * n_nationkey + 1) % 25 AS parent FROM nation UNION SELECT 'q' || p_partkey % 40, 'q' || p_size % 8 FROM part),
f AS (SELECT role, parent FROM e UNION SELECT f.role, e.parent FROM f JOIN e ON f.parent = e.role)
SELECT x.role, string_agg(x.parent, ',' ORDER BY x.parent) AS members FROM f x JOIN f y ON x.parent = y.role AND y.parent = x.role GROUP BY 1""")
def role_cycles(spark, sf):
    n = F.col("n_nationkey")
    one = t(spark, sf, "nation").select(F.concat(F.lit("r"), n).alias("role"), F.concat(F.lit("r"), (n * n + 1) % 25).alias("parent"))
    two = t(spark, sf, "part").select(F.concat(F.lit("q"), F.col("p_partkey") % 40).alias("role"), F.concat(F.lit("q"), F.col("p_size") % 8).alias("parent"))
    return policy.inheritance_cycles(one.unionByName(two)).withColumn("members", F.array_join("members", ","))


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 6 > 3 THEN CASE WHEN o_orderkey % 8 > 5 THEN 'role' || o_custkey % 6 || ',x' || o_orderkey % 8 ELSE 'role' || o_custkey % 6 END WHEN o_orderkey % 8 > 5 THEN 'x' || o_orderkey % 8 ELSE '' END AS unknown_roles,
  CASE WHEN o_orderkey % 3 > 0 AND NOT EXISTS (FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') THEN 'u' || o_custkey END AS unknown_user FROM orders""")
def adhoc_personas(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = t(spark, sf, "orders").select(k.alias("request_id"), F.array(F.concat(F.lit("role"), c % 6), F.concat(F.lit("x"), k % 8)).alias("app_roles"), F.when(k % 3 > 0, F.concat(F.lit("u"), c)).alias("user"))
    roles = values(spark, [(f"role{i}",) for i in range(4)] + [(f"x{i}",) for i in range(6)], "role string")
    users = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("user"))
    return policy.unknown_persona(asked, roles, users).withColumn("unknown_roles", F.array_join("unknown_roles", ","))
