"""Behaviour of the retrieval, graph, ingest, policy and limiter operators on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from corvane import registry
from corvane.functions import chunking, markup, text
from corvane.operators import graph, ingest, policy, retrieval, rollups, scope
from corvane.streaming import calls

SF = "/root/testdata/sf0.001"


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_identifier_terms(spark):
    got = column(spark, ["Does OPS-77 touch nightly_sync_job or settings.toml?", "nothing here but words", "parseHttpHeader since v2, see Q3_plan and Q3_plan", "SQL AWS CPU", None, ""], text.identifier_terms)
    assert got == [["ops-77", "nightly_sync_job", "settings.toml"], [], ["parsehttpheader", "v2", "q3_plan"], [], None, []]


def test_entity_key(spark):
    assert column(spark, ["nightly-sync", "Nightly Sync", "<nightly_sync>", "NightlySyncFailed", "OPS-77", " - "], text.entity_key) == ["nightly-sync"] * 3 + ["nightly-sync-failed", "ops-77", ""]


@pytest.mark.parametrize(("path", "glob", "want"), [("notes/one.txt", "*.txt", False), ("top.txt", "**/*.txt", True), ("x/y/z.txt", "**/*.txt", True), ("x/y.txts", "**/*.txt", False), ("a/b.c", "a/?.c", True)])
def test_globs(spark, path, glob, want):
    assert column(spark, [path], lambda c: text.selected(c, [glob], [])) == [want]


def test_small_text_functions(spark):
    assert column(spark, ["https://a.b/x", "HTTP://a.b", "https://u@a.b", "ftp://a.b", "https://a.b/x y", "https://a.b/\n", "https:///x", "https://a.b/" + "x" * 2048, None], text.safe_url) == ["https://a.b/x", "HTTP://a.b", "https://u@a.b", None, None, None, None, None, None]
    assert column(spark, ["https://x.b.c/", "https://b.c/", "https://x.y.b.c/", "http://x.b.c/", "https://u@x.b.c/"], lambda c: text.host_allowed(c, ["*.b.c"])) == [True, False, False, False, False]
    assert column(spark, [" a\x00b\u202ec \t d\n", "abcdef", None], lambda c: text.plain(c, 5)) == ["a b …", "abcd…", None]
    assert column(spark, ["a.b-1", "", None, "bad id"], text.correlation_id) == ["a.b-1", None, None, "invalid"]
    assert column(spark, ["[a](x.md#s) [b](https://q) ```[c](y.md)```"], text.link_targets) == [["x.md"]]
    assert column(spark, ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00"], text.has_offset) == [True, False]
    assert [r.asDict() for r in column(spark, ["---\nk: 1\n---\nrest", "no ---\n---\n", "---\nopen"], text.frontmatter)] == [{"meta": "k: 1\n", "body": "rest"}, {"meta": None, "body": "no ---\n---\n"}, {"meta": None, "body": "---\nopen"}]
    assert column(spark, ['see {"a": 1} there', "none", None], lambda c: text.json_inside(c, "a int")["a"]) == [1, None, None]
    assert column(spark, ["x"], lambda c: text.vector_literal(F.array(F.lit(0.5), F.lit(1e-9), F.lit(3.0))))[0].startswith("[0.5")
    name = lambda n, m="text/markdown", size=5: column(spark, [n], lambda c: text.artifact_problem(c, F.lit(m), F.lit(size)))[0]
    assert [name("a b.MD"), name("a.markdown"), name(".a.md"), name("a..md"), name("x" * 98 + ".md"), name(None), name("a.txt"), name("a.md", "image/png"), name("a.md", size=0)] == [None, None, "name", "name", "name", "name", "extension", "media type", "empty"]


def test_classify_file(spark):
    rows = [(b"\n\t %PDF-1.7", 12), (b"x" + bytes(1), 2), (b"plain", 5), (b"\xff\xfe", 2), (b"%PDF-", 300 << 20)]
    df = spark.createDataFrame(rows, "c binary, n long")
    assert [r.k for r in df.select(ingest.classify_file(F.col("c"), F.col("n")).alias("k")).collect()] == ["pdf", None, "text", None, None]


def test_chunking():
    doc = "# Harbour\n" + "ships come and go " * 9 + "\n\n## Tides\n" + "water up and down " * 9 + "\n```\n# no heading\n```\n## Lights\n" + "on and off again " * 9
    got = chunking.chunk_text(doc, "notes/PORT.MD")
    assert [c[3] for c in got] == ["Harbour", "Harbour > Tides", "Harbour > Lights"]
    assert got[1][1] == 4 and got[1][4].startswith("## Tides")
    assert [c[3] for c in chunking.chunk_text("# Only a title\n## Body\n" + "text " * 40, "a.md")] == ["Only a title > Body"]
    code = "import x\n" + "# plain words for a while\n" * 5 + "y = 1\ndata = {\n 'a': 1}\n" + "z = 'more of the same'\n" * 5 + "# about it\n@cached\nasync def load(n):\n" + "    return 'a long enough body'\n" * 5 + "class Store(Base):\n" + "    kind = 'another body here'\n" * 5
    found = chunking.chunk_text(code, "a.PY")
    assert [c[3] for c in found] == [None, "async def load(n)", "class Store(Base)"] and found[1][4].startswith("# about it")
    config = 'locals {\n' + '  a = "some words to fill it"\n' * 5 + '}\ndata "x" "y" {\n' + '  b = "some words to fill it"\n' * 5 + "}\n"
    assert [c[3] for c in chunking.chunk_text(config, "m.tf")] == ["locals", 'data "x" "y"']
    # Lines of 31 tokens and one for the break: two of them reach an overlap of 40.
    assert [a for a, _ in chunking.windows(["x" * 124] * 20, 200, 40)] == [0, 4, 8, 12, 16]
    assert list(chunking.windows(["x" * 124] * 14, 200, 0)) == [(0, 6), (6, 12), (12, 14)]
    assert list(chunking.windows(["x" * 4000, "y", "z" * 4000], 200, 40)) == [(0, 1), (1, 2), (2, 3)]
    assert chunking.chunk_text("") == chunking.chunk_text(None) == chunking.chunk_text(" \n ") == []


def test_windows_against_a_plain_version():
    import random

    r = random.Random(6)
    for _ in range(200):
        lines = ["x" * r.choice([0, 3, 40, 200, 900]) for _ in range(r.randrange(1, 40))]
        most, overlap = r.choice([20, 60, 200]), r.choice([0, 10, 40])
        cost, got = [max(1, len(x) // 4) + 1 for x in lines], list(chunking.windows(lines, most, overlap))
        assert got[0][0] == 0 and got[-1][1] == len(lines)
        for k, (a, z) in enumerate(got):
            assert z == a + 1 or sum(cost[a:z]) <= most
            assert z == len(lines) or sum(cost[a : z + 1]) > most
            if k:
                before, end = got[k - 1]
                carried = [n for n in range(end - before) if sum(cost[end - n : end]) >= overlap] if overlap else [0]
                assert a == max(before + 1, end - (carried[0] if carried else end - before))


def test_pages(spark):
    pages = [(1, "Cover\n" + "front matter words " * 9), (2, " "), (3, "First  Part\n" + "body of the part " * 9 + "\nSecond\n" + "body of the second " * 9), (4, "tail " * 40)]
    got = chunking.chunk_pages(pages, [(1, "first part", 2), (2, "Second", 3), (2, "Absent", 4)])
    assert [(c[1], c[2], c[3]) for c in got] == [(1, 1, None), (3, 3, "first part"), (3, 3, "first part > Second"), (4, 4, "first part > Absent")]
    assert [(c[1], c[3]) for c in chunking.chunk_pages([(1, "x"), (2, ""), (3, "y")])] == [(1, "page 1"), (3, "page 3")]
    df = spark.createDataFrame([(1, [(1, "x"), (3, "y")], None), (2, None, None)], "id int, pages array<struct<number:int,text:string>>, outline array<struct<level:int,title:string,page:int>>")
    assert [(r.id, r.start_line, r.heading) for r in chunking.page_chunks(df, "id").collect()] == [(1, 1, "page 1"), (1, 3, "page 3")]


def test_markup():
    assert markup.html_to_markdown("<h2>A&amp;B</h2><script>x</script><ul><li>one<li><b>two</b></ul>") == "## A&B\n\n- one\n- **two**"
    assert markup.tree_to_markdown('{"type":"doc","content":[{"type":"heading","attrs":{"level":2},"content":[{"type":"text","text":"T"}]},{"type":"bulletList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"x"}]}]}]}]}') == "## T\n\n- x"
    assert markup.wiki_to_markdown("h1. T\n*b* {{c}} [l|http://x]") == "# T\n**b** `c` [l](http://x)"
    assert markup.wiki_to_markdown("{code}a *b* c{code}") == "```\na *b* c\n```"
    assert markup.wiki_to_markdown("see {noformat}\n_x_\n{noformat} _y_\n||a||b||\n|1|*2*|\n# one\n## two\nbq. said\n{panel:title=Hm}\nin\n{panel}") == "see ```\n_x_\n``` *y*\n| a | b |\n| --- | --- |\n| 1 | **2** |\n1. one\n  1. two\n> said\n> in"
    assert markup.tree_to_markdown("no json") is None and markup.html_to_markdown(None) is None and markup.wiki_to_markdown(None) is None


def test_scope_fails_closed(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0), (None, 0), ("a", None)], "source_id string, classification_rank int")
    p = spark.createDataFrame([("a", 1)], "source_id string, ceiling int")
    assert [tuple(r) for r in scope.scoped(rows, p).collect()] == [("a", 1)]
    assert scope.scoped(rows, p.limit(0)).count() == 0
    with pytest.raises(ValueError, match="owner"):
        scope.owned(rows, "x' OR 1=1")


def test_fusion(spark):
    lists = {0: ["kelp", "reef", "dune", "moor"], 1: ["moor", "kelp"], 2: ["fen"]}
    ranks = spark.createDataFrame([(n, i, r) for n, ids in lists.items() for r, i in enumerate(ids, 1)], "list int, id string, rank int")
    got = retrieval.fuse(ranks).orderBy(F.desc("score"), "best", "id").collect()
    want = {i: sum(1 / (60 + ids.index(i) + 1) for ids in lists.values() if i in ids) for i in {x for ids in lists.values() for x in ids}}
    assert {r.id: pytest.approx(r.score) for r in got} == want
    assert [r.id for r in got] == ["kelp", "moor", "fen", "reef", "dune"] and got[1].lists == [0, 1] and got[2].lists == [2]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0])], "chunk_id int, embedding array<float>")
    assert [(r.chunk_id, r.score) for r in retrieval.vector_top_k(df, [1.0, 0.0], 3).collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_walk_and_cleaning(spark):
    pairs = spark.createDataFrame([(a, b) for x, y in [("a", "b"), ("b", "c"), ("c", "d")] for a, b in ((x, y), (y, x))], "a string, b string")
    assert {tuple(r) for r in graph.walk(spark.createDataFrame([("a",)], "key string"), pairs, 9).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    found = spark.createDataFrame([(1, i, f"Name {i % 30}", "service" if i < 50 else "other", "d" * 900) for i in range(60)], "doc int, pos int, name string, type string, description string")
    got = graph.clean_extraction(found, ["service"]).collect()
    assert len(got) == 25 and all(len(r.description) == 500 for r in got)


def test_ingest_lifecycle(spark):
    schema = "path string, content_hash string, title string, url string, restricted boolean"
    items = spark.createDataFrame([("a", "1", "t", None, False), ("b", "2", "new", None, False), ("c", "3", "t", None, True), ("e", "9", None, None, False)], schema)
    stored = spark.createDataFrame([("a", "1", "t", None), ("b", "2", "old", None), ("c", "3", "t", None), ("d", "4", "t", None)], "path string, content_hash string, title string, url string")
    actions = {r.path: r.action for r in ingest.changes(items, stored).collect()}
    assert actions == {"a": "unchanged", "b": "metadata", "c": "restricted", "d": "deleted", "e": "changed"}
    assert {r.path: r.action for r in ingest.changes(items, stored, listing_complete=False).collect()}["d"] == "unchanged"
    assert ingest.counters(ingest.changes(items, stored)).first().asDict() == {"changed": 1, "metadata": 1, "unchanged": 1, "restricted": 1, "deleted": 2}
    cursors = spark.createDataFrame([("s", "t1")], "source_id string, cursor string")
    assert [ingest.save_cursor(cursors, "s", c, e).collect() and ingest.save_cursor(cursors, "s", c, e).first().cursor for c, e in (("t2", 0), ("t2", 1), (None, 0))] == ["t2", "t1", []]


def test_deny_wins(spark):
    roles = spark.createDataFrame([("p", "platform", "a"), ("p", "platform", "b")], "persona string, scope string, role string")
    grants = spark.createDataFrame([("a", "*", "allow"), ("b", "x", "deny")], "role string, tool string, effect string")
    got = policy.granted_tools(roles, grants, spark.createDataFrame([("x",), ("y",)], "tool string")).collect()
    assert {(r.tool, r.allowed) for r in got} == {("x", False), ("y", True)}


def test_limiter(spark):
    second = 1_000_000
    rows = [(1, "u", "t", 0), (2, "u", "t", second), (3, "u", "t", 2 * second), (4, "u", "t", 60 * second), (5, "u", "q", 61 * second), (6, "u", "t", 500 * second), (7, "v", "t", 0)]
    df = spark.createDataFrame(rows, "call_id long, user_id string, tool string, us long")
    got = {r.call_id: (r.allowed, r.retry_after) for r in calls.limit_calls(df, {"*": 2}).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 58), 4: (True, None), 5: (True, None), 6: (True, None), 7: (True, None)}


def test_limiter_tells_the_first_full_scope(spark):
    second = 1_000_000
    rows = [(1, "u", "q", 0), (2, "u", "t", 20 * second), (3, "u", "t", 49 * second)]
    df = spark.createDataFrame(rows, "call_id long, user_id string, tool string, us long")
    got = {r.call_id: (r.allowed, r.retry_after) for r in calls.limit_calls(df, {"*": 2, "t": 1}).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 11)}


def test_limiter_as_a_stream(spark, tmp_path):
    """The same decisions as in batch, a file a trigger; denied calls don't count."""
    second, schema = 1_000_000, "call_id long, user_id string, tool string, us long"
    batches = [[(1, "u", "t", 0), (2, "u", "t", second), (7, "v", "t", 0)], [(3, "u", "t", 2 * second)], [(4, "u", "t", 61 * second), (5, "u", "q", 62 * second)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = calls.limit_stream(stream, {"*": 2}).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r.call_id: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.call_id: r.allowed for r in calls.limit_calls(spark.createDataFrame(sum(batches, []), schema), {"*": 2}).collect()}


def test_drift(spark):
    parts = spark.createDataFrame([("a", "src/a", "docs/a.md"), ("b", "src/b/", "docs/b.md"), ("c", "", "docs/c.md")], "component string, code_path string, concept_path string")
    changed = spark.createDataFrame([("src/application.py",), ("src/b/x",), ("docs/b.md",)], "path string")
    assert {tuple(r) for r in rollups.drift(parts, changed).collect()} == {("a", 1), ("c", 3)}


def test_shared_folder_is_wanted_on_a_cluster(spark):
    from types import SimpleNamespace

    from corvane import session

    fake = lambda master, conf=None, other=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf or d), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: other))
    assert session.shared_dir(fake("local[4]")) == session.LOCAL_SHARED_DIR
    assert session.shared_dir(fake("spark://x:7077", "hdfs://y/z/")) == "hdfs://y/z" and session.shared_dir(fake("yarn", None, "hdfs://c")) == "hdfs://c"
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(fake(master))


def test_metrics_over_files(spark):
    """Hits of the same file count once; mrr is the mean over expected files."""
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "a"), (1, 4, "b")], "q int, rank int, doc string")
    expected = spark.createDataFrame([(1, "a", "g"), (1, "b", "g"), (1, "c", "g")], "q int, doc string, g string")
    m = retrieval.retrieval_metrics(hits, expected, ["g"]).first()
    assert m.mrr == pytest.approx((1 / 2 + 1 / 3) / 3) and m.recall_3 == pytest.approx(2 / 3)


def test_broken_links(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c")], "path string, target string")
    assert [tuple(r) for r in rollups.broken_links(links, spark.createDataFrame([("b",)], "path string")).collect()] == [("a", "c")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["rls_scan", "hybrid_search", "graph_search", "change_detect", "authorize_matrix", "readable_sources", "merge_findings", "argument_limits", "skill_decisions", "document_flow", "team_match", "extraction_relations", "graph_edges_written", "connection_status", "retrieval_metrics"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    got = df.select(*sorted(df.columns)).collect()
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    rows = [tuple(r[names.index(c)] for c in sorted(df.columns)) for r in want.fetchall()]
    norm = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(repr, map(norm, map(tuple, got)))) == sorted(map(repr, map(norm, rows)))
