"""Answers of small functions on cases made by hand."""

import uuid

from pyspark.sql import functions as F

from corvane.functions import chunking, text
from corvane.operators import audit, graph, rollups


def test_uuid(spark):
    raw = ["12345678-1234-5678-1234-567812345678", "{12345678-1234-5678-1234-56781234ABCD}", "urn:uuid:12345678-1234-5678-1234-567812345678", "12345678123456781234567812345678", "1234", "", None, "g" * 32, "12345678-1234-5678-1234-56781234567", "{12345678123456781234567812345678"]

    def plain(x):
        try:
            return str(uuid.UUID(str(x)))
        except ValueError:
            return None

    found = spark.createDataFrame([(x,) for x in raw], "x string").select("x", text.uuid_or_null(F.col("x")).alias("u")).collect()
    assert {r.x: r.u for r in found} == {x: plain(x) for x in raw}


def test_deep_link(spark):
    one = spark.range(1).select(text.deep_link(F.lit("github"), F.lit("https://h.example/o/r.git"), F.lit("c0"), F.lit("a~b*c d/é+.md")).alias("x")).first()
    assert one.x == "https://h.example/o/r/blob/c0/a~b%2Ac%20d/%C3%A9%2B.md"


def test_cache_key_of_different_lists(spark):
    key = lambda types, relations: graph.cache_key("1", "m", types, relations, F.lit("t"))
    lists = [(["a,b"], []), (["a", "b"], []), (["a"], ["b"]), ([], ["a", "b"]), ([], [])]
    row = spark.range(1).select(*[key(*x).alias(str(i)) for i, x in enumerate(lists)], key(["b", "a"], []).alias("turned")).first()
    assert len(set(row[:5])) == 5 and row["turned"] == row["1"]


def test_strategy():
    of = {"a/b.MD": "markdown", "b.markdown": "fixed", ".md": "fixed", "x/.py": "fixed", "x.tf": "code", "x.py.txt": "fixed", None: "fixed", "md": "fixed"}
    assert {p: chunking.strategy_of(p, None) for p in of} == of
    assert chunking.strategy_of("x.py", "text/markdown") == "markdown"


def test_findings(spark):
    rows = [(" Major ", "t" * 300, " a\x00b‮c\nd ", "w" * 200, None), ("other", "t", "d", "w", "s")]
    one = rollups.clean_findings(spark.createDataFrame(rows, "severity string, title string, detail string, `where` string, suggestion string")).collect()
    assert [tuple(r) for r in one] == [("major", "t" * 199 + "…", "a b c\nd", "w" * 200, "")]


def test_auth_failure(spark):
    import base64
    import json

    good = {"oid": "U", "tid": "t", "iss": "i", "aud": "a", "scp": "read write", "exp": 2000}
    token = lambda claims: "x." + base64.urlsafe_b64encode(json.dumps(claims).encode()).decode().rstrip("=") + ".y"
    cases = {None: "missing_token", "": "missing_token", "Basic " + token(good): "malformed_token", "Bearer": "malformed_token", "Bearer a.b": "malformed_token", "Bearer a.!!.c": "malformed_token", "Bearer " + token(good) + ".z": "malformed_token"}
    for name, value, reason in (("oid", "B1", "blocked"), ("exp", 10, "expired"), ("tid", "u", "wrong_tenant"), ("iss", None, "wrong_issuer"), ("aud", "z", "wrong_audience"), ("scp", "", "missing_scope"), ("jti", "é?", "invalid_token")):
        cases["BEARER " + token(good | {name: value})] = reason
    frame = spark.createDataFrame([(h,) for h in cases], "h string")
    found = frame.select("h", audit.auth_failure(F.col("h"), F.lit(1000.0), ["b1"], "t", "i", ["a"], ["read"]).alias("r")).collect()
    assert {r.h: r.r for r in found} == cases


def test_tool_payloads(spark):
    of = {
        None: None, "": None, "{": None, "1": None, '"x"': None, "null": None, "[{}]": None, "{}": "{}",
        '{"structuredContent": [1], "content": "x"}': '{"content":"x","structuredContent":[1]}',
        '{"structuredContent": {}}': "{}",
        '{"structuredContent": {"result": 1}}': '{"result":1}',
        '{"structuredContent": {"result": {"a": {"result": {}}}}, "content": [{"text": "{}"}]}': '{"a":{"result":{}}}',
        '{"content": []}': None, '{"content": [1, null, {"text": "[1]"}]}': None, '{"content": [{"text": ""}]}': None,
        '{"content": [{"text": "{\\"a\\": [null]}"}]}': '{"a":[null]}',
    }
    df = spark.createDataFrame([(i, raw) for i, raw in enumerate(of)], "i int, raw string")
    got = {r.i: r.p for r in df.select("i", F.to_json(text.tool_payload(F.col("raw"))).alias("p")).collect()}
    assert [got[i] for i in range(len(of))] == list(of.values())
