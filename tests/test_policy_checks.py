"""Checks of a policy's configuration: nulls, repeats, empty tables and further columns; queries against their SQL are in the registry's test."""

from corvane.operators import policy


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_source_problems(spark):
    schema = "file string, source_id string, owner_team string, level string, kind string, ref string, access_teams array<string>, access_roles array<string>, first_ string"
    rows = [("s/a.yaml", "a", "t", "open", "git", "c", ["t", "t", "z", "z"], ["r"], "x"), ("s/b.yaml", "a", "z", "no", "git", None, ["z"], None, None), ("s/n.yaml", None, None, None, None, "c", None, None, None)]
    sources, teams, levels, roles = frame(spark, rows, schema), frame(spark, [("t",), ("t",)], "team string"), frame(spark, [("open",)], "level string"), frame(spark, [], "role string")
    out = sorted(map(tuple, policy.source_problems(sources, teams, levels, roles).collect()))
    assert out == [
        ("s/a.yaml", "access of unknown role r"), ("s/a.yaml", "access of unknown team z"),
        ("s/b.yaml", "duplicate of s/a.yaml"), ("s/b.yaml", "the id isn't the file's name"),
        ("s/n.yaml", "the id isn't the file's name"), ("s/n.yaml", "unknown level "), ("s/n.yaml", "unknown owner team "),
    ]
    assert policy.source_problems(sources.limit(0), teams, levels, roles).count() == 0


def test_inheritance_cycles(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", None), (None, "f"), ("g", "h")], "role string, parent string")
    assert sorted(map(tuple, policy.inheritance_cycles(edges).collect())) == [(x, ["a", "b", "c"]) for x in "abc"] + [("e", ["e"])]
    chain = frame(spark, [(str(i), str(i + 1)) for i in range(12)] + [("12", "0")], "role string, parent string")
    assert policy.inheritance_cycles(chain).count() == 13
    assert policy.inheritance_cycles(edges.limit(0)).count() == 0


def test_unknown_persona(spark):
    asked = frame(spark, [(1, ["a", "z", "z"], "u"), (2, None, "v"), (3, [], None), (4, [None], "")], "request_id int, app_roles array<string>, user string")
    out = policy.unknown_persona(asked, frame(spark, [("a",)], "role string"), frame(spark, [("u",), ("u",)], "user string"))
    assert {r.request_id: (r.unknown_roles, r.unknown_user) for r in out.collect()} == {1: (["z"], None), 2: ([], "v"), 3: ([], None), 4: ([], None)}
    assert out.limit(0).count() == 0
