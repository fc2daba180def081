import json
import os
import shutil
import subprocess

import pytest

from corvane.sources import loaders
from corvane.sources.loaders import Source, load


def write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def lines(root, rows):
    root.mkdir()
    (root / "part.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(root)


def by_path(df):
    return {r.path: r for r in df.collect()}


def test_unknown_type(spark):
    with pytest.raises(ValueError, match="no loader"):
        load(spark, Source("ftp", "x"))
    with pytest.raises(Exception, match="no folder"):
        load(spark, Source("local_folder", "/none/there")).items.collect()


def test_folder(spark, tmp_path):
    write(tmp_path, {"a.md": b"# a", "sub/b.txt": b"b", "sub/deep/er/c.txt": b"c", "sub/x.bin": b"\0\1", "p.pdf": b"%PDF-1.4 x", "bad.txt": b"\xff\xfe", "long.txt": b"x" * 1_000_001, "empty.txt": b"", "no/n.txt": b"n"})
    got = load(spark, Source("local_folder", str(tmp_path), exclude=("no/**",)))
    items = by_path(got.items)
    assert {p: (r.kind, r.text) for p, r in items.items()} == {"a.md": ("text", "# a"), "sub/b.txt": ("text", "b"), "sub/deep/er/c.txt": ("text", "c"), "p.pdf": ("pdf", ""), "empty.txt": ("text", "")}
    assert bytes(items["p.pdf"].content) == b"%PDF-1.4 x" and items["a.md"].content is None and not got.incremental
    # What isn't read is there nevertheless; what is too long isn't.
    assert {r.path for r in got.ids.collect()} == set(items) | {"sub/x.bin", "bad.txt"}
    assert load(spark, Source("local_folder", str(tmp_path), include=("*.none",))).items.count() == 0


@pytest.mark.parametrize("depth,parts", [(0, 3), (1, 2), (3, 200)])
def test_listing_deals_each_file_once(spark, tmp_path, depth, parts):
    write(tmp_path, {f"{a}/{b}/{c}.txt": b"x" for a in "abc" for b in "de" for c in range(3)} | {"top.txt": b"y", "a/mid.txt": b"z"})
    loaders.register(spark)
    got = spark.read.format("corvane_listing").options(path=str(tmp_path), depth=str(depth), parts=str(parts)).load()
    assert sorted(r.path for r in got.collect()) == sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.txt"))


def test_objects_of_known_generations_are_not_read(spark, tmp_path):
    write(tmp_path, {"a.txt": b"1", "b.txt": b"2", "c.bin": b"\0"})
    source = Source("gcs", f"file://{tmp_path}")
    first = load(spark, source)
    assert set(by_path(first.items)) == {"a.txt", "b.txt"} and not first.incremental
    cursor = spark.createDataFrame(first.cursor.collect(), first.cursor.schema)
    # The same time and size is the same generation: not read, though the content is another.
    stat = os.stat(tmp_path / "a.txt")
    write(tmp_path, {"a.txt": b"9", "b.txt": b"22", "new.txt": b"n"})
    os.utime(tmp_path / "a.txt", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (tmp_path / "c.bin").unlink()
    second = load(spark, source, cursor)
    assert second.incremental and {p: r.text for p, r in by_path(second.items).items()} == {"b.txt": "22", "new.txt": "n"}
    assert {r.path for r in second.ids.collect()} == {"a.txt", "b.txt", "new.txt"}
    # Another selection: a cursor that doesn't count.
    other = load(spark, Source("gcs", f"file://{tmp_path}", include=("*.txt",)), cursor)
    assert not other.incremental and by_path(other.items)["a.txt"].text == "9"


def test_listing_as_a_stream(spark, tmp_path):
    loaders.register(spark)
    data, check = tmp_path / "data", str(tmp_path / "check")
    seen = []

    def take():
        stream = spark.readStream.format("corvane_listing").options(path=str(data), settle="0").load()
        stream.writeStream.option("checkpointLocation", check).foreachBatch(lambda b, i: seen.extend(r.path for r in b.collect())).trigger(availableNow=True).start().awaitTermination(120)
        got = sorted(seen)
        seen.clear()
        return got

    write(data, {"a.txt": b"1", "x/b.txt": b"2"})
    assert take() == ["a.txt", "x/b.txt"]
    write(data, {"x/b.txt": b"3", "c.txt": b"4"})
    assert take() == ["c.txt", "x/b.txt"]
    assert take() == []


@pytest.mark.skipif(not shutil.which("git"), reason="the fixture is made by git")
def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@example.org", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    write(tmp_path, {"a.md": b"a", "b/c d.py": b"c", "z.bin": b"\0"})
    git("add", "."), git("commit", "-qm", "1")
    source = Source("git", str(tmp_path), options={"ref": "main", "provider": "github", "web": "https://code.example.org/o/r.git"})
    first = load(spark, source)
    assert by_path(first.items)["b/c d.py"].url == f"https://code.example.org/o/r/blob/{first.details['commit']}/b/c%20d.py"
    cursor = spark.createDataFrame(first.cursor.collect(), first.cursor.schema)
    write(tmp_path, {"a.md": b"aa"})
    git("commit", "-qam", "2")
    write(tmp_path, {"a.md": b"only in the work tree"})
    second = load(spark, source, cursor)
    assert {p: r.text for p, r in by_path(second.items).items()} == {"a.md": "aa"} and second.incremental
    assert {r.path for r in second.ids.collect()} == {"a.md", "b/c d.py", "z.bin"}


def page(id_, above=(), read=(), version=1, **more):
    row = {"id": id_, "title": f"T{id_}", "version": {"number": version}, "ancestors": [{"id": a, "title": f"T{a}"} for a in above], "body": {"storage": {"value": f"<h2>Head</h2><p>Body {id_}</p>"}}, "_links": {"webui": f"/x/{id_}"}}
    return row | ({"restrictions": {"read": {"restrictions": {"user": {"results": list(read)}, "group": {"size": 0}}}}} if read is not None else {}) | more


def test_pages(spark, tmp_path):
    rows = [page("1"), page("2", ["1"]), page("3", ["1", "2"], version=4), page("3", ["1"], version=3), page("4", read=["u"]), page("5", ["4"]), page("6", ["1", "4", "5"]), page("7", read=None), page("8", ["99"]), page("9", title=None, body=None), page(None)]
    source = Source("confluence", lines(tmp_path / "pages", rows), options={"space": "S", "web": "https://w.example.org"})
    got = load(spark, source)
    items = by_path(got.items)
    assert {p for p, r in items.items() if r.restricted} == {"S/4", "S/5", "S/6", "S/7", "S/8"}
    assert all(r.text == "" and r.title is None and r.url is None for r in items.values() if r.restricted)
    assert items["S/3"].text == "# T3\n\nPath: T1 > T2 > T3\n\n## Head\n\nBody 3" and items["S/3"].url == "https://w.example.org/x/3"
    assert items["S/9"].title == "S/9" and items["S/9"].text == "# S/9\n\n"
    assert {r.path for r in got.ids.collect()} == {"S/1", "S/2", "S/3", "S/9"}
    cursor = spark.createDataFrame([(loaders.selection(source), "S/1", "1"), (loaders.selection(source), "S/3", "3"), ("other", "S/2", "1")], "selection string, path string, generation string")
    again = load(spark, source, cursor)
    assert {p for p, r in by_path(again.items).items() if not r.restricted} == {"S/2", "S/3", "S/9"} and again.incremental
    assert load(spark, Source("confluence", lines(tmp_path / "none", []), options={"space": "S"})).items.count() == 0


def issue(key, **fields):
    return {"key": key, "fields": fields}


def test_issues(spark, tmp_path):
    adf = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "bold", "marks": [{"type": "strong"}]}]}]}
    rows = [
        issue("A-1", summary=" Sum ", issuetype={"name": "Bug"}, status={"name": "Open"}, priority=None, components=[{"name": "x"}, {"value": "y"}], labels=["l", "m"], updated="2024",
              issuelinks=[{"type": {"outward": "blocks", "inward": "is blocked by"}, "inwardIssue": {"key": "A-2"}}, {"type": {}, "outwardIssue": {"key": "A-3"}}, {"type": {}}],
              description=adf, comment={"comments": [{"created": "2024-01-02T00:00", "body": "plain"}, {"body": adf}]}),
        issue("A-2", summary="S", updated="1"), issue("A-2", summary="newer", updated="2", description="h2. Wiki"), issue("A-3", security={"name": "s"}, summary="hidden", updated="1"), issue("A-4", security=None), {"key": None}, {"key": "A-5"},
    ]
    folder = lines(tmp_path / "issues", rows)
    got = by_path(load(spark, Source("jira", folder, options={"fields": (*loaders.FIELDS, "comment"), "web": "https://j.example.org/"})).items)
    assert got["A-1"].text == "# A-1: Sum\n\nType: Bug · Status: Open\nComponents: x, y\nLabels: l, m\nLinks: is blocked by A-2; relates to A-3\n\n## Description\n\n**bold**\n\n## Comments\n\n### Comment 2024-01-02\n\nplain\n\n### Comment\n\n**bold**\n"
    assert got["A-2"].text == "# A-2: newer\n\n\n## Description\n\n## Wiki\n" and got["A-2"].title == "A-2: newer"
    assert got["A-3"].restricted and got["A-3"].text == "" and got["A-3"].title is None
    assert got["A-4"].text == "# A-4\n" and got["A-5"].text == "# A-5\n" and got["A-5"].url == "https://j.example.org/browse/A-5" and set(got) == {"A-1", "A-2", "A-3", "A-4", "A-5"}
    assert "Comments" not in by_path(load(spark, Source("jira", folder)).items)["A-1"].text
