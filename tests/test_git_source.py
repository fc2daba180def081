"""Repositories made here by git, read without it."""

import os
import random
import shutil
import subprocess

import pytest

from corvane.sources import git

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="the fixture is made by git")


def run(repo, *args):
    env = dict(os.environ, GIT_CONFIG_GLOBAL="/dev/null", GIT_CONFIG_NOSYSTEM="1", **{f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "n"), ("EMAIL", "e@example.org"))})
    return subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=env).stdout.decode()


def write(repo, files):
    for name, content in files.items():
        path = repo / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Three commits; the first two are packed with deltas, the third is loose. The work tree then holds something else."""
    root = tmp_path_factory.mktemp("repo")
    run(root, "init", "-q", "-b", "main")
    draw = random.Random(3)
    long = b"\n".join(b"%d line of a file that grows" % draw.randrange(10**9) for _ in range(4000))
    write(root, {"README.md": b"# one\n", "src/a/x.py": long, "src/b.txt": b"b", "empty.txt": b"", "bin.dat": b"\0\1\2"})
    run(root, "add", "."), run(root, "commit", "-qm", "one"), run(root, "tag", "-a", "v1", "-m", "tag")
    write(root, {"src/a/x.py": long + b"\nmore", "src/a/y.py": b"x" + long[5000:], "src/c/d/e.txt": b"deep"})
    run(root, "add", "."), run(root, "commit", "-qm", "two"), run(root, "gc", "-q", "--aggressive")
    (root / "src/b.txt").unlink()
    write(root, {"README.md": b"# three\n", "src/a/x.py": long + b"\nmore and more"})
    (root / "README.md").chmod(0o755)
    run(root, "add", "-A"), run(root, "commit", "-qm", "three")
    write(root, {"README.md": b"never committed", "untracked.txt": b"u"})
    return root


def tree(repo, commit):
    rows = [line.split("\t") for line in run(repo, "ls-tree", "-r", "-l", commit).splitlines()]
    return {name: (meta.split()[2], int(meta.split()[3])) for meta, name in rows}


@pytest.mark.parametrize("name", ["HEAD", "HEAD~1", "v1"])
def test_commit_equals_git(spark, repo, name):
    commit = run(repo, "rev-parse", f"{name}^{{commit}}").strip()
    expected = tree(repo, commit)
    files = git.listing(spark, str(repo), commit)
    assert {r.path: (r.blob, r.size) for r in git.sizes(files, str(repo)).collect()} == expected
    for r in git.contents(files, str(repo)).collect():
        assert bytes(r.content) == subprocess.run(["git", "-C", str(repo), "cat-file", "blob", expected[r.path][0]], capture_output=True, check=True).stdout


def test_packs_hold_deltas(repo):
    own = git.Objects(str(repo))
    kinds = [p.entry(own.packs[0].find(bytes(p.index[p.ids + i * 20 : p.ids + i * 20 + 20])))[0] for p in own.packs for i in range(p.fan[-1])]
    assert {git.BY_PLACE, git.BY_ID} & set(kinds)


def test_changed_equals_git(spark, repo):
    ids = run(repo, "rev-list", "HEAD").split()
    for old, new in [(ids[1], ids[0]), (ids[2], ids[0]), (ids[0], ids[2])]:
        expected = set(run(repo, "diff", "--name-only", "--no-renames", old, new).split())
        assert {r.path for r in git.changed(spark, str(repo), old, new).collect()} == expected
    assert git.changed(spark, str(repo), ids[0], ids[0]).count() == 0
    # A commit that isn't there: all files.
    assert {r.path for r in git.changed(spark, str(repo), "0" * 40, ids[0]).collect()} == set(tree(repo, ids[0]))


def test_names(repo):
    own, head = git.Objects(str(repo)), run(repo, "rev-parse", "HEAD").strip()
    assert own.resolve("main") == own.resolve("refs/heads/main") == own.resolve(head) == own.resolve("HEAD") == head
    assert own.resolve("v1") == run(repo, "rev-parse", "v1^{commit}").strip()
    assert own.resolve("none") is None and own.resolve("../../etc/passwd") is None and own.resolve(own.tree(head)) is None
    with pytest.raises(ValueError):
        git.resolve(str(repo), "none")


def test_borrowed_objects_and_bare(spark, repo, tmp_path):
    run(tmp_path, "clone", "-q", "--bare", "--shared", str(repo), str(tmp_path / "bare"))
    commit = git.resolve(str(tmp_path / "bare"), "main")
    assert {r.path for r in git.listing(spark, str(tmp_path / "bare"), commit).collect()} == set(tree(repo, "HEAD"))


def test_base_by_id_and_bad_delta(repo, tmp_path):
    """Deltas by the base's id, and a long chain."""
    out = tmp_path / "thin"
    run(tmp_path, "init", "-q", "--bare", str(out))
    run(repo, "config", "repack.useDeltaBaseOffset", "false")
    run(repo, "repack", "-q", "-a", "-d", "-f", "--depth=50")
    own = git.Objects(str(repo))
    for name, (id_, size) in tree(repo, "HEAD").items():
        assert len(own.read(id_)[1]) == size == own.size(id_), name
    with pytest.raises(ValueError):
        git.apply_delta(b"abc", bytes([9, 1, 1, 65]))
    assert git.apply_delta(b"abcdef", bytes([6, 4, 0x91, 2, 3, 1, 90])) == b"cdeZ"
    assert own.read("1" * 40) is None and own.size("1" * 40) is None
