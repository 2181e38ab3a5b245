"""Objects, manifests and sources of repositories read without a checkout; hash-tree differences."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tracelens.operators import hashtree as ht
from tracelens.operators import snapshots as sn
from tracelens.sources import files
from tracelens.sources import gitobjects as go

ENV = {**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@example.com", "GIT_COMMITTER_NAME": "a",
       "GIT_COMMITTER_EMAIL": "a@example.com", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}


def git(folder, *args):
    return subprocess.run(["git", *args], cwd=folder, env=ENV, check=True, capture_output=True, text=True).stdout.strip()


def write(folder, path, text):
    os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
    with open(f"{folder}/{path}", "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """Five commits: long files edited each time (chains of deltas), packed twice, the last commit loose."""
    folder = str(tmp_path_factory.mktemp("work"))
    git(folder, "init", "-q", "-b", "main")
    shas = []
    for step in range(5):
        lines = [f"def f{i}(x):\n    return x + {i * (step + 1) if i % 40 == step else i}\n" for i in range(300)]
        write(folder, "src/deep/er/big.py", "\n".join(lines))
        write(folder, f"src/mod{step}.py", f"naïve = {step}\n")
        write(folder, "src/same.py", "same = 1\n")
        write(folder, "empty.py", "")
        write(folder, "notes.txt", f"{step}")
        if step == 3:
            os.remove(f"{folder}/src/mod0.py")
            write(folder, "notes.txt.d/x.py", "x = 1\n")
        git(folder, "add", "-A")
        git(folder, "commit", "-q", "-m", f"step {step}\n\nparent of nothing")
        shas.append(git(folder, "rev-parse", "HEAD"))
        if step == 1:
            git(folder, "repack", "-q", "-d")
        if step == 3:
            git(folder, "repack", "-q", "-a", "-f", "--depth=20", "--window=50")
    return folder, shas


@pytest.fixture(scope="module")
def objects(spark, repository):
    return go.read_objects(spark, f"{repository[0]}/.git", repo_id=7)


def test_every_object_equals_git(repository, objects):
    folder, _ = repository
    listed = git(folder, "cat-file", "--batch-all-objects", "--batch-check=%(objectname) %(objecttype) %(objectsize)")
    want = sorted(tuple(line.split()) for line in listed.splitlines())
    rows = objects.select("sha", "kind", F.octet_length("content").cast("string").alias("n")).collect()
    assert sorted((r.sha, r.kind, r.n) for r in rows) == want
    chains = subprocess.run("git verify-pack -v .git/objects/pack/*.idx | grep -c 'chain length'", shell=True, cwd=folder,
                            capture_output=True, text=True).stdout
    assert int(chains) >= 2  # deltas on deltas


def test_commits(repository, objects):
    folder, shas = repository
    got = {r.sha: r for r in go.commits(objects).collect()}
    assert set(got) == set(shas)
    assert got[shas[0]].parents == [] and got[shas[3]].parents == [shas[2]]
    assert got[shas[3]].message == "step 3\n\nparent of nothing\n"
    assert got[shas[2]].tree == git(folder, "rev-parse", f"{shas[2]}^{{tree}}")


def test_manifests_and_sources_equal_the_folder_reader(spark, repository, objects, tmp_path):
    folder, shas = repository
    manifest = go.manifests(go.commits(objects), go.tree_entries(objects))
    trees = go.source_trees(objects, manifest).collect()
    for sha in shas:
        listed = git(folder, "ls-tree", "-r", sha).splitlines()
        want = sorted((line.split("\t")[1], line.split()[2]) for line in listed)
        got = manifest.where(F.col("snapshot_sha") == sha).select("path", "blob_sha").collect()
        assert sorted(map(tuple, got)) == want
    out = str(tmp_path / "checkout")
    os.makedirs(out)
    git(folder, f"--work-tree={out}", "checkout", "-q", shas[3], "--", ".")
    want = files.read_source_tree(spark, out, 7, shas[3]).collect()
    assert sorted(map(tuple, want)) == sorted(tuple(r) for r in trees if r.snapshot_sha == shas[3])


def test_many_bare_repositories(spark, repository, tmp_path):
    for repo_id in ("11", "12"):
        git(repository[0], "clone", "-q", "--bare", repository[0], str(tmp_path / repo_id))
    both = go.read_objects(spark, str(tmp_path))
    counts = {r.repo_id: (r.n, r.d) for r in both.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sha").alias("d")).collect()}
    n = len(git(repository[0], "rev-list", "--objects", "--all").splitlines())
    assert counts == {11: (n, n), 12: (n, n)}


def test_tree_diff_opens_only_what_differs(spark, repository, objects):
    folder, shas = repository
    commits = {r.sha: r.tree for r in go.commits(objects).collect()}
    entries = go.tree_entries(objects).where(F.col("mode") != go.SUBMODULE_MODE).select(
        "repo_id", "tree", "name", (F.col("mode") == go.DIR_MODE).alias("is_dir"), F.col("sha").alias("hash"))
    pairs = [(7, i, commits[shas[i]], commits[shas[j]]) for i, j in [(0, 1), (2, 3), (3, 4), (4, 4)]]
    pairs = spark.createDataFrame(pairs, "repo_id long, pair int, old_tree string, new_tree string")
    diff, opened = ht.tree_diff(pairs, entries, key="pair", scope="repo_id")
    got = {(r.pair, r.path, r.status) for r in diff.collect()}
    names = {"A": "added", "D": "removed", "M": "modified"}
    want = set()
    for i, j in [(0, 1), (2, 3), (3, 4)]:
        for line in git(folder, "diff", "--no-renames", "--name-status", shas[i], shas[j]).splitlines():
            want.add((i, line.split("\t")[1], names[line[0]]))
    assert got == want
    assert opened.agg(F.sum("n_trees")).first()[0] == 2 * 3 * 4 + 1  # root, src, deep, er of three pairs, one new folder


def test_cut_pack_and_missing_base_are_errors(spark, repository, tmp_path):
    folder, _ = repository
    packs = f"{folder}/.git/objects/pack"
    broken = tmp_path / "objects" / "pack"
    os.makedirs(broken)
    for name in os.listdir(packs):
        with open(f"{packs}/{name}", "rb") as f:
            data = f.read()
        if name.endswith(".pack"):
            data = data[:len(data) // 2]
        (broken / name).write_bytes(data)
    with pytest.raises(Exception, match="cut off|index out of range|not"):
        go.read_objects(spark, str(tmp_path), repo_id=1).count()
    whole = spark.createDataFrame([(1, "a", "blob", bytearray(b"x"))], go.OBJECT_SCHEMA)
    lone = spark.createDataFrame([(1, "b", "zz", bytearray(b""))], "repo_id long, sha string, base_sha string, content binary")
    with pytest.raises(ValueError, match="without their base"):
        go._resolve(whole, lone)
    with pytest.raises(Exception, match="no such tree"):
        commit = spark.createDataFrame([(1, "c", "dd")], "repo_id long, sha string, tree string")
        go.manifests(commit, spark.createDataFrame([], go.TREE_SCHEMA)).count()


def test_no_objects(spark, tmp_path):
    os.makedirs(tmp_path / "objects" / "pack")
    none = go.read_objects(spark, str(tmp_path), repo_id=1)
    assert none.count() == 0 and go.commits(none).count() == 0


def test_delta_steps():
    assert go.apply_delta(b"hello world", bytes([11, 9, 0x91, 6, 5, 4]) + b" abc") == b"world abc"
    with pytest.raises(ValueError, match="another base"):
        go.apply_delta(b"x", bytes([11, 1, 1]) + b"a")


def test_hash_tree_equals_the_full_join(spark):
    old = [("a/b/x.py", "1"), ("a/b/y.py", "2"), ("a/c/z.py", "3"), ("top.py", "4"), ("k/l/m/n.py", "5"), ("q", "8")]
    new = [("a/b/x.py", "1"), ("a/b/y.py", "9"), ("a/c/z.py", "3"), ("top.py", "4"), ("k/l/m/n.py", "5"), ("q/r", "8"), ("a/w", None)]
    schema = "path string, blob_sha string"
    both = (spark.createDataFrame(old, schema).withColumn("side", F.lit("old"))
            .unionByName(spark.createDataFrame(new, schema).withColumn("side", F.lit("new"))))
    both = both.where(F.col("blob_sha").isNotNull())
    entries, roots = ht.hash_tree(both, "side")
    tree = {r.side: r.tree for r in roots.collect()}
    pairs = spark.createDataFrame([(tree["old"], tree["new"])], "old_tree string, new_tree string")
    diff, opened = ht.tree_diff(pairs, entries)
    want = sn.snapshot_diff(both.where("side = 'old'"), both.where("side = 'new'"))
    columns = ["path", "old_blob", "new_blob", "status"]
    assert sorted(map(tuple, diff.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)
    assert [tuple(r) for r in opened.collect()] == [(0, 2, 8), (1, 3, 5), (2, 2, 4)]  # k/ and a/c/ stay closed
    same, none = ht.tree_diff(spark.createDataFrame([(tree["old"], tree["old"])], "old_tree string, new_tree string"), entries)
    assert same.count() == 0 and none.count() == 0
    empty, no_roots = ht.hash_tree(both.where("false"), "side")
    assert empty.count() == 0 and no_roots.count() == 0
