"""Committed table versions: atomic across tables, readable by number, conflicts by key range, killed at every step."""

import pytest
from pyspark.sql import functions as F

from tracelens import session
from tracelens.plans import jobs
from tracelens.sources import files as sf
from tracelens.sources import store
from tests.test_jobs import exports  # noqa: F401  (fixture)

ISSUE = "repo_id bigint, number bigint, title string, body string, state string, issue_id bigint, created_at timestamp"


def _issues(spark, rows):
    return spark.createDataFrame([(r, n, t, None, "open", n, None) for r, n, t in rows], ISSUE)


def _titles(df):
    return {(r.repo_id, r.number): r.title for r in df.collect()}


def test_versions_stay_readable(spark, tmp_dir):
    root = f"{tmp_dir}/s"
    assert store.read(spark, root, "issue").count() == 0
    store.merge(spark, _issues(spark, [(1, 1, "a"), (2, 1, "b")]), root, "issue")
    before = store.read(spark, root, "issue")
    store.merge(spark, _issues(spark, [(2, 1, "c"), (2, 2, "d")]), root, "issue")
    # A reader that began earlier still sees its version.
    assert _titles(before) == _titles(store.read(spark, root, "issue", 1)) == {(1, 1): "a", (2, 1): "b"}
    assert _titles(store.read(spark, root, "issue")) == {(1, 1): "a", (2, 1): "c", (2, 2): "d"}
    assert store.versions(spark, root) == [1, 2]
    with pytest.raises(ValueError, match="no version 7"):
        store.read(spark, root, "issue", 7)


def test_tables_change_together(spark, tmp_dir):
    root = f"{tmp_dir}/s"
    t = store.begin(spark, root)
    t.append(spark.createDataFrame([(1, 1, 3)], "repo_id bigint, issue_number bigint, n_results bigint"), "scored")
    t.merge(_issues(spark, [(1, 1, "a")]), "issue")
    assert store.read(spark, root, "scored").count() == store.read(spark, root, "issue").count() == 0
    assert t.commit() == 1
    assert store.read(spark, root, "scored").count() == store.read(spark, root, "issue").count() == 1
    assert store.begin(spark, root).commit() == 1


def test_overlapping_writers_conflict_and_others_are_redone(spark, tmp_dir):
    root = f"{tmp_dir}/s"
    store.merge(spark, _issues(spark, [(5, 1, "old")]), root, "issue")
    a, b, c = (store.begin(spark, root) for _ in range(3))
    a.merge(_issues(spark, [(1, 1, "a"), (3, 1, "a")]), "issue")
    b.merge(_issues(spark, [(3, 1, "b")]), "issue")
    c.merge(_issues(spark, [(5, 1, "c"), (9, 1, "c")]), "issue")
    a.commit()
    with pytest.raises(store.Conflict):
        b.commit()
    assert c.commit() == 3  # other keys: merged into the first writer's version
    assert _titles(store.read(spark, root, "issue")) == {(1, 1): "a", (3, 1): "a", (5, 1): "c", (9, 1): "c"}


def test_shared_appends_do_not_conflict(spark, tmp_dir):
    root = f"{tmp_dir}/s"
    row = spark.createDataFrame([("x", "", "tfidf", "1", None, "t")], store.TABLES["feature"])
    a, b = store.begin(spark, root), store.begin(spark, root)
    a.append(row, "feature")
    b.append(row, "feature")
    a.commit(), b.commit()
    assert store.read(spark, root, "feature").count() == 2
    assert store.compact(spark, root, "feature") == 3
    assert store.read(spark, root, "feature").count() == 2 and len(store.version(spark, root).tables["feature"]) == 1


def test_commit_files_are_never_replaced(spark, tmp_dir):
    path = f"{tmp_dir}/c/1.json"
    assert session.create_file(spark, path, "one") and not session.create_file(spark, path, "two")
    assert open(path).read() == "one" and session.list_names(spark, f"{tmp_dir}/c") == ["1.json"]


def test_vacuum_keeps_what_versions_name(spark, tmp_dir):
    root = f"{tmp_dir}/s"
    for i in range(4):
        store.merge(spark, _issues(spark, [(1, 1, f"t{i}")]), root, "issue")
    lost = store.begin(spark, root)
    lost.append(_issues(spark, [(7, 7, "lost")]), "issue")
    # Versions 3 and 4 stay, with their folders and those of running transactions; what only older ones name goes.
    assert store.vacuum(spark, root, keep=2)
    assert store.versions(spark, root) == [3, 4]
    assert _titles(store.read(spark, root, "issue", 3)) == {(1, 1): "t2"}
    lost.commit()
    assert _titles(store.read(spark, root, "issue")) == {(1, 1): "t3", (7, 7): "lost"}


class Killed(Exception):
    pass


def _dying(monkeypatch, where, after):
    """The named write fails after so many calls."""
    real, left = getattr(store, where), [after]

    def write(*args):
        if left[0] == 0:
            raise Killed
        left[0] -= 1
        return real(*args)

    monkeypatch.setattr(store, where, write)
    return lambda: monkeypatch.setattr(store, where, real)


@pytest.mark.parametrize("where,after", [("write_rows", 0), ("write_rows", 1), ("write_rows", 2), ("create_file", 0)])
def test_transaction_killed_at_every_step(spark, tmp_dir, monkeypatch, where, after):
    """Two merges and an append make three writes and a commit: whichever dies, readers see the old version."""
    root = f"{tmp_dir}/s"
    store.merge(spark, _issues(spark, [(1, 1, "old")]), root, "issue")

    def run():
        t = store.begin(spark, root)
        t.merge(_issues(spark, [(1, 1, "new"), (1, 2, "new")]), "issue")
        t.merge(spark.createDataFrame([(1, "n", None, None, 1)], store.TABLES["repository"]), "repository")
        t.append(spark.createDataFrame([(1, 1, 3)], "repo_id bigint, issue_number bigint, n_results bigint"), "scored")
        t.commit()

    back = _dying(monkeypatch, where, after)
    with pytest.raises(Killed):
        run()
    back()
    assert _titles(store.read(spark, root, "issue")) == {(1, 1): "old"}
    assert store.read(spark, root, "repository").count() == store.read(spark, root, "scored").count() == 0
    run()
    assert _titles(store.read(spark, root, "issue")) == {(1, 1): "new", (1, 2): "new"}
    assert store.read(spark, root, "scored").count() == 1 and store.versions(spark, root) == [1, 2]


def test_scoring_killed_before_its_commit(spark, tmp_dir, exports, monkeypatch):  # noqa: F811
    """Results and marks are both there or both missing, and the next run scores every issue once."""
    sources = {k: v for k, v in exports.items() if k != "snapshot_dir"}
    tree = sf.read_source_tree(spark, exports["snapshot_dir"], 1, "s1")
    root = f"{tmp_dir}/s"
    jobs.ingest(spark, sources, root)
    back = _dying(monkeypatch, "create_file", 1)  # the features are committed first
    with pytest.raises(Killed):
        jobs.score_issues(spark, root, tree, k=3)
    back()
    assert store.read(spark, root, "feature").count() == 2
    assert store.read(spark, root, "result").count() == store.read(spark, root, "scored").count() == 0
    jobs.score_issues(spark, root, tree, k=3)
    assert store.read(spark, root, "feature").count() == 2
    assert store.read(spark, root, "scored").count() == 2 and store.read(spark, root, "result").count() == 4


def test_ingest_stores_the_rejects_of_every_export(spark, tmp_dir, exports):  # noqa: F811
    sources = {k: v for k, v in exports.items() if k != "snapshot_dir"}
    for name in ("issues", "tree", "pulls"):
        with open(sources[name], "a") as f:
            f.write(f"broken {name}\n")
    root = f"{tmp_dir}/s"
    for _ in range(2):  # a repeated ingest adds none
        jobs.ingest(spark, sources, root)
        got = store.read(spark, root, "reject").collect()
        assert sorted(r.error for r in got) == ["export issues: broken issues", "export pulls: broken pulls", "export tree: broken tree"]
    assert store.read(spark, root, "issue").where(F.col("number") == 10).count() == 1
