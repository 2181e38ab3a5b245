"""End to end: exports -> ingest -> score, sources and the stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracelens.operators import similarity as sim
from tracelens.plans import jobs
from tracelens.sources import files as sf
from tracelens.sources import store
from tracelens.streaming.incremental import start_scoring


def _write_jsonl(path, rows):
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    return path


@pytest.fixture()
def exports(tmp_dir):
    d = tmp_dir
    e = {
        "repositories": _write_jsonl(f"{d}/repos.json", [
            {"id": 1, "full_name": "acme/app", "description": "demo", "language": "Python",
             "stargazers_count": 120, "forks": 3, "size": 10, "topics": ["web", "auth"],
             "html_url": "https://h/acme/app", "subscribers_count": 2, "private": False,
             "archived": False, "pushed_at": "2024-02-01T00:00:00"}]),
        "issues": _write_jsonl(f"{d}/issues.json", [
            {"id": 501, "repo_id": 1, "number": 10, "title": "Login button fails",
             "body": "the login handler rejects valid users", "state": "closed"},
            {"id": 502, "repo_id": 1, "number": 11, "title": "Export report crash",
             "body": None, "state": "closed"}]),
        "pulls": _write_jsonl(f"{d}/pulls.json", [
            {"id": 900, "repo_id": 1, "number": 20, "title": "Fix login", "body": "Fixes #10",
             "state": "closed", "base": {"sha": "s1"}, "html_url": "https://h/acme/app/pull/20",
             "created_at": "2024-01-01T00:00:00", "merged_at": "2024-01-02T00:00:00"},
            {"id": 901, "repo_id": 1, "number": 21, "title": "Report", "body": None,
             "state": "closed", "base": {"sha": "s1"}, "html_url": "https://h/acme/app/pull/21",
             "created_at": "2024-01-03T00:00:00", "merged_at": "2024-01-04T00:00:00"},
            {"id": 902, "repo_id": 1, "number": 22, "title": "WIP closes #10", "body": None,
             "state": "open", "base": {"sha": "s1"}, "html_url": "https://h/acme/app/pull/22",
             "created_at": "2024-01-05T00:00:00", "merged_at": None}]),
        "review_comments": _write_jsonl(f"{d}/review.json", [
            {"id": 1, "repo_id": 1, "pull_number": 21, "seq": 0, "body": "resolves #11"}]),
        "issue_comments": _write_jsonl(f"{d}/icomments.json", [
            {"id": 7, "repo_id": 1, "issue_number": 10, "seq": 0, "body": "seen"},
            {"id": 8, "repo_id": 1, "issue_number": 99, "seq": 0, "body": "unknown issue"}]),
        "pull_files": _write_jsonl(f"{d}/pfiles.json", [
            {"repo_id": 1, "pull_number": 20, "filename": "app/login.py", "sha": "x", "status": "modified",
             "patch": "@@", "additions": 3, "deletions": 1, "changes": 4},
            {"repo_id": 1, "pull_number": 21, "filename": "app/new_report.py", "sha": "y",
             "status": "added", "patch": "@@", "additions": 9, "deletions": 0, "changes": 9}]),
    }
    src = f"{d}/snap"
    os.makedirs(f"{src}/app", exist_ok=True)
    with open(f"{src}/app/login.py", "w") as f:
        f.write('def loginHandler(user):\n    """Check the login of a user."""\n    return validUser(user)\n')
    with open(f"{src}/app/report.py", "w") as f:
        f.write('def exportReport(rows):\n    """Export the report rows."""\n    return rows\n')
    with open(f"{src}/app/readme.txt", "w") as f:
        f.write("not python\n")
    e["tree"] = _write_jsonl(f"{d}/tree.json", [
        {"repo_id": 1, "snapshot_sha": "s1", "type": "dir", "path": "app", "sha": "d"},
        {"repo_id": 1, "snapshot_sha": "s1", "type": "blob", "path": "app/login.py", "sha": "b1"},
        {"repo_id": 1, "snapshot_sha": "s1", "type": "blob", "path": "app/report.py", "sha": "b2"}])
    e["snapshot_dir"] = src
    return e


def test_ingest_and_score(spark, tmp_dir, exports):
    root = f"{tmp_dir}/store"
    jobs.ingest(spark, {k: v for k, v in exports.items() if k != "snapshot_dir"}, root)
    pulls = {r.number: r.issue_number for r in store.read(spark, root, "pull_request").collect()}
    assert pulls == {20: 10, 21: 11}  # open PR 22 is not merged
    assert sorted(r.number for r in store.read(spark, root, "issue").collect()) == [10, 11]
    assert [r.body for r in store.read(spark, root, "comment").collect()] == ["seen"]
    files = {r.path for r in store.read(spark, root, "git_file").collect()}
    assert files == {"app/login.py", "app/report.py", "app/new_report.py"}

    tree = sf.read_source_tree(spark, exports["snapshot_dir"], 1, "s1")
    assert sorted(r.path for r in tree.collect()) == ["app/login.py", "app/report.py"]
    res = jobs.score_issues(spark, root, tree, k=2).collect()
    top = {(r.issue_number, r.rank): r.path for r in res}
    assert top[(10, 1)] == "app/login.py" and top[(11, 1)] == "app/report.py"
    assert all(r.file_id is not None for r in res)
    # A second run scores nothing new, and no feature is recomputed.
    assert jobs.score_issues(spark, root, tree, k=2).count() == 0
    assert store.read(spark, root, "feature").count() == 2


def test_find_repositories(spark):
    repos = spark.createDataFrame(
        [(1, "a/x", "Python", 50, 10, "u1", False), (2, "a/y", "python", 90, 20, "u2", False),
         (3, "a/z", "Go", 99, 5, "u3", False), (4, "a/w", "Python", 70, 1, "u4", True)],
        "repo_id long, full_name string, language string, stars long, size long, url string, private boolean")
    pulls = spark.createDataFrame([(2, "2024-01-01", 5), (2, "2024-01-01", None), (1, None, 3)],
                                  "repo_id long, merged_at string, link long")
    got = [tuple(r) for r in jobs.find_repositories(repos, pulls, 40, "PYTHON", 5).collect()]
    assert sorted(got) == [("a/x", "50", "0", "10", "u1"), ("a/y", "90", "1", "20", "u2")]


def test_stream_scores_once(spark, tmp_dir):
    units = spark.createDataFrame([("s", "u1", "login handler user"), ("s", "u2", "report export")],
                                  "scope string, unit_id string, text string")
    unit_tf = sim.term_counts(units, "unit_id", scope=["scope"])
    inbox, results = f"{tmp_dir}/inbox", f"{tmp_dir}/results"
    spark.createDataFrame([("s", 1, "login fails for user")], "scope string, issue_id long, text string") \
        .write.parquet(f"{inbox}/a")
    q = start_scoring(spark, inbox, unit_tf, results, k=1, name=f"t{os.getpid()}a")
    q.awaitTermination(120)
    got = [(r.issue_id, r.unit_id) for r in spark.read.parquet(results).collect()]
    assert got == [(1, "u1")]
    # the same issue arriving again is not scored twice
    spark.createDataFrame([("s", 1, "login fails for user"), ("s", 2, "export the report")],
                          "scope string, issue_id long, text string").write.parquet(f"{inbox}/b")
    q = start_scoring(spark, inbox, unit_tf, results, k=1, name=f"t{os.getpid()}a")
    q.awaitTermination(120)
    got = sorted((r.issue_id, r.unit_id) for r in spark.read.parquet(results).collect())
    assert got == [(1, "u1"), (2, "u2")]


def test_score_with_embedding_scorer(spark, tmp_dir, exports):
    from tracelens.operators import features as fs

    root = f"{tmp_dir}/store_emb"
    jobs.ingest(spark, {k: v for k, v in exports.items() if k != "snapshot_dir"}, root)
    tree = sf.read_source_tree(spark, exports["snapshot_dir"], 1, "s1")
    res = jobs.score_issues(spark, root, tree, k=2, scorer="embedding",
                            encoder=fs.hashing_encoder(64)).collect()
    assert sorted((r.issue_number, r.rank) for r in res) == [(10, 1), (10, 2), (11, 1), (11, 2)]
    assert all(r.file_id is not None and -1.0 <= r.score <= 1.0 for r in res)


def test_score_with_custom_scorer(spark, tmp_dir, exports):
    """A user scorer over (queries, units) plugs in; TF-IDF written by hand ranks as the built-in."""
    scope = ["repo_id", "snapshot_sha"]

    def my_scorer(queries, units):
        q_tf = sim.term_counts(queries, "issue_number", scope=scope)
        u_tf = sim.term_counts(units, "blob_sha", scope=scope)
        return sim.tfidf_pair_scores(q_tf, u_tf, "issue_number", "blob_sha", scope)

    tree = sf.read_source_tree(spark, exports["snapshot_dir"], 1, "s1")
    ranks = []
    for name, scorer in (("builtin", "tfidf"), ("custom", my_scorer)):
        root = f"{tmp_dir}/store_{name}"
        jobs.ingest(spark, {k: v for k, v in exports.items() if k != "snapshot_dir"}, root)
        res = jobs.score_issues(spark, root, tree, k=2, scorer=scorer)
        ranks.append(sorted((r.issue_number, r.rank, r.path, round(r.score, 9)) for r in res.collect()))
    # issue 11 shares no term with login.py: a scorer of scored pairs emits no row, the built-in fills its list
    assert [r for r in ranks[0] if r[3] > 0] == ranks[1] and len(ranks[1]) == 3 and len(ranks[0]) == 4


def test_stream_backlog_in_small_batches(spark, tmp_dir):
    """A backlog cut into one-file micro-batches scores each issue once, as one pass would."""
    units = spark.createDataFrame([("s", "u1", "login handler user"), ("s", "u2", "report export")],
                                  "scope string, unit_id string, text string")
    unit_tf = sim.term_counts(units, "unit_id", scope=["scope"])
    inbox, results = f"{tmp_dir}/inbox3", f"{tmp_dir}/results3"
    for i, rows in enumerate([[("s", 1, "login fails")], [("s", 2, "export report"), ("s", 1, "login fails")],
                              [("s", 3, "user login handler")]]):
        spark.createDataFrame(rows, "scope string, issue_id long, text string").coalesce(1) \
            .write.parquet(f"{inbox}/f{i}")
    q = start_scoring(spark, inbox, unit_tf, results, k=1, name=f"t{os.getpid()}c", max_files_per_trigger=1)
    q.awaitTermination(180)
    assert q.lastProgress is not None and q.lastProgress["batchId"] >= 2  # three batches at least
    got = sorted((r.issue_id, r.unit_id) for r in spark.read.parquet(results).collect())
    assert got == [(1, "u1"), (2, "u2"), (3, "u1")]


def test_read_source_trees_one_scan(spark, tmp_dir):
    """Many snapshots laid out as root/<repo>/<sha>/... read in one scan, same rows as per-snapshot reads."""
    root = f"{tmp_dir}/trees"
    files = {("1", "s1", "app/a.py"): "x = 1\n", ("1", "s2", "app/a.py"): "x = 2\n",
             ("2", "s9", "b.py"): "y = 'é'\n", ("1", "s2", "notes.txt"): "skip\n"}
    for (repo, sha, path), text in files.items():
        full = os.path.join(root, repo, sha, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)
    got = sorted(tuple(r) for r in sf.read_source_trees(spark, root).collect())
    want = sorted(tuple(r) for repo, sha in (("1", "s1"), ("1", "s2"), ("2", "s9"))
                  for r in sf.read_source_tree(spark, os.path.join(root, repo, sha), int(repo), sha).collect())
    assert got == want and len(got) == 3


def test_score_functions_with_describer(spark, tmp_dir, exports):
    """Function grain: functions described (J1), embedded (J2), best function per file (D5), cached (K1)."""
    from tracelens.operators import features as fs

    root = f"{tmp_dir}/store_fn"
    jobs.ingest(spark, {k: v for k, v in exports.items() if k != "snapshot_dir"}, root)
    tree = sf.read_source_tree(spark, exports["snapshot_dir"], 1, "s1")

    def describer(src):  # stand-in for a summarisation model: split camel case, lower-case
        return src.str.replace(r"([A-Z])", r" \1", regex=True).str.lower()

    res = jobs.score_issues(spark, root, tree, k=1, scorer="embedding", encoder=fs.hashing_encoder(256),
                            grain="function", describer=describer).collect()
    top = {r.issue_number: (r.path, r.unit) for r in res}
    assert top == {10: ("app/login.py", "loginHandler@1"), 11: ("app/report.py", "exportReport@1")}
    n_feat = store.read(spark, root, "feature").count()
    assert n_feat == 4  # two functions and one marker per blob
    # a new issue-free run adds no result and computes no feature again
    assert jobs.score_issues(spark, root, tree, k=1, scorer="embedding", encoder=fs.hashing_encoder(256),
                             grain="function", describer=describer).count() == 0
    assert store.read(spark, root, "feature").count() == n_feat


def test_score_with_text_dictionaries(spark, tmp_dir, exports):
    """I3-I5 in the job: stored file texts go through the dictionaries (here the spelling fix shows)."""
    root = f"{tmp_dir}/store_dict"
    jobs.ingest(spark, {k: v for k, v in exports.items() if k != "snapshot_dir"}, root)
    tree = sf.read_source_tree(spark, exports["snapshot_dir"], 1, "s1")
    acr = spark.createDataFrame([("U", "unit")], "acronym string, expansion string")
    spelling = spark.createDataFrame([("login", 9), ("handler", 9), ("check", 9), ("user", 9), ("export", 9),
                                      ("report", 9), ("rows", 9), ("valid", 9), ("the", 9), ("of", 9)],
                                     "term string, freq long")
    jobs.score_issues(spark, root, tree, k=1, acronyms=acr, spelling=spelling).collect()
    texts = {r.blob_sha: r.text for r in store.read(spark, root, "feature").collect()}
    login = [t for t in texts.values() if "login" in t.lower()][0]
    # names split (H9), then I5: 'a' is unknown and 'of' the closest frequent term
    assert "login Handler" in login and "valid User" in login
    assert "login of of user" in login


def test_second_ingest_and_score_change_nothing(spark, tmp_dir, exports):
    root = f"{tmp_dir}/store"
    sources = {k: v for k, v in exports.items() if k != "snapshot_dir"}
    jobs.ingest(spark, sources, root)
    names = ("repository", "git_file", "issue", "pull_request", "comment", "modified_file", "manifest")
    first = {n: sorted(map(str, store.read(spark, root, n).collect())) for n in names}
    jobs.ingest(spark, sources, root)
    assert {n: sorted(map(str, store.read(spark, root, n).collect())) for n in names} == first
    files = {r.path: r.file_id for r in store.read(spark, root, "git_file").collect()}
    assert all(r.file_id == files[r.path] for r in store.read(spark, root, "modified_file").collect())
    # A newer export wins.
    with open(exports["issues"], "a") as f:
        f.write(json.dumps({"id": 502, "repo_id": 1, "number": 11, "title": "zzzz qqqq", "body": None, "state": "open"}) + "\n")
    jobs.ingest(spark, sources, root)
    assert {r.number: r.title for r in store.read(spark, root, "issue").collect()}[11] == "zzzz qqqq"
    tree = sf.read_source_tree(spark, exports["snapshot_dir"], 1, "s1")
    got = jobs.score_issues(spark, root, tree, k=3).collect()
    # Lists are filled with files of score 0, also for an issue that shares no term with any file.
    assert sorted((r.issue_number, r.rank) for r in got) == [(10, 1), (10, 2), (11, 1), (11, 2)]
    assert [r.score for r in got if r.issue_number == 11] == [0.0, 0.0]
    assert sorted(r.issue_number for r in store.read(spark, root, "scored").collect()) == [10, 11]
    assert jobs.score_issues(spark, root, tree, k=3).count() == 0


def test_source_folder_spellings_and_encodings(spark, tmp_dir):
    for snapshot in ("7/abc", "8/def"):
        os.makedirs(f"{tmp_dir}/trees/{snapshot}/pkg")
        with open(f"{tmp_dir}/trees/{snapshot}/pkg/a.py", "w") as f:
            f.write("x = 1\n")
    with open(f"{tmp_dir}/trees/7/abc/latin.py", "wb") as f:
        f.write(b"# caf\xe9\n")
    for root in (f"{tmp_dir}/trees", f"file:{tmp_dir}/trees", f"file://{tmp_dir}/trees/"):
        rows = sf.read_source_trees(spark, root).collect()
        assert sorted((r.repo_id, r.snapshot_sha, r.path) for r in rows) == [
            (7, "abc", "latin.py"), (7, "abc", "pkg/a.py"), (8, "def", "pkg/a.py")]
        one = sf.read_source_tree(spark, f"{root.rstrip('/')}/7/abc", 7, "abc")
        assert sorted(r.path for r in one.collect()) == ["latin.py", "pkg/a.py"]
        assert [r.path for r in sf.invalid_sources(one).collect()] == ["latin.py"]
    with open(f"{tmp_dir}/trees/stray.py", "w") as f:
        f.write("y = 2\n")
    with pytest.raises(Exception, match="not in a snapshot folder"):
        sf.read_source_trees(spark, f"{tmp_dir}/trees").collect()


def test_broken_export_lines_are_rejects(spark, tmp_dir):
    from tracelens import schemas
    from tracelens.sources import exports as ex

    path = f"{tmp_dir}/issues.json"
    with open(path, "w") as f:
        f.write('{"id": 1, "repo_id": 2, "number": 3, "title": "t"}\n\n{"id": 2, "repo_id"\nnot json\n')
    assert [(r.issue_id, r.number, r.title) for r in ex.read_issues(spark, path).collect()] == [(1, 3, "t")]
    assert [r.line for r in ex.read_rejects(spark, path, schemas.ISSUE_EXPORT).collect()] == ['{"id": 2, "repo_id"', "not json"]


def test_existing_table_is_never_overwritten(spark, tmp_dir):
    root = f"{tmp_dir}/store"
    store.create_if_missing(spark, root)
    spark.createDataFrame([(1, "a", None, None, 3)], store.TABLES["repository"]).write.mode("append").parquet(f"{root}/extra")
    store.append(spark.createDataFrame([(1, "a", None, None, 3)], store.TABLES["repository"]), root, "repository")
    store.create_if_missing(spark, root)
    assert store.read(spark, root, "repository").count() == 1
    store.drop(spark, root, "repository")
    assert not os.path.exists(f"{root}/repository")


def test_python_work_runs_from_another_folder(tmp_dir):
    """The package is sent to the workers: they need not find it on their own path."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r}); import __spark_entry__ as e; from tracelens.session import build_session;"
            "s = build_session('local[2]', 2); print('ROWS', e.queries()['func_names'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"TRACELENS_DRIVER_MEMORY": "2g"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-800:]
