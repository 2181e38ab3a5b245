"""Snapshot diff (G3), base-commit chain (E3), blob ids, feature store."""

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelens.operators import features as fs
from tracelens.operators import snapshots as sn


def test_git_blob_sha(spark):
    data = "print('héllo')\n"
    raw = data.encode()
    want = hashlib.sha1(b"blob %d\x00" % len(raw) + raw).hexdigest()
    df = spark.createDataFrame([(data,)], "s string")
    assert df.select(sn.git_blob_sha("s").alias("h")).first().h == want
    dfb = spark.createDataFrame([(bytearray(raw),)], "b binary")
    assert dfb.select(sn.git_blob_sha("b").alias("h")).first().h == want


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("x.py", "1"), ("y.py", "2"), ("z.py", "3")], "path string, blob_sha string")
    b = spark.createDataFrame([("x.py", "1"), ("y.py", "9"), ("w.py", "4")], "path string, blob_sha string")
    got = {r.path: r.status for r in sn.snapshot_diff(a, b).collect()}
    assert got == {"y.py": "modified", "z.py": "removed", "w.py": "added"}
    assert sn.snapshot_diff(a, a).count() == 0


def test_previous_in_order_matches_window_with_hot_group(spark):
    rows = [(0 if i % 3 else i % 7 + 1, i, f"s{i}") for i in range(600)]  # group 0 holds 2/3
    df = spark.createDataFrame(rows, "g long, t long, v string").repartition(5)
    got = sn.previous_in_order(df, "g", "t", "v", "prev")
    want = df.withColumn("prev", F.lag("v").over(Window.partitionBy("g").orderBy("t")))
    a = sorted((r.g, r.t, r.prev) for r in got.collect())
    b = sorted((r.g, r.t, r.prev) for r in want.collect())
    assert a == b
    first = {(r.g, r.t): r.first for r in sn.first_in_order(df, "g", "t", "v", "first").collect()}
    assert first[(0, 1)] == "s1"


def test_feature_store_cycle(spark, tmp_dir):
    schema = "blob_sha string, n long"
    path = f"{tmp_dir}/features"
    store = fs.read_store(spark, path, spark.createDataFrame([], schema).schema)
    assert store.count() == 0
    units = spark.createDataFrame([("a",), ("b",), ("a",)], "blob_sha string")
    miss = fs.misses(units, store, "blob_sha")
    assert sorted(r.blob_sha for r in miss.collect()) == ["a", "b"]
    new = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    fs.write_store(fs.upsert(store, new, "blob_sha"), path)
    store2 = fs.read_store(spark, path, new.schema)
    assert fs.misses(units, store2, "blob_sha").count() == 0  # K1 twice adds nothing
    upd = fs.upsert(store2, spark.createDataFrame([("b", 5)], schema), "blob_sha")
    assert sorted((r.blob_sha, r.n) for r in upd.collect()) == [("a", 1), ("b", 5)]
    looked = {r.blob_sha: r.n for r in fs.lookup(units.distinct(), store2, "blob_sha").collect()}
    assert looked == {"a": 1, "b": 2}
    fs.drop_store(spark, path)


def test_hashing_encoder(spark):
    df = spark.createDataFrame([("alpha beta",), ("",)], "t string")
    out = df.select(fs.encode("t", fs.hashing_encoder(16)).alias("v")).collect()
    assert len(out[0].v) == 16 and sum(abs(x) for x in out[0].v) == 2.0
    assert sum(abs(x) for x in out[1].v) == 0.0


def test_paths_top_k_pruning_equals_full_ranking(spark):
    """Blobs cut to rank() <= k before the path join give the same top k as ranking every path."""
    from tracelens.operators import similarity as sim

    # blob b0..b7; several share a score; b1 and b5 have three and two paths
    blob_scores = spark.createDataFrame(
        [("s", q, f"b{b}", sc) for q in (1, 2)
         for b, sc in enumerate([0.9, 0.5, 0.5, 0.5, 0.4, 0.9, 0.1, 0.5])],
        "snap string, q long, blob_sha string, score double")
    manifest = spark.createDataFrame(
        [("s", "z/only0.py", "b0"), ("s", "a/x.py", "b1"), ("s", "m/x.py", "b1"), ("s", "c/x.py", "b1"),
         ("s", "b/y.py", "b2"), ("s", "y/z.py", "b3"), ("s", "k.py", "b4"), ("s", "e.py", "b5"),
         ("s", "d.py", "b5"), ("s", "n.py", "b6"), ("s", "aa.py", "b7"), ("t", "other.py", "b0")],
        "snap string, path string, blob_sha string")
    full = blob_scores.join(manifest, ["snap", "blob_sha"])
    w = Window.partitionBy("snap", "q").orderBy(F.col("score").desc(), "path")
    for k in (1, 2, 3, 4, 6):
        got = sim.paths_top_k(blob_scores, manifest, ["snap"], "q", k)
        want = (full.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                    .select("snap", "q", "path", "score", "rank"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), k
    everything = sim.paths_top_k(blob_scores, manifest, ["snap"], "q", None)
    assert everything.count() == 2 * 11


def test_cosine_paths_top_k(spark):
    """The embedding scorer ranks per distinct content and maps back to every path."""
    from tracelens.operators import similarity as sim

    enc = fs.hashing_encoder(64)
    import pandas as pd
    texts = ["login user password", "export report rows", "login user password"]
    vecs = [list(map(float, v)) for v in enc(pd.Series(texts))]
    units = spark.createDataFrame([("s", "b0", vecs[0]), ("s", "b1", vecs[1])],
                                  "snap string, blob_sha string, vector array<double>")
    qv = spark.createDataFrame([("s", 1, vecs[2])], "snap string, q long, vector array<double>")
    manifest = spark.createDataFrame([("s", "app/login.py", "b0"), ("s", "copy/login.py", "b0"),
                                      ("s", "app/report.py", "b1")],
                                     "snap string, path string, blob_sha string")
    scores = sim.cosine_scores(qv, units, ["snap"], "q", "blob_sha")
    got = [(r.path, r.rank) for r in sim.paths_top_k(scores, manifest, ["snap"], "q", 2)
           .orderBy("rank").collect()]
    assert got == [("app/login.py", 1), ("copy/login.py", 2)]


def test_salted_join_equals_plain_join_with_hot_copies(spark):
    """One blob held by a third of the units is spread over salts; the join result is unchanged."""
    from tracelens.operators.joins import hot_keys, salted_join

    units = spark.range(0, 3000).select(
        F.concat(F.lit("snap"), (F.col("id") % 1000).cast("string")).alias("snap"),
        F.when(F.col("id") < 1000, F.lit("hot")).otherwise(
            F.concat(F.lit("b"), (F.col("id") % 97).cast("string"))).alias("blob_sha")).distinct()
    postings = spark.range(0, 97).select(
        F.concat(F.lit("b"), F.col("id").cast("string")).alias("blob_sha"),
        F.lit("term").alias("term"), F.col("id").alias("tf")).unionByName(
        spark.createDataFrame([("hot", "licence", 3), ("hot", "copyright", 1)],
                              "blob_sha string, term string, tf long"))
    hot = {r["blob_sha"]: r["__salts"] for r in hot_keys(units, "blob_sha", 100).collect()}
    assert hot == {"hot": 10}
    got = salted_join(units, postings, "blob_sha", limit=100)
    want = units.join(postings, "blob_sha")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert sorted(got.columns) == sorted(want.columns)


def test_snapshot_top_k_with_salted_blob(spark):
    """Scores are the same whether or not the shared blob is salted."""
    from tracelens.operators import similarity as sim

    docs = {"b0": "login user password check", "b1": "export report rows", "b2": "licence text user"}
    blobs = spark.createDataFrame(list(docs.items()), "blob_sha string, text string")
    blob_tf = sim.term_counts(blobs, "blob_sha")
    manifest = spark.createDataFrame(
        [(f"s{i}", f"lic{i}.txt", "b2") for i in range(40)]
        + [(f"s{i}", "login.py", "b0") for i in range(40)] + [("s0", "report.py", "b1")],
        "snap string, path string, blob_sha string")
    issues = spark.createDataFrame([(f"s{i}", i, "user cannot login") for i in range(40)],
                                   "snap string, q long, text string")
    q_tf = sim.term_counts(issues, "q", scope=["snap"])
    res = []
    for limit in ("5", None):
        if limit:
            spark.conf.set("tracelens.rowsPerKeyTask", limit)
        try:
            res.append(sorted(map(tuple, sim.snapshot_top_k(q_tf, blob_tf, manifest, ["snap"], "q", 2).collect())))
        finally:
            spark.conf.unset("tracelens.rowsPerKeyTask")
    assert res[0] == res[1] and len(res[0]) == 80
    assert {r[2] for r in res[0] if r[4] == 1} == {"login.py"}


def test_salted_join_key_only_side(spark):
    """A side with only the key column is still spread and the join is unchanged."""
    from tracelens.operators.joins import salted_join

    many = spark.range(0, 500).select(F.when(F.col("id") < 300, F.lit("hot")).otherwise(
        F.col("id").cast("string")).alias("k"))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3)] + [(str(i), i) for i in range(300, 310)],
                                "k string, v long")
    got = salted_join(many, few, "k", limit=50)
    want = many.join(few, "k")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_folder_reader_keeps_empty_and_hidden_files(spark, tmp_path):
    from tracelens.sources import files
    for name, text in [("1/s/pkg/__init__.py", ""), ("1/s/pkg/a b+c%20é.py", ""), ("1/s/x.py", "x = 1\n"), ("1/s/no.txt", ""),
                       ("1/s/_vendor/y.py", "y = 1\n"), ("1/s/.hidden.py", "h\n"), ("1/s/_full.py", "f\n")]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: (r.blob_sha, r.source) for r in files.read_source_trees(spark, str(tmp_path)).collect()}
    empty = ("e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "")
    assert got.pop("x.py")[1] == "x = 1\n"
    assert [got.pop(p)[1] for p in ("_vendor/y.py", ".hidden.py", "_full.py")] == ["y = 1\n", "h\n", "f\n"]
    assert got == {"pkg/__init__.py": empty, "pkg/a b+c%20é.py": empty}
    (tmp_path / "none").mkdir()
    assert files.read_source_tree(spark, str(tmp_path / "none"), 1, "s").count() == 0
