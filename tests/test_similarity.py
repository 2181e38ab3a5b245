"""Pairwise TF-IDF cosine (J4/J5) and vector cosine (J3): golden, brute force, properties."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tracelens.operators import similarity as sim


def tfidf_cosine_direct(a: str, b: str) -> float:
    """The two-document TF-IDF cosine by its definition (smooth idf, raw tf, L2)."""
    tok = lambda s: re.findall(r"(?u)\b\w\w+\b", s.lower())
    ca, cb = Counter(tok(a)), Counter(tok(b))
    terms = set(ca) | set(cb)
    if not terms:
        return 0.0
    idf = {t: math.log(3 / (1 + (t in ca) + (t in cb))) + 1 for t in terms}
    va = {t: ca[t] * idf[t] for t in terms}
    vb = {t: cb[t] * idf[t] for t in terms}
    na = math.sqrt(sum(v * v for v in va.values()))
    nb = math.sqrt(sum(v * v for v in vb.values()))
    if na == 0 or nb == 0:
        return 0.0
    return sum(va[t] * vb[t] for t in terms) / (na * nb)


def _pairs(spark, qs, us):
    q = spark.createDataFrame(list(enumerate(qs)), "qid long, text string")
    u = spark.createDataFrame(list(enumerate(us)), "uid long, text string")
    s = sim.tfidf_pair_scores(sim.term_counts(q, "qid"), sim.term_counts(u, "uid"), "qid", "uid")
    return {(r.qid, r.uid): r.score for r in s.collect()}


def test_golden_pair(spark):
    got = _pairs(spark, ["the login button fails when the user logs in"],
                 ["login user the handler the the button"])
    assert got[(0, 0)] == pytest.approx(0.6236615113, abs=1e-10)


def test_against_direct_definition_on_documents(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
            .orderBy("doc_id").limit(25).collect()]
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
             .orderBy("item_id").limit(6).collect()]
    got = _pairs(spark, items, docs)
    for qi, q in enumerate(items):
        for ui, u in enumerate(docs):
            want = tfidf_cosine_direct(q, u)
            assert got.get((qi, ui), 0.0) == pytest.approx(want, abs=1e-9), (qi, ui)


def test_properties(spark):
    texts = ["alpha beta beta gamma", "beta gamma delta", "zeta eta", "alpha alpha"]
    fwd = _pairs(spark, texts, texts)
    for (i, j), s in fwd.items():
        assert 0.0 <= s <= 1.0 + 1e-12
        assert s == pytest.approx(fwd[(j, i)], abs=1e-12)
    for i in range(len(texts)):
        assert fwd[(i, i)] == pytest.approx(1.0, abs=1e-12)
    assert (0, 2) not in fwd  # nothing shared -> 0, not emitted


def test_shuffled_join_path_equals_broadcast(spark):
    q = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    u = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    qt, ut = sim.term_counts(q, "item_id"), sim.term_counts(u, "doc_id")
    a = sim.tfidf_pair_scores(qt, ut, "item_id", "doc_id", broadcast_queries=True)
    b = sim.tfidf_pair_scores(qt, ut.repartition(3), "item_id", "doc_id", broadcast_queries=False)
    ka = {(r.item_id, r.doc_id): r.score for r in a.collect()}
    kb = {(r.item_id, r.doc_id): r.score for r in b.collect()}
    assert ka == kb and len(ka) > 0


def test_top_k_deterministic_ties(spark):
    q = spark.createDataFrame([(1, "red apple")], "qid long, text string")
    u = spark.createDataFrame([(5, "red apple"), (3, "red apple"), (4, "green")],
                              "uid long, text string")
    top = sim.tfidf_top_k(q, u, "qid", "uid", k=2).orderBy("rank").collect()
    assert [(r.uid, r.rank) for r in top] == [(3, 1), (5, 2)]


def test_cosine_and_best_per_group(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(12, 8)).astype("float32")
    units = spark.createDataFrame([(int(i), int(i % 3), vecs[i].tolist()) for i in range(12)],
                                  "vec_id long, label int, embedding array<float>")
    cents = sim.centroids(units, "label", "embedding", "vector")
    s = sim.cosine_scores(cents, units, "label", [], "vec_id", "vector", "embedding")
    got = {r.vec_id: r.score for r in s.collect()}
    for i in range(12):
        c = vecs[[j for j in range(12) if j % 3 == i % 3]].astype("float64").mean(axis=0)
        v = vecs[i].astype("float64")
        assert got[i] == pytest.approx(float(v @ c / (np.linalg.norm(v) * np.linalg.norm(c))), abs=1e-9)
    best = {r.label: (r.best_vec_id, r.n_units) for r in sim.best_per_group(s, "label", "vec_id").collect()}
    for lab in range(3):
        ids = [i for i in range(12) if i % 3 == lab]
        assert best[lab] == (max(ids, key=lambda i: (got[i], -i)), 4)


def test_cosine_requires_scope(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")
    with pytest.raises(ValueError):
        sim.cosine_scores(df, df, [], "id", "id")


def test_rank_all_hot_group_equals_row_number(spark):
    """Full ranking without k: one group holds a third of the rows, scores tie."""
    from pyspark.sql import Window

    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
        F.col("id").alias("u"), (F.col("id") * 7919 % 11 / 10.0).alias("score"))
    got = sim.rank_within(df.repartition(5), "g", "u", k=None)
    w = Window.partitionBy("g").orderBy(F.col("score").desc(), "u")
    want = df.withColumn("rank", F.row_number().over(w))
    assert got.schema["rank"].dataType == want.schema["rank"].dataType
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # the hot group is spread over several range partitions (AQE would merge
    # partitions this small, so coalescing is off for the check)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = sim.rank_within(df, "g", "u", k=None).where("g = 0")
        segs = hot.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert segs > 1


def test_unscored_counts(spark):
    """Zero-score units are counted, not emitted: scored + zero = units of the query's scope."""
    queries = spark.createDataFrame([("s", 1, "login user"), ("s", 2, "nothing shared"), ("t", 3, "report")],
                                    "scope string, q long, text string")
    units = spark.createDataFrame([("s", "a", "login handler"), ("s", "b", "user list"), ("s", "c", "misc"),
                                   ("t", "d", "report export")], "scope string, u string, text string")
    q_tf = sim.term_counts(queries, "q", scope=["scope"])
    u_tf = sim.term_counts(units, "u", scope=["scope"])
    scores = sim.tfidf_pair_scores(q_tf, u_tf, "q", "u", ["scope"])
    got = sorted(tuple(r) for r in sim.unscored_counts(scores, queries, units, ["scope"], "q", "u").collect())
    assert got == [("s", 1, 2, 1), ("s", 2, 0, 3), ("t", 3, 1, 0)]
    flat = sim.unscored_counts(scores.drop("scope"), queries.drop("scope"), units.drop("scope"), [], "q", "u")
    assert sorted(tuple(r) for r in flat.collect()) == [(1, 2, 2), (2, 0, 4), (3, 1, 3)]


def test_term_counts_partitions_follow_the_bytes(spark):
    """A task gets a bounded share of the texts, however many there are; repeated and null keys keep one count per term."""
    from tracelens import session

    few, many = [session.repartition_by_size(spark.range(n).select("id", F.lit("x" * 100).alias("text")), ["id"], 10_000)
                 for n in (100, 4000)]
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert many.rdd.getNumPartitions() == -(-4000 * (100 + 16 * 2 + 16) // 10_000)
    rows = [(i % 50 if i % 7 else None, f"aa bb{i % 3} aa") for i in range(300)]
    want = Counter((k, t) for k, text in rows for t in text.split())
    got = sim.term_counts(spark.createDataFrame(rows, "k int, text string"), "k").collect()
    assert {(r.k, r.term): r.tf for r in got} == want and len(got) == len(want)


def test_distinct_texts(spark):
    rows = [("a", "one two"), ("a", "one two"), (None, "three"), ("b", None), ("b", None)]
    got = sim.distinct_texts(spark.createDataFrame(rows, "blob string, text string"), "blob")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # texts are shuffled once
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "one two"), ("b", None), (None, "three")]
