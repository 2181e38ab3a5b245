"""Hash-prefix forest: recall against all rows, exact scores, equal vectors, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import hash_forest as hf

SCHEMA = "rank int, cid string, vec_id bigint, embedding array<float>"


def _table(spark, ids, vecs):
    return spark.createDataFrame([(0, "c", int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vecs)], SCHEMA)


def _exact(ids, vecs, is_query, k):
    x = np.array(vecs, np.float32).astype(np.float64)
    ids = np.array(ids)
    out = {}
    for q in np.flatnonzero([is_query(i) for i in ids]):
        s = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def _recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(len(w) for w in want.values())


def _clustered(n, dim, seed=3, spread=0.35):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 30, dim))
    x = centres[r.integers(0, len(centres), n)] + spread * r.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_recall_and_scores(spark):
    x = _clustered(3000, 24)
    ids = list(range(0, 9000, 3))
    got = _found(hf.nearest(_table(spark, ids, x), F.col("vec_id") % 20 == 0, k=10, part_rows=300, descend_rows=40))
    want = _exact(ids, x, lambda i: i % 20 == 0, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert _recall(got, want) >= 0.9
    score = {(q, i): s for q, w in _exact(ids, x, lambda i: i % 20 == 0, 3000).items() for i, s in w}
    assert all(abs(s - score[q, i]) < 1e-12 for q, w in got.items() for i, s in w)


def test_fewer_rows_are_scored_than_all(spark):
    """Near vectors are caught far below the root, so the ascent ends there."""
    x = _clustered(2000, 24, spread=0.1)
    vectors = spark.createDataFrame([(i, 24, [float(y) for y in v]) for i, v in enumerate(x)], "cid bigint, dim int, vec array<double>")
    index = hf.build_index(vectors, part_rows=500)
    up = hf._Ascend(index, 0.93, 6)
    assert up.depth(np.full(6, 0.95)) >= 8 and up.depth(np.full(6, 0.1)) == 0


def test_lengths_differ(spark):
    r = np.random.default_rng(8)
    x = _clustered(800, 12) * r.lognormal(0, 1.5, 800)[:, None]
    ids = list(range(800))
    got = _found(hf.nearest(_table(spark, ids, x), F.col("vec_id") % 20 == 0, k=5, part_rows=100, descend_rows=20))
    assert _recall(got, _exact(ids, x, lambda i: i % 20 == 0, 5)) >= 0.9


def test_equal_vectors_and_ties(spark):
    x = np.vstack([np.tile([1.0, 0, 0], (120, 1)), np.tile([0, 1.0, 0], (3, 1)), [[0.5, 0.5, 0]]])
    ids = list(range(124))
    got = _found(hf.nearest(_table(spark, ids, x), F.col("vec_id") % 20 == 0, k=20))
    assert got == _exact(ids, x, lambda i: i % 20 == 0, 20)


def test_odd_rows(spark):
    vecs = [[1, 2], None, [], [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [1, 2], [2, 1], [-1, -2], [1, 2, 3], [3, 2, 1], [-0.0, 1], [0.0, 1]]
    ids = list(range(0, 20 * len(vecs), 20))
    got = _found(hf.nearest(_table(spark, ids + [ids[0]], vecs + [vecs[0]]), F.col("vec_id") % 20 == 0, k=3))
    good = [i for i, v in zip(ids, vecs) if v and None not in v and np.isfinite(v).all() and any(v)]
    assert sorted(got) == good
    two = [(i, v) for i, v in zip(ids, vecs) if i in good and len(v) == 2]
    three = [(i, v) for i, v in zip(ids, vecs) if i in good and len(v) == 3]
    want = _exact(*zip(*two), lambda i: True, 3) | _exact(*zip(*three), lambda i: True, 3)
    assert got == want
    assert hf.nearest(_table(spark, [], []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("depth", [0, 1, 13, hf.HASH_BITS])
def test_prefix_ranges_hold_the_rows_that_share_the_prefix(depth):
    r = np.random.default_rng(1)
    strings = r.integers(0, 1 << hf.HASH_BITS, 500)
    keys = (strings << hf.SALT_BITS) | r.integers(0, 1 << hf.SALT_BITS, 500)
    lo, hi = hf._prefix_range(strings[:1], np.int64(depth))
    inside = (keys >= lo) & (keys <= hi)
    assert (inside == ((strings >> (hf.HASH_BITS - depth)) == (strings[0] >> (hf.HASH_BITS - depth)))).all()
