"""Many-to-many cosine by blocks (C8, J3) against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from tracelens.operators import blocks
from tracelens.operators import similarity as sim


def vectors(rng, n, key, hot):
    rows = []
    for i in range(n):
        v = [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]
        rows.append((0 if i % 3 < hot else rng.randint(1, 5), i, None if i % 17 == 5 else [0.0] * 3 if i % 19 == 7 else v))
    return rows, f"scope int, {key} long, vector array<double>"


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_equals_every_pair(spark, block_rows):
    rng = random.Random(3)
    issues = spark.createDataFrame(*vectors(rng, 60, "issue", 1))
    units = spark.createDataFrame(*vectors(rng, 130, "unit", 2))
    for k in (1, 4, 500):
        want = sim.rank_within(sim.cosine_scores(issues, units, "scope", "issue", "unit").withColumn("score", F.round("score", 6)),
                               ["scope", "issue"], "unit", k)
        got = blocks.block_top_k(issues, units, "scope", "issue", "unit", k, block_rows=block_rows)
        columns = ["scope", "issue", "unit", "score", "rank"]
        assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)


def test_hot_scope_is_spread(spark):
    rng = random.Random(4)
    issues = spark.createDataFrame(*vectors(rng, 90, "issue", 3))  # one scope only
    units = spark.createDataFrame(*vectors(rng, 90, "unit", 3))

    class Count(blocks._BestOfBlocks):
        def __call__(self, q, u):
            assert q.num_rows <= 30 and u.num_rows <= 30
            return super().__call__(q, u)

    old, blocks._BestOfBlocks = blocks._BestOfBlocks, Count
    try:
        assert blocks.block_top_k(issues, units, "scope", "issue", "unit", 2, block_rows=10).count() == 2 * issues.where("vector is not null").count()
    finally:
        blocks._BestOfBlocks = old


def test_empty_sides(spark):
    rows, schema = vectors(random.Random(1), 9, "issue", 1)
    issues = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "scope int, unit long, vector array<double>")
    assert blocks.block_top_k(issues, none, "scope", "issue", "unit", 2).count() == 0
    with pytest.raises(ValueError):
        blocks.block_top_k(issues, none, [], "issue", "unit", 2)
