import random

import numpy as np
from pyspark.sql import functions as F

from tracelens.llm import ordinal, queries

from . import helpers


def test_recovers_grades_and_keeps_order(spark):
    rng = random.Random(1)
    rows, grades = [], []
    for i in range(900):
        g = rng.randrange(3)
        extra = ["awful"] * (g == 0) + ["meh"] * (g == 1) + ["great"] * (g == 2)
        rows.append((i, helpers.words(40, i) + " " + " ".join(extra)))
        grades.append((i, g))
    table = helpers.docs(spark, rows)
    ratings = spark.createDataFrame(grades[:600] + [(1, None), (None, 2)], "doc_id bigint, grade int")
    model = ordinal.fit(table, ratings)
    assert model.grades == [0, 1, 2] and np.all(np.diff(model.cuts) > 0)
    got = {r.doc_id: r for r in ordinal.score(table, model).collect()}
    right = [abs(got[i].expected_grade - g) < 0.6 for i, g in grades[600:]]
    assert np.mean(right) > 0.9
    assert all(0 <= r.tail_probability <= 1 and r.kept == (r.tail_probability >= 0.5) for r in got.values())


def test_held_out_rating(spark):
    sf = "/root/testdata/sf0.01"
    docs, ratings = spark.read.parquet(f"{sf}/documents.parquet"), queries.graded_ratings(spark, sf)
    train, test = ratings.where("doc_id % 3 <> 0"), ratings.where("doc_id % 3 = 0")
    got = ordinal.score(docs, ordinal.fit(docs, train)).join(test, "doc_id").collect()
    assert len(got) > 100 and np.mean([r.kept == (r.grade == 2) for r in got]) > 0.8
    order = [np.mean([r.expected_grade for r in got if r.grade == g]) for g in (0, 1, 2)]
    assert order[2] > max(order[:2]) + 0.3


def test_odd_rows_and_no_ratings(spark):
    rows = helpers.odd_rows()
    table = helpers.docs(spark, rows)
    none = ordinal.fit(table, spark.createDataFrame([], "doc_id bigint, grade int"))
    assert ordinal.score(table, none).count() == len(rows)
    one = ordinal.fit(table, table.select("doc_id", F.lit(1).alias("grade")))
    assert all(r.expected_grade == 1 and r.kept for r in ordinal.score(table, one).collect())
    two = ordinal.fit(table, spark.createDataFrame([(1, 0), (5, 4), (5, 4)], "doc_id bigint, grade int"))
    got = ordinal.score(table, two).collect()
    assert all(0 <= r.expected_grade <= 4 for r in got) and len(got) == len(rows)
    assert ordinal.score(helpers.docs(spark, []), two).count() == 0


def test_tail_of_a_middle_grade():
    m = ordinal.OrdinalModel(np.zeros(1 << ordinal.BITS), np.array([-1.0, 1.0]), [0, 1, 2])
    t = m.tails(m.latent("x"))
    assert abs(t[0] - 1 / (1 + np.exp(-1))) < 1e-9 and abs(t[1] - 1 / (1 + np.exp(1))) < 1e-9
