import numpy as np
from pyspark.sql import functions as F

from tracelens.llm import mixing as m

from . import helpers


def corpus(n=300):
    rows = []
    for i in range(n):
        kind = ["red", "green", "blue"][i % 10 // 4 if i % 10 < 8 else 2]
        rows.append((i, helpers.words(30 + i % 50, i) + f" {kind} {kind}ish"))
    return rows


def labels(spark, rows):
    said = [(i, t.split()[-2]) for i, t in rows if i % 2 == 0]
    return spark.createDataFrame(said + [(0, None), (None, "red"), (1, "other"), (2, said[1][1])], "doc_id bigint, domain string")


def test_expected_totals_meet_targets(spark):
    rows = corpus()
    targets = {"red": 0.5, "green": 0.3, "blue": 0.2}
    got = m.mix(helpers.docs(spark, rows), labels(spark, rows), targets).collect()
    assert len(got) == len(rows)
    assert all(r.rate >= 0 and abs(r.p_red + r.p_green + r.p_blue - 1) < 1e-9 for r in got)
    total = sum(r.n_tokens for r in got)
    for d, t in targets.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total - t) < 2e-3
    texts = dict((i, t) for i, t in rows)
    assert np.mean([r["p_" + texts[r.doc_id].split()[-2]] > 0.5 for r in got]) > 0.95


def test_rates_equal_projected_gradient_in_numpy(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    n = rng.integers(0, 100, 200)
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "__n bigint, __p array<double>")
    wanted = np.array([0.7, 0.25, 0.05])
    steps, start, after = m.fit_rates(table, wanted.tolist(), tolerance=1e-4)
    rate, ahead, share = np.ones(200), np.ones(200), n @ p / n.sum()
    assert np.allclose(start, share)
    for k, s in enumerate(steps):
        gap = ((ahead * n) @ p / n.sum() - wanted) / share
        assert np.allclose(gap, s)
        new = np.where(n > 0, np.maximum(0, ahead - (p @ gap + m.PULL * (ahead - 1)) / (1 + m.PULL)), 1.0)
        rate, ahead = new, np.where(n > 0, new + k / (k + 3) * (new - rate), 1.0)
    got = [r[0] for r in table.select(m.rate_after(steps, m.PULL)).collect()]
    assert np.allclose(got, rate) and np.abs(np.array(after) - wanted).max() < 2e-3


def test_plan_has_no_python(spark):
    rows = corpus(60)
    plan = m.mix(helpers.docs(spark, rows), labels(spark, rows), {"red": 1, "green": 1, "blue": 1})._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_attach_keeps_columns_and_replaces_rate(spark):
    rows = corpus(80)
    table = helpers.docs(spark, rows)
    out = m.attach_rates(table, labels(spark, rows), {"red": 2.0, "green": 1.0, "blue": 1.0})
    assert out.columns == [c for c in table.columns if c != "rate"] + ["rate", "copies"]
    got = out.collect()
    assert all(r.rate > 0 and abs(r.copies - r.rate) < 1 and r.score == 9.0 for r in got)


def test_odd_rows_and_empty_tables(spark):
    rows = helpers.odd_rows()
    table = helpers.docs(spark, rows)
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    got = m.mix(table, none, {"a": 1.0, "b": 1.0}).collect()
    assert len(got) == len(rows) and all(r.rate == 1 for r in got if r.n_tokens == 0)
    assert m.mix(helpers.docs(spark, []), none, {"a": 1.0}).count() == 0
    zero = m.mix(table, table.select("doc_id", F.lit("a").alias("domain")), {"a": 0.0, "b": 0.0}).collect()
    assert all(r.rate == 1 for r in zero)
    assert m.attach_rates(table, none, {"a": 1.0, "b": 1.0}).count() == len(rows)


def test_every_significant_bucket_counts(spark):
    # 900 words of a domain each in 100 of its documents: all of them pass the test.
    rng = np.random.default_rng(5)
    rows = []
    for k, kind in enumerate(["red", "green"]):
        held = [[] for _ in range(300)]
        for w in range(900):
            for i in rng.choice(300, 100, replace=False):
                held[i].append(f"{kind}{w}")
        rows += [(1000 * k + i, " ".join(x)) for i, x in enumerate(held)]
    table = helpers.docs(spark, rows)
    said = spark.createDataFrame([(i, "red" if i < 1000 else "green") for i, _ in rows], "doc_id bigint, domain string")
    domains = ["green", "red"]
    model = m.train(table, said, domains)
    fitted = {r.b: (r.w0, r.w1) for r in model.collect()}
    assert len(fitted) - 1 > 1700
    probe = [(k, f"{kind}{w}") for k, (kind, w) in enumerate((kind, w) for kind in ("red", "green") for w in range(0, 900, 7))]
    probe += [(5000, " ".join(t for _, t in probe)), (5001, "none of these"), (5002, "")]
    texts = helpers.docs(spark, probe)
    bags = {r.doc_id: set(r.b) for r in texts.select("doc_id", m.buckets_of(m.words_of(F.col("text"))).alias("b")).collect()}
    for r in m.posteriors(texts, model, domains, keep=["doc_id"]).collect():
        odds = np.array(fitted[0]) + sum((np.array(fitted[b]) for b in bags[r.doc_id] if b in fitted), np.zeros(2))
        e = np.exp(odds - odds.max())
        assert np.allclose(r["__p"], e / e.sum(), atol=1e-9)
