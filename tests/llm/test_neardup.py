import random

import numpy as np
from pyspark.sql import functions as F

from tracelens.llm import components, neardup

from . import helpers


def sets_of(rows):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(base, n, rate, seed, first):
    rng = random.Random(seed)
    out, text = [], base.split()
    for k in range(n):
        src = text if k % 3 else (out[rng.randrange(len(out))][1].split() if out else text)
        out.append((first + k, " ".join(w if rng.random() > rate else f"e{rng.randrange(10**6)}" for w in src)))
    return out


def run(spark, rows, **options):
    got = neardup.report(helpers.docs(spark, rows), **options).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}, got


def test_equals_brute_force(spark):
    rows = [(i, helpers.words(60, i)) for i in range(30)]
    rows += family(helpers.words(120, 500), 40, 0.012, 1, 100) + family(helpers.words(40, 501), 15, 0.02, 2, 200)
    rows += [(300 + i, helpers.words(80, 600)) for i in range(20)] + [(400, "one two"), (401, "ONE two"), (402, "one two three")]
    got, full = run(spark, rows)
    assert got == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in full)


def test_large_region_is_split_and_swept(spark):
    rows = family(helpers.words(120, 500), 150, 0.02, 1, 100)
    got, _ = run(spark, rows, group_docs=12)
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = helpers.odd_rows()
    table = helpers.docs(spark, rows)
    got = neardup.report(table).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].n_shingles, by[i].component_id, by[i].kept) == (0, i, True) for i in (2, 3, 4))
    kept = neardup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in {r[0] for r in rows})


def test_one_of_each_group_stays(spark):
    rows = [(i, helpers.words(60, 3)) for i in (9, 4, 7)] + [(20, helpers.words(60, 4))]
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(helpers.docs(spark, rows)).collect()) == [4, 20]


def test_empty_table(spark):
    assert neardup.report(helpers.docs(spark, [])).count() == 0
    assert neardup.drop_near_duplicates(helpers.docs(spark, [])).count() == 0


def test_group_links_keep_memory_bounded_and_true():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(50)]
    got = dict(neardup.link_group(list(range(50)), sets, 60))
    for i in range(50):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                assert got.get(i, i) == got.get(j, j)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r.id: r.root for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)}
    assert components.connected_components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_repeated_ids_lose_no_text(spark):
    """One id on a near copy and on a text of its own: a row of every group of texts stays."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "wx")
    rows = [(3, a, "m"), (7, a + " tail", "m"), (7, b, "m"), (7, b, "m"), (9, b, "m"), (None, "q", "m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    from tracelens.llm import neardup
    assert {(r.doc_id, r.text) for r in neardup.drop_near_duplicates(docs).collect()} == {(3, a), (9, b), (None, "q")}
