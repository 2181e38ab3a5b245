import corpus_pipeline as cp
from pyspark.sql import functions as F

from tracelens.llm import decontaminate, langid, neardup, pii
from tracelens.llm.common import read_table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(spark):
    """The stages over all documents, one after the other, with plain loops."""
    rows = {r.doc_id: r for r in read_table(spark, SF, "documents").collect()}
    model = langid.fit(langid.training_rows(read_table(spark, SF, "documents")))
    rows = {i: r.text for i, r in rows.items() if (p := model.predict(r.text))[0] != "und" and p[1] >= langid.MIN_SCORE}
    sets = {i: neardup.shingle_set(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = {i: t for i, t in rows.items() if find(i) == i}
    windows = set()
    for r in read_table(spark, SF, "benchmark").collect():
        w = decontaminate.words_of(r.text)
        windows |= {tuple(w[j:j + 10]) for j in range(max(1, len(w) - 9))} if w else set()
    return rows, windows


def test_stages_against_brute_force(spark):
    rows, windows = brute(spark)
    out = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    whole = {i for i in rows if i not in out}
    for i in whole:  # only documents that consist of benchmark passages go after deduplication
        w = decontaminate.words_of(rows[i])
        assert any(tuple(w[j:j + 10]) in windows for j in range(len(w)))
    assert set(out) <= set(rows)
    for i, r in out.items():
        w = decontaminate.words_of(r.text)
        assert not any(tuple(w[j:j + 10]) in windows for j in range(len(w)))
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text) and r.rate > 0 and r.copies >= 0
        before = decontaminate.words_of(rows[i])
        if not pii.base_spans(rows[i]) and not any(tuple(before[j:j + 10]) in windows for j in range(len(before))):
            assert r.text == rows[i]


def test_stage_columns_and_names(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "personal_data", "mix_to_targets"]
    docs = read_table(spark, SF, "documents")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == COLUMNS
    assert set(COLUMNS) <= set(cp.STAGES[-1][1](spark, docs, SF).columns)


def test_empty_documents_and_extra_columns(spark):
    docs = read_table(spark, SF, "documents").withColumn("rate", F.lit("x")).withColumn("kept", F.lit(1))
    for table in (docs.limit(0), docs.limit(15).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))):
        n = table.count()
        for _, stage in cp.STAGES:
            assert stage(spark, table, SF).count() <= n


def test_queries_are_registered():
    import __spark_entry__ as e
    names = e.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert "pipeline" not in e.oracle_sql()
