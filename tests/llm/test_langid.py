from tracelens.llm import langid

from . import helpers

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang", langid.held_out().alias("held_out")), "doc_id")
    rows = [r for r in got.collect() if r.held_out]
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_reads_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    from pyspark.sql import functions as F
    other = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("none").alias("source"))
    a = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    b = {r.doc_id - 10_000: r.lang_pred for r in langid.predict(other, model).collect()}
    assert a == b


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    table = helpers.docs(spark, helpers.odd_rows() + [(40, "123 !!! ²"), (41, "é")])
    got = langid.predict(table, model).collect()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert len(got) == table.count() and und == {2, 3, 4, 40}
    kept = langid.keep_identified(table, model, min_score=0.0)
    assert kept.columns == table.columns and not {r.doc_id for r in kept.collect()} & und


def test_single_language_and_no_labels(spark):
    one = langid.fit(helpers.docs(spark, [(i, helpers.words(30, i), "en") for i in range(1, 20)]))
    assert one.predict("some words here")[0] == "en"
    none = langid.fit(helpers.docs(spark, [(1, "a b", None), (2, None, "en")]))
    assert none.predict("some words") == ("und", 0.0)
    assert langid.predict(helpers.docs(spark, []), none).count() == 0


def test_unlisted_language_is_its_own_family():
    assert langid.family_of("xx") == "only-xx" and langid.family_of("de") == langid.family_of("nl")
