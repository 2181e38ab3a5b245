"""The registered queries of this subpackage: ``opN_<name>(spark, sf_dir)``.

Each applies its operator with production parameters to the whole table and
derives the digest columns of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, collocations, decontaminate, hash_forest, html_extract, langid, mixing, neardup, ordinal, pii, quality_rules, spelling_variants, token_counts
from .common import bound_batches, ensure_checkpoint_dir, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        def query(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
            ensure_checkpoint_dir(spark)
            bound_batches(spark)
            return fn(spark, sf_dir, **options)

        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return query
    return wrap


@register("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@register("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


# A conversation whose texts hold the template's own control strings.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


@register("op3_chat_prefix_tree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    return chat_tree.read_back(chat_tree.build(turns.unionByName(extra)))


def graded_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the labelled documents: 0 toxic, 1 low quality, 2 good."""
    labels = read_table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
                         .when(F.col("quality") == 1, 2).alias("grade"))


@register("op4_ordinal_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return ordinal.score(docs, ordinal.fit(docs, graded_ratings(spark, sf_dir)))


@register("op5_html_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def token_file() -> str:
    """The vocabulary counted by default (an installed package's file, the same on every machine)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    return token_counts.report(read_table(spark, sf_dir, "documents"), tokenizer_file or token_file())


# Target shares of expected tokens by domain.
MIX_TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}


def mixing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the labelled documents: toxic, else high or low by quality."""
    labels = read_table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high")
                         .when(F.col("quality") == 0, "low").alias("domain"))


@register("op7_mix_to_targets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), mixing_labels(spark, sf_dir), MIX_TARGETS)


@register("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    return langid.predict(docs, model).select(
        "doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@register("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(read_table(spark, sf_dir, "documents"))


# The sixteen numbers are the table of CRC-32 for four bits at a time (fixed values).
OP11_SQL = r"""
WITH runs AS (
  SELECT doc_id, run, count(*) AS c FROM
    (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
codes AS (
  SELECT run, c, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS points FROM runs),
octets AS (
  SELECT run, c, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END)) AS bytes FROM codes),
sums AS (
  SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(bytes, lambda b: [b & 15, b >> 4]))),
    lambda s, h: xor(s >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                              3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][xor(s & 15, h) + 1])), 4294967295) AS h
  FROM octets),
forms AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM sums),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM forms WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM w a JOIN cut b ON b.rest = a.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM w a JOIN cut b ON b.rest = a.word),
best AS (
  SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word, n),
f AS (
  SELECT w.word, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near,
         CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
  FROM w LEFT JOIN best b ON w.word = b.word),
chain AS (
  WITH RECURSIVE c(word, last, form) AS (
    SELECT word, word, form FROM f
    UNION ALL
    SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
  SELECT word, last AS root FROM c WHERE form IS NULL)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain ON f.word = chain.word
"""


@register("op11_spelling_variants", sql=OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM
    (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
place AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM p WHERE len(ws) > 0),
sizes AS (SELECT lang, count(*) AS n FROM place GROUP BY lang),
f AS (
  SELECT lang, m, g, count(*) AS c FROM (
    SELECT lang, 1 AS m, ws[i] AS g FROM place UNION ALL
    SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM place WHERE i + 1 <= len(ws) UNION ALL
    SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM place WHERE i + 2 <= len(ws)) GROUP BY lang, m, g),
cand AS (SELECT lang, m, g, c AS a, string_split(g, ' ') AS ws FROM f WHERE m > 1 AND c >= 10),
parts AS (
  SELECT lang, g, a, 1 AS k, ws[1] AS head, array_to_string(ws[2:], ' ') AS tail FROM cand UNION ALL
  SELECT lang, g, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM cand WHERE m = 3),
cuts AS (
  SELECT d.lang, d.g, d.a, d.k, l.c AS l, r.c AS r,
         (CAST(1000000 AS HUGEINT) * d.a * d.a) // (CAST(l.c AS HUGEINT) * r.c) AS score
  FROM parts d JOIN f l ON l.lang = d.lang AND l.g = d.head JOIN f r ON r.lang = d.lang AND r.g = d.tail),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
covers AS (
  SELECT lang, g, max(a) AS a FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS g, a FROM cand WHERE m = 3 UNION ALL
    SELECT lang, ws[2] || ' ' || ws[3], a FROM cand WHERE m = 3) GROUP BY lang, g),
kept AS (
  SELECT low.* FROM low LEFT JOIN covers ON covers.lang = low.lang AND covers.g = low.g
  WHERE covers.a IS NULL OR 100 * covers.a < 50 * low.a),
ranked AS (
  SELECT k.lang, k.g AS phrase, k.a, k.l, k.r, s.n, k.score FROM kept k JOIN sizes s ON s.lang = k.lang),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM placed WHERE rank <= 2000
"""


@register("op12_collocations", sql=OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(read_table(spark, sf_dir, "documents"))


@register("op13_hash_prefix_forest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return hash_forest.nearest(rows, F.col("vec_id") % 20 == 0)
