"""Scoring queries: benchmark texts play issues, documents play source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as sim
from .registry import register
from .tables import table

# DuckDB pieces shared by the oracle texts below.
W2 = "CAST('1.9753321701094941' AS DOUBLE)"
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def _tf_sql(tbl: str, key: str) -> str:
    return (f"SELECT {key}, term, CAST(count(*) AS BIGINT) AS tf FROM "
            f"(SELECT {key}, unnest({TOK}) AS term FROM {tbl}) GROUP BY {key}, term")


def pair_scores_sql(qt: str, qk: str, ut: str, uk: str) -> str:
    return f"""
q AS ({_tf_sql(qt, qk)}),
u AS ({_tf_sql(ut, uk)}),
qs AS (SELECT {qk}, sum(tf * tf) AS q_ss FROM q GROUP BY {qk}),
us AS (SELECT {uk}, sum(tf * tf) AS u_ss FROM u GROUP BY {uk}),
p AS (SELECT q.{qk}, u.{uk}, sum(q.tf * u.tf) AS dot, sum(q.tf * q.tf) AS q_shared,
             sum(u.tf * u.tf) AS u_shared
      FROM q JOIN u ON q.term = u.term GROUP BY q.{qk}, u.{uk}),
s AS (SELECT p.{qk}, p.{uk},
             round(CAST(dot AS DOUBLE) / sqrt(({W2} * q_ss - ({W2} - 1.0) * q_shared)
                                 * ({W2} * u_ss - ({W2} - 1.0) * u_shared)), 6) AS score
      FROM p JOIN qs ON p.{qk} = qs.{qk} JOIN us ON p.{uk} = us.{uk})"""


@register("tfidf_topk", sql=f"""
WITH {pair_scores_sql('benchmark', 'item_id', 'documents', 'doc_id')},
r AS (SELECT item_id, doc_id, score,
             CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM s)
SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 3
""")
def tfidf_topk(spark, sf_dir):
    """Top 3 documents per benchmark text by pairwise TF-IDF cosine."""
    return sim.tfidf_top_k(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"),
                           "item_id", "doc_id", k=3).select("item_id", "doc_id", "score", "rank")


@register("tfidf_all_scores", sql=f"""
WITH {pair_scores_sql('benchmark', 'item_id', 'documents', 'doc_id')}
SELECT item_id, doc_id, score,
       CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM s
""")
def tfidf_all_scores(spark, sf_dir):
    """Full ranking per benchmark text; units sharing no term score 0 and are omitted."""
    return sim.tfidf_top_k(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"),
                           "item_id", "doc_id", k=None).select("item_id", "doc_id", "score", "rank")


@register("term_frequency", sql=f"""
WITH t AS ({_tf_sql('documents', 'doc_id')})
SELECT doc_id, term, tf FROM t
""")
def term_frequency(spark, sf_dir):
    return sim.term_counts(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "term", "tf")


@register("doc_norms", sql=f"""
WITH t AS ({_tf_sql('documents', 'doc_id')})
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens,
       CAST(sum(tf * tf) AS BIGINT) AS sum_sq
FROM t GROUP BY doc_id
""")
def doc_norms(spark, sf_dir):
    """Distinct terms, tokens and sum of squared counts per document."""
    tf = sim.term_counts(table(spark, sf_dir, "documents"), "doc_id")
    return tf.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"),
                                    F.sum("tf").alias("n_tokens"),
                                    F.sum(F.col("tf") * F.col("tf")).alias("sum_sq"))


@register("tfidf_unscored", sql=f"""
WITH {pair_scores_sql('benchmark', 'item_id', 'documents', 'doc_id')},
n AS (SELECT item_id, CAST(count(*) AS BIGINT) AS n_scored FROM s GROUP BY item_id)
SELECT b.item_id, coalesce(n.n_scored, 0) AS n_scored,
       (SELECT count(DISTINCT doc_id) FROM documents) - coalesce(n.n_scored, 0) AS n_zero
FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN n ON b.item_id = n.item_id
""")
def tfidf_unscored(spark, sf_dir):
    """J6 zeros: per benchmark text, documents scored and documents at score 0 (counted, not emitted)."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    scores = sim.tfidf_pair_scores(sim.term_counts(b, "item_id"), sim.term_counts(d, "doc_id"),
                                   "item_id", "doc_id")
    return sim.unscored_counts(scores, b, d, [], "item_id", "doc_id")
