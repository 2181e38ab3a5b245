"""Embedding queries: ``embeddings`` rows are function vectors, ``label`` their file.

The query vector of each file is the centroid of its functions' vectors
(derived by Spark from the table); every function is scored against the
centroid of its own file, an equi-join on ``label`` (no cross join).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks
from ..operators import similarity as sim
from .registry import register
from .tables import table

CENTROID_COS_SQL = """
c AS (SELECT label, list(x ORDER BY pos) AS centroid FROM
        (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM
           (SELECT label, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos
            FROM embeddings) GROUP BY label, pos) GROUP BY label),
s AS (SELECT e.label, e.vec_id,
             round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.centroid)
                   / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))
                      * sqrt(list_dot_product(c.centroid, c.centroid))), 6) AS score
      FROM embeddings e JOIN c ON e.label = c.label
      WHERE e.embedding IS NOT NULL)"""


def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cents = sim.centroids(e.where(F.col("embedding").isNotNull()), "label", "embedding", "vector")
    s = sim.cosine_scores(cents, e, scope="label", query_key=[], unit_key="vec_id",
                          query_vec="vector", unit_vec="embedding")
    return s.withColumn("score", F.round("score", 6))


@register("cosine_topk", sql=f"""
WITH {CENTROID_COS_SQL}
SELECT label, vec_id, score, rank FROM
  (SELECT label, vec_id, score,
          CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS rank
   FROM s)
WHERE rank <= 5
""")
def cosine_topk(spark, sf_dir):
    """J3 + C8 + F2: the five functions closest to their file's centroid."""
    return sim.rank_within(_scores(spark, sf_dir), "label", "vec_id", k=5).select(
        "label", "vec_id", "score", "rank")


@register("cosine_max_per_file", sql=f"""
WITH {CENTROID_COS_SQL}
SELECT label, max(score) AS best_score, arg_min(vec_id, (-score, vec_id)) AS best_vec_id,
       CAST(count(*) AS BIGINT) AS n_units
FROM s GROUP BY label
""")
def cosine_max_per_file(spark, sf_dir):
    """D5 + B9: best function score per file and the function reaching it."""
    return sim.best_per_group(_scores(spark, sf_dir), "label", "vec_id")


# Issue vectors: every function vector read backwards; so each file has as many issues as functions.
@register("cosine_many_topk", sql="""
WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
           FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.label, q.vec_id AS issue_id, u.vec_id, round(list_dot_product(list_reverse(q.v), u.v) / (q.n * u.n), 6) AS score
      FROM e q JOIN e u ON q.label = u.label)
SELECT label, issue_id, vec_id, score, rank FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY label, issue_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= 5
""")
def cosine_many_topk(spark, sf_dir):
    """C8 + J3 + F2, many to many: the five closest functions of its file for every issue vector, by blocks."""
    e = table(spark, sf_dir, "embeddings")
    issues = e.select("label", F.col("vec_id").alias("issue_id"), F.reverse("embedding").alias("vector"))
    return blocks.block_top_k(issues, e, "label", "issue_id", "vec_id", k=5, unit_vec="embedding").select(
        "label", "issue_id", "vec_id", "score", "rank")
