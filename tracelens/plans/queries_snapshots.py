"""Snapshot, feature-store and incremental queries.

Documents play the source files of twenty snapshots (``source``); a file's
path is ``<source>/doc<doc_id>.py`` and its content id is ``md5(text)``.
Two manifests of one repository are derived for the diff: the old one lacks
the German files, the new one lacks short Spanish files and has the long
French files edited (a newline appended).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fs
from ..operators import hashtree as ht
from ..operators import similarity as sim
from ..operators import snapshots as sn
from ..plans.queries_links import LINKED_CTE, linked_pulls
from ..session import materialize
from .registry import register
from .tables import table

PATH_SQL = "source || '/doc' || CAST(doc_id AS STRING) || '.py'"
OLD_FILTER_SQL = "lang <> 'de'"
NEW_FILTER_SQL = "NOT (lang = 'es' AND n_chars < 500)"
NEW_TEXT_SQL = "CASE WHEN lang = 'fr' AND n_chars > 2000 THEN text || chr(10) ELSE text END"
ISSUE_SNAPSHOT_SQL = "'src' || CAST(item_id % 20 AS STRING)"


def _manifest(spark, sf_dir, filter_sql, text_sql="text"):
    d = table(spark, sf_dir, "documents").where(F.expr(filter_sql))
    return d.select("doc_id", F.expr(PATH_SQL).alias("path"),
                    F.md5(F.expr(text_sql)).alias("blob_sha"))


MANIFESTS_SQL = f"""old AS (SELECT doc_id, {PATH_SQL} AS path, md5(text) AS blob_sha
                      FROM documents WHERE {OLD_FILTER_SQL}),
new AS (SELECT doc_id, {PATH_SQL} AS path, md5({NEW_TEXT_SQL}) AS blob_sha
        FROM documents WHERE {NEW_FILTER_SQL}),
diff AS (SELECT coalesce(old.path, new.path) AS path, old.blob_sha AS old_blob, new.blob_sha AS new_blob,
                CASE WHEN old.blob_sha IS NULL THEN 'added' WHEN new.blob_sha IS NULL THEN 'removed'
                     ELSE 'modified' END AS status
         FROM old FULL OUTER JOIN new ON old.path = new.path
         WHERE old.blob_sha IS DISTINCT FROM new.blob_sha)"""


@register("snapshot_diff", sql=f"""
WITH {MANIFESTS_SQL}
SELECT path, old_blob, new_blob, status FROM diff
""")
def snapshot_diff(spark, sf_dir):
    """Added, removed and modified paths between two snapshots."""
    old = _manifest(spark, sf_dir, OLD_FILTER_SQL)
    new = _manifest(spark, sf_dir, NEW_FILTER_SQL, NEW_TEXT_SQL)
    return sn.snapshot_diff(old, new).select("path", "old_blob", "new_blob", "status")


@register("tree_diff", sql=f"""
WITH {MANIFESTS_SQL}
SELECT path, old_blob, new_blob, status FROM diff
""")
def tree_diff(spark, sf_dir):
    """G3 + K2 by hash trees: the same differences, reading only directories whose hashes differ."""
    old = _manifest(spark, sf_dir, OLD_FILTER_SQL).withColumn("side", F.lit("old"))
    new = _manifest(spark, sf_dir, NEW_FILTER_SQL, NEW_TEXT_SQL).withColumn("side", F.lit("new"))
    entries, roots = ht.hash_tree(old.unionByName(new), "side")
    pair = roots.agg(*[F.max(F.when(F.col("side") == s, F.col("tree"))).alias(f"{s}_tree") for s in ("old", "new")])
    return ht.tree_diff(pair, entries)[0].select("path", "old_blob", "new_blob", "status")


@register("recompute_units", sql=f"""
WITH {MANIFESTS_SQL}
SELECT doc_id, path, blob_sha FROM new WHERE path IN (SELECT path FROM diff)
""")
def recompute_units(spark, sf_dir):
    """K2 + C10: files of the new snapshot whose path is in the diff."""
    old = _manifest(spark, sf_dir, OLD_FILTER_SQL)
    new = _manifest(spark, sf_dir, NEW_FILTER_SQL, NEW_TEXT_SQL)
    return sn.units_to_recompute(new, sn.snapshot_diff(old, new))


# Feature store: documents already processed (in ``labels``) have stored
# features (token count per content id); the rest are misses.
STORE_SQL = """store AS (SELECT DISTINCT md5(d.text) AS blob_sha,
                              CAST(len(regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}_]{2,}')) AS INTEGER) AS n_tokens
                       FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
units AS (SELECT doc_id, md5(text) AS blob_sha, text FROM documents)"""


def _store(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    done = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return _features(done).distinct()


def _features(docs):
    from ..functions.text import token_count
    return docs.select(F.md5("text").alias("blob_sha"), token_count("text").alias("n_tokens"))


def _units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("blob_sha"), "text")


@register("feature_misses", sql=f"""
WITH {STORE_SQL}
SELECT blob_sha, CAST(count(*) AS BIGINT) AS n_units FROM units
WHERE blob_sha NOT IN (SELECT blob_sha FROM store) GROUP BY blob_sha
""")
def feature_misses(spark, sf_dir):
    """K1 + C7: content ids with no stored feature, and how many files share each."""
    units = _units(spark, sf_dir)
    miss = fs.misses(units, _store(spark, sf_dir), "blob_sha")
    return (units.join(miss, "blob_sha", "left_semi")
                 .groupBy("blob_sha").agg(F.count(F.lit(1)).alias("n_units")))


@register("feature_lookup", sql=f"""
WITH {STORE_SQL}
SELECT u.doc_id, u.blob_sha, s.n_tokens FROM units u LEFT JOIN store s ON u.blob_sha = s.blob_sha
""")
def feature_lookup(spark, sf_dir):
    """Every file with its stored feature (NULL when missing)."""
    units = _units(spark, sf_dir).select("doc_id", "blob_sha")
    return fs.lookup(units, _store(spark, sf_dir), "blob_sha")


@register("feature_upsert", sql=f"""
WITH {STORE_SQL},
new AS (SELECT DISTINCT blob_sha,
               CAST(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS INTEGER) AS n_tokens
        FROM units WHERE blob_sha NOT IN (SELECT blob_sha FROM store))
SELECT blob_sha, n_tokens, false AS computed FROM store
UNION ALL
SELECT blob_sha, n_tokens, true AS computed FROM new
""")
def feature_upsert(spark, sf_dir):
    """A15 + K1: the store after computing features for the misses only."""
    store = _store(spark, sf_dir).withColumn("computed", F.lit(False))
    units = _units(spark, sf_dir)
    todo = units.join(fs.misses(units, store, "blob_sha"), "blob_sha", "left_semi")
    new = _features(todo).distinct().withColumn("computed", F.lit(True))
    return fs.upsert(store, new, "blob_sha")


def _issues(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.expr(ISSUE_SNAPSHOT_SQL).alias("snapshot"), "item_id", "text")


def _snapshot_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("snapshot"), F.expr(PATH_SQL).alias("path"),
        F.md5("text").alias("blob_sha"), "text")


SCORES_CTE = f"""WITH q AS (SELECT snapshot, item_id, term, CAST(count(*) AS BIGINT) AS tf FROM
             (SELECT {ISSUE_SNAPSHOT_SQL} AS snapshot, item_id,
                     unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
              FROM benchmark) GROUP BY ALL),
m AS (SELECT source AS snapshot, {PATH_SQL} AS path, md5(text) AS blob_sha FROM documents),
b AS (SELECT blob_sha, term, CAST(count(*) AS BIGINT) AS tf FROM
        (SELECT blob_sha, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
         FROM (SELECT DISTINCT md5(text) AS blob_sha, text FROM documents)) GROUP BY ALL),
u AS (SELECT DISTINCT m.snapshot, b.blob_sha, b.term, b.tf FROM (SELECT DISTINCT snapshot, blob_sha FROM m) m
      JOIN b ON m.blob_sha = b.blob_sha),
qs AS (SELECT snapshot, item_id, sum(tf * tf) AS q_ss FROM q GROUP BY ALL),
us AS (SELECT snapshot, blob_sha, sum(tf * tf) AS u_ss FROM u GROUP BY ALL),
p AS (SELECT q.snapshot, q.item_id, u.blob_sha, sum(q.tf * u.tf) AS dot, sum(q.tf * q.tf) AS q_shared,
             sum(u.tf * u.tf) AS u_shared
      FROM q JOIN u ON q.snapshot = u.snapshot AND q.term = u.term GROUP BY ALL),
s AS (SELECT p.snapshot, p.item_id, p.blob_sha,
             round(CAST(dot AS DOUBLE) / sqrt((CAST('1.9753321701094941' AS DOUBLE) * q_ss
                   - (CAST('1.9753321701094941' AS DOUBLE) - 1.0) * q_shared)
                 * (CAST('1.9753321701094941' AS DOUBLE) * u_ss
                   - (CAST('1.9753321701094941' AS DOUBLE) - 1.0) * u_shared)), 6) AS score
      FROM p JOIN qs ON p.snapshot = qs.snapshot AND p.item_id = qs.item_id
             JOIN us ON p.snapshot = us.snapshot AND p.blob_sha = us.blob_sha)"""


@register("snapshot_scores", sql=f"""
{SCORES_CTE},
r AS (SELECT s.snapshot, s.item_id, m.path, s.score,
             CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, m.path) AS INTEGER) AS rank
      FROM s JOIN m ON s.snapshot = m.snapshot AND s.blob_sha = m.blob_sha)
SELECT snapshot, item_id, path, score, rank FROM r WHERE rank <= 3
""")
def snapshot_scores(spark, sf_dir):
    """K4 + J5 + F2: each issue scored only against the files of its own snapshot.

    Term counts are computed once per distinct content id, whatever the number
    of paths or snapshots holding it; scores are joined back to paths.
    """
    manifest = _snapshot_manifest(spark, sf_dir)
    blob_tf = sim.term_counts(sim.distinct_texts(manifest, "blob_sha"), "blob_sha", partition=False)
    q_tf = sim.term_counts(_issues(spark, sf_dir), "item_id", scope=["snapshot"])
    return sim.snapshot_top_k(q_tf, blob_tf, manifest, ["snapshot"], "item_id", k=3).select(
        "snapshot", "item_id", "path", "score", "rank")


# Long enough that some issues share a term with fewer files of their snapshot.
FILLED_K = 40


@register("snapshot_topk_filled", sql=f"""
{SCORES_CTE},
r AS (SELECT i.snapshot, i.item_id, m.path, coalesce(s.score, 0.0) AS score,
             CAST(row_number() OVER (PARTITION BY i.item_id ORDER BY coalesce(s.score, 0.0) DESC, m.path) AS INTEGER) AS rank
      FROM (SELECT {ISSUE_SNAPSHOT_SQL} AS snapshot, item_id FROM benchmark) i
      JOIN m ON i.snapshot = m.snapshot
      LEFT JOIN s ON s.snapshot = i.snapshot AND s.item_id = i.item_id AND s.blob_sha = m.blob_sha)
SELECT snapshot, item_id, path, score, rank FROM r WHERE rank <= {FILLED_K}
""")
def snapshot_topk_filled(spark, sf_dir):
    """The list of each issue up to k files of its snapshot, those without a shared term at score 0."""
    manifest = _snapshot_manifest(spark, sf_dir)
    blob_tf = sim.term_counts(sim.distinct_texts(manifest, "blob_sha"), "blob_sha", partition=False)
    issues = _issues(spark, sf_dir)
    q_tf = sim.term_counts(issues, "item_id", scope=["snapshot"])
    ranked = sim.snapshot_top_k(q_tf, blob_tf, manifest, ["snapshot"], "item_id", k=FILLED_K)
    return sim.fill_top_k(materialize(ranked, "ranked"), issues, manifest, ["snapshot"], "item_id", FILLED_K).select(
        "snapshot", "item_id", "path", "score", "rank")


@register("base_sha_chain", sql=f"""
WITH {LINKED_CTE}
SELECT repo_id, number, sha_base,
       first_value(sha_base) OVER (PARTITION BY repo_id ORDER BY created_at, number) AS first_sha,
       lag(sha_base) OVER (PARTITION BY repo_id ORDER BY created_at, number) AS prev_sha
FROM lp
""")
def base_sha_chain(spark, sf_dir):
    """Per repository, in creation order, the first base commit and the previous one."""
    p = linked_pulls(spark, sf_dir).select("repo_id", "number", "sha_base", "created_at")
    with_first = sn.first_in_order(p, "repo_id", ["created_at", "number"], "sha_base", "first_sha")
    chained = sn.previous_in_order(with_first, "repo_id", ["created_at", "number"], "sha_base",
                                   "prev_sha")
    return chained.select("repo_id", "number", "sha_base", "first_sha", "prev_sha")
