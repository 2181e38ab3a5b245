"""Store queries: ingest projections, file keys, result mapping, skip-done."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.patches import patch_lines
from ..functions.text import issue_text as issue_text_expr
from ..operators import catalog as cat
from ..operators import similarity as sim
from ..session import ensure_checkpoint_dir
from ..sources import store
from . import roles
from .queries_links import LINKED_CTE, linked_pulls, resolved_pulls
from .queries_similarity import pair_scores_sql
from .registry import register
from .tables import table

# Files: part rows; repository = p_size.  Files of type PROMO were not in the
# tree at ingest time, so changed files on them create new file rows (C4).
EXISTING_FILES_SQL = f"""files AS (
  SELECT CAST(p_size AS BIGINT) AS repo_id, {roles.FILE_PATH_SQL} AS path, p_partkey AS file_id
  FROM part WHERE p_type <> 'PROMO')"""
CHANGED_FILES_SQL = f"""changed AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_returnflag, l.l_quantity,
         l.l_discount, CAST(p.p_size AS BIGINT) AS repo_id, {roles.FILE_PATH_SQL} AS path,
         l.l_partkey AS file_id
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def existing_files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return (p.where(F.col("p_type") != "PROMO")
             .select(F.col("p_size").cast("bigint").alias("repo_id"),
                     F.expr(roles.FILE_PATH_SQL).alias("path"),
                     F.col("p_partkey").alias("file_id")))


def changed_files(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return (li.join(p, li.l_partkey == p.p_partkey)
              .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
                      "l_quantity", "l_discount",
                      F.col("p_size").cast("bigint").alias("repo_id"),
                      F.expr(roles.FILE_PATH_SQL).alias("path"),
                      F.col("l_partkey").alias("file_id")))


@register("scoring_input", sql=f"""
WITH {LINKED_CTE}, {roles.repos_cte_sql()}
SELECT lp.repo_id, r.full_name, o.o_orderkey AS issue_number, {roles.ISSUE_TITLE_SQL} AS title,
       {roles.ISSUE_BODY_SQL} AS body, lp.sha_base, lp.number AS pull_number, lp.created_at
FROM lp JOIN orders o ON o.o_custkey = lp.repo_id AND o.o_orderkey = lp.link
        JOIN repos r ON r.repo_id = lp.repo_id
""")
def scoring_input(spark, sf_dir):
    """C1 + B12: issue title/body with the base commit of the pull request closing it."""
    return cat.scoring_input(roles.repositories(spark, sf_dir), roles.issues(spark, sf_dir),
                             resolved_pulls(spark, sf_dir)).select(
        "repo_id", "full_name", "issue_number", "title", "body", "sha_base", "pull_number",
        "created_at")


@register("file_get_or_create", sql=f"""
WITH {EXISTING_FILES_SQL}, {CHANGED_FILES_SQL},
new AS (SELECT repo_id, path, min(file_id) AS file_id FROM changed c
        WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo_id = c.repo_id AND f.path = c.path)
        GROUP BY repo_id, path)
SELECT repo_id, path, file_id, false AS is_new FROM files
UNION ALL
SELECT repo_id, path, file_id, true AS is_new FROM new
""")
def file_get_or_create(spark, sf_dir):
    """C4: file table extended by the changed paths it did not have."""
    return cat.files_get_or_create(existing_files(spark, sf_dir), changed_files(spark, sf_dir))


@register("result_file_ids", sql=f"""
WITH {EXISTING_FILES_SQL}, {CHANGED_FILES_SQL},
ids AS (SELECT repo_id, path, min(file_id) AS file_id FROM files GROUP BY repo_id, path)
SELECT c.l_orderkey, c.l_partkey, c.l_suppkey, c.l_linenumber, c.repo_id, c.path, ids.file_id
FROM changed c LEFT JOIN ids ON c.repo_id = ids.repo_id AND c.path = ids.path
""")
def result_file_ids(spark, sf_dir):
    """C5 + Q16 + Q18: path -> smallest file id; unknown paths keep a NULL id."""
    res = changed_files(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey",
                                              "l_linenumber", "repo_id", "path")
    return cat.attach_file_ids(res, existing_files(spark, sf_dir))


@register("ingest_changes", sql=f"""
WITH {EXISTING_FILES_SQL}, {CHANGED_FILES_SQL},
new AS (SELECT repo_id, path, min(file_id) AS file_id FROM changed c
        WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo_id = c.repo_id AND f.path = c.path)
        GROUP BY repo_id, path),
allf AS (SELECT repo_id, path, file_id FROM files UNION ALL SELECT repo_id, path, file_id FROM new),
ids AS (SELECT repo_id, path, min(file_id) AS file_id FROM allf GROUP BY repo_id, path)
SELECT c.l_orderkey AS pull_number, c.l_linenumber, ids.file_id,
       CASE c.l_returnflag WHEN 'R' THEN 'removed' WHEN 'A' THEN 'added' ELSE 'modified' END AS status,
       CAST(floor(c.l_quantity) AS INTEGER) AS additions,
       CAST(floor(c.l_discount * 100) AS INTEGER) AS deletions,
       CAST(floor(c.l_quantity) AS INTEGER) + CAST(floor(c.l_discount * 100) AS INTEGER) AS changes
FROM changed c JOIN ids ON c.repo_id = ids.repo_id AND c.path = ids.path
""")
def ingest_changes(spark, sf_dir):
    """A7 + C4: changed-file facts keyed by the (possibly new) file id."""
    changed = changed_files(spark, sf_dir)
    files = cat.files_get_or_create(existing_files(spark, sf_dir), changed)
    ids = files.groupBy("repo_id", "path").agg(F.min("file_id").alias("file_id"))
    adds = F.floor("l_quantity").cast("int")
    dels = F.floor(F.col("l_discount") * 100).cast("int")
    return (changed.drop("file_id").join(ids, ["repo_id", "path"])
                   .select(F.col("l_orderkey").alias("pull_number"), "l_linenumber", "file_id",
                           F.when(F.col("l_returnflag") == "R", "removed")
                            .when(F.col("l_returnflag") == "A", "added")
                            .otherwise("modified").alias("status"),
                           adds.alias("additions"), dels.alias("deletions"),
                           (adds + dels).alias("changes")))


@register("skip_scored", sql="""
SELECT d.doc_id, d.source, d.n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def skip_scored(spark, sf_dir):
    """C6 + K3: documents not yet processed (labels hold the processed ones)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return cat.pending(docs, table(spark, sf_dir, "labels"), "doc_id")


@register("scored_counts", sql="""
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_results
FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
GROUP BY l.doc_id
""")
def scored_counts(spark, sf_dir):
    """Stored results per processed document."""
    labels = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    return cat.result_counts(labels, "doc_id")


@register("results_nested", sql=f"""
WITH {pair_scores_sql('benchmark', 'item_id', 'documents', 'doc_id')},
r AS (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS doc_ids,
       CAST(count(*) AS INTEGER) AS n_results
FROM r WHERE rank <= 3 GROUP BY item_id
""")
def results_nested(spark, sf_dir):
    """A13 + H15: one stored row per issue holding its ranked top-3 list."""
    top = sim.tfidf_top_k(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"),
                          "item_id", "doc_id", k=3)
    nested = cat.nest_results(top, "item_id", ("rank", "doc_id", "score"))
    return nested.select(
        "item_id",
        F.array_join(F.transform("results", lambda r: r["doc_id"].cast("string")), ",").alias("doc_ids"),
        F.size("results").alias("n_results"))


@register("ingest_issues", sql=f"""
SELECT o_custkey AS repo_id, o_orderkey AS number, {roles.ISSUE_TITLE_SQL} AS title,
       {roles.ISSUE_BODY_SQL} AS body, o_orderstatus AS state, o_orderdate AS created_at
FROM orders
""")
def ingest_issues(spark, sf_dir):
    """A4 + A9: the issue table in its declared schema."""
    return roles.issues(spark, sf_dir)


@register("ingest_pulls", sql=f"""
WITH {LINKED_CTE},
res AS (SELECT lp.repo_id, lp.number, o.o_orderkey AS issue_number
        FROM lp JOIN orders o ON o.o_custkey = lp.repo_id AND o.o_orderkey = lp.link)
SELECT lp.repo_id, lp.number, lp.title, lp.body, lp.state, lp.sha_base, res.issue_number,
       lp.created_at, lp.merged_at
FROM lp LEFT JOIN res ON lp.repo_id = res.repo_id AND lp.number = res.number
""")
def ingest_pulls(spark, sf_dir):
    """A3 + K5: the pull-request table with its resolved issue (NULL when none)."""
    # One left join of the linked pulls to the issues: links are extracted once.
    issues = roles.issues(spark, sf_dir).select("repo_id", F.col("number").alias("issue_number"))
    linked = linked_pulls(spark, sf_dir)
    return (linked.join(issues, (linked.repo_id == issues.repo_id) & (linked.link == issues.issue_number), "left").drop(issues.repo_id)
            .select("repo_id", "number", "title", "body", "state", "sha_base", "issue_number",
                    "created_at", "merged_at"))


@register("ingest_comments", sql=f"""
SELECT conv_id AS number, turn AS seq, role AS author, {roles.COMMENT_BODY_SQL} AS body
FROM conversations c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = c.conv_id)
""")
def ingest_comments(spark, sf_dir):
    """Comments of known issues/pull requests (semi join on the number)."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("number"), F.col("turn").alias("seq"), F.col("role").alias("author"),
        F.expr(roles.COMMENT_BODY_SQL).alias("body"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"))
    return c.join(known, "number", "left_semi")


@register("ingest_repository", sql=f"""
WITH {roles.repos_cte_sql()}
SELECT repo_id, full_name, description, language, stars FROM repos
""")
def ingest_repository(spark, sf_dir):
    """A1: repository rows, five declared fields (stars from the star count)."""
    return roles.repositories(spark, sf_dir).select(
        "repo_id", "full_name", "description", "language", "stars")


@register("issue_text", sql=f"""
SELECT o_custkey AS repo_id, o_orderkey AS number,
       concat_ws(', ', {roles.ISSUE_TITLE_SQL}, {roles.ISSUE_BODY_SQL}) AS text
FROM orders
""")
def issue_text(spark, sf_dir):
    """H6 + H17: issue query text; a missing body is skipped, not an error."""
    i = roles.issues(spark, sf_dir)
    return i.select("repo_id", "number", issue_text_expr("title", "body").alias("text"))


@register("store_versions", sql="""
WITH old AS (SELECT CAST(o_orderkey AS BIGINT) AS number, CAST(o_custkey % 16 AS BIGINT) AS repo_id, o_orderpriority AS title FROM orders WHERE o_orderstatus <> 'O'),
new AS (SELECT CAST(o_orderkey AS BIGINT) AS number, CAST(o_custkey % 16 AS BIGINT) AS repo_id, CASE WHEN o_orderstatus = 'P' THEN 'edited' ELSE o_orderpriority END AS title
        FROM orders WHERE o_orderstatus <> 'F'),
after AS (SELECT * FROM new UNION ALL
          SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.repo_id = old.repo_id AND new.number = old.number))
SELECT coalesce(a.repo_id, o.repo_id) AS repo_id, coalesce(a.number, o.number) AS number, o.title AS title_before, a.title AS title_after
FROM after a FULL JOIN old o ON a.repo_id = o.repo_id AND a.number = o.number
""")
def store_versions(spark, sf_dir):
    """A12 + A15 + U2: issues merged into a store in two commits, both versions read and compared."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders")
    no = F.lit(None).cast("string")
    rows = o.select((F.col("o_custkey") % 16).cast("bigint").alias("repo_id"), F.col("o_orderkey").cast("bigint").alias("number"),
                    F.col("o_orderkey").cast("bigint").alias("issue_id"), F.col("o_orderpriority").alias("title"), no.alias("body"),
                    no.alias("state"), F.lit(None).cast("timestamp").alias("created_at"), "o_orderstatus")
    edited = rows.withColumn("title", F.when(F.col("o_orderstatus") == "P", "edited").otherwise(F.col("title")))
    store.merge(spark, rows.where("o_orderstatus <> 'O'"), root, "issue")
    store.merge(spark, edited.where("o_orderstatus <> 'F'"), root, "issue")
    before, after = (store.read(spark, root, "issue", n).select("repo_id", "number", F.col("title").alias(f"title_{when}"))
                     for n, when in ((1, "before"), (2, "after")))
    return after.join(before, ["repo_id", "number"], "full").select("repo_id", "number", "title_before", "title_after")


# Patches of changed files: a hunk whose kept, removed and added lines depend on the row, on some rows a second one
# that creates lines, a remark, file headers, lines that look like marks, and on some rows no patch.
PATCH_SQL = """CASE WHEN l_linenumber = 7 THEN NULL ELSE
  CASE WHEN l_partkey % 2 = 0 THEN '--- a/x.py' || chr(10) || '+++ b/x.py' || chr(10) ELSE '' END
  || '@@ -' || CAST(l_partkey + 1 AS STRING) || ',3 +' || CAST(l_partkey + 2 AS STRING) || ',4 @@ def f' || chr(10)
  || ' @@ kept ' || l_returnflag || chr(10) || '-old @@ -1 +1 @@' || chr(10) || '+- new' || chr(10) || '+' || chr(10) || ' end' || chr(10)
  || CASE WHEN l_linenumber % 2 = 0 THEN '@@ -0,0 +' || CAST(l_suppkey + 50 AS STRING) || ' @@' || chr(10) || '+made ' || l_linestatus || chr(10)
                                          || chr(92) || ' No newline at end of file' ELSE '' END END"""


@register("patch_changes", sql=f"""
WITH c AS (SELECT row_number() OVER () AS id, l_orderkey, l_partkey, {PATCH_SQL} AS patch FROM lineitem),
l AS (SELECT id, l_orderkey, l_partkey, unnest(string_split(patch, chr(10))) AS t,
             unnest(generate_series(1, len(string_split(patch, chr(10))))) AS i FROM c WHERE patch IS NOT NULL),
h AS (SELECT *, regexp_matches(t, '^@@ -') AS head,
             sum(CASE WHEN regexp_matches(t, '^@@ -') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS hunk FROM l),
n AS (SELECT *, max(CASE WHEN head THEN t END) OVER (PARTITION BY id, hunk) AS header FROM h WHERE hunk > 0),
m AS (SELECT *, substr(t, 1, 1) AS mark,
             CAST(regexp_extract(header, '-([0-9]+)', 1) AS INTEGER) + CASE WHEN contains(header, '-0,0') THEN 1 ELSE 0 END AS old_start,
             CAST(regexp_extract(header, '\+([0-9]+)', 1) AS INTEGER) AS new_start
      FROM n WHERE NOT head AND t <> '' AND NOT starts_with(t, chr(92))),
w AS (SELECT *, sum(CASE WHEN mark <> '+' THEN 1 ELSE 0 END) OVER (PARTITION BY id, hunk ORDER BY i) AS o,
             sum(CASE WHEN mark <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id, hunk ORDER BY i) AS e FROM m)
SELECT l_orderkey, l_partkey, CAST(hunk AS INTEGER) AS hunk,
       CASE mark WHEN '+' THEN 'added' WHEN '-' THEN 'removed' ELSE 'kept' END AS kind,
       CAST(CASE WHEN mark <> '+' THEN old_start + o - 1 END AS INTEGER) AS old_line,
       CAST(CASE WHEN mark <> '-' THEN new_start + e - 1 END AS INTEGER) AS new_line, substr(t, 2) AS line
FROM w
""")
def patch_changes(spark, sf_dir):
    """Every line of every patch with its numbers before and after."""
    changes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.expr(PATCH_SQL.replace("chr(92)", "char(92)")).alias("patch"))
    return patch_lines(changes)
