"""Link extraction queries: orders play pull requests and issues,
conversations play review comments (see ``roles``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.links import closing_refs
from ..operators import links as lk
from . import roles
from .registry import register

# DuckDB form of the closing-reference pattern (RE2: ASCII classes, digits
# spelled out).  The texts built by ``roles`` are ASCII, so it agrees with the
# Unicode-aware Java pattern used by the library.
REF_RE = r"(?:close[sd]?|fix(?:es|ed)?|resolve[sd]?)\s+(?:#|https?://[^/]+/[^/]+/[^/]+/[^/]+/)([0-9]+)"


def refs_sql(x: str) -> str:
    return (f"list_transform(regexp_extract_all(lower(coalesce({x}, '')), '{REF_RE}', 1), "
            f"lambda s: CAST(s AS BIGINT))")


PULLS_CTE = f"""pulls AS (
  SELECT o_custkey AS repo_id, o_orderkey AS number, {roles.PR_TITLE_SQL} AS title,
         {roles.PR_BODY_SQL} AS body, o_orderstatus AS state, o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS merged_at,
         {roles.PR_BASE_SHA_SQL} AS sha_base
  FROM orders)"""

COMMENTS_CTE = f"""cm AS (SELECT conv_id AS number, turn AS seq, {roles.COMMENT_BODY_SQL} AS body
                FROM conversations),
cr AS (SELECT number, seq, unnest(refs) AS ref, unnest(generate_series(0, len(refs) - 1)) AS pos
       FROM (SELECT number, seq, {refs_sql('body')} AS refs FROM cm)),
fc AS (SELECT number, arg_min(ref, (seq, pos)) AS comment_link,
              CAST(count(*) AS BIGINT) AS n_comment_links FROM cr GROUP BY number)"""

LINKED_CTE = f"""{PULLS_CTE},
{COMMENTS_CTE},
pl AS (SELECT p.*, {refs_sql('p.title')}[1] AS tl, {refs_sql('p.body')}[1] AS bl, fc.comment_link AS cl
       FROM pulls p LEFT JOIN fc ON p.number = fc.number),
lp AS (SELECT repo_id, number, title, body, state, created_at, merged_at, sha_base,
              coalesce(tl, bl, cl) AS link,
              CASE WHEN tl IS NOT NULL THEN 'title' WHEN bl IS NOT NULL THEN 'body'
                   WHEN cl IS NOT NULL THEN 'comment' END AS link_source
       FROM pl)"""


def linked_pulls(spark, sf_dir):
    return lk.pull_links(roles.pulls(spark, sf_dir), "number", roles.pull_comments(spark, sf_dir))


def resolved_pulls(spark, sf_dir):
    return lk.resolve_links(linked_pulls(spark, sf_dir), roles.issues(spark, sf_dir),
                            issue_cols=["state"])


def _joined(c):
    return F.array_join(F.transform(closing_refs(c), lambda x: x.cast("string")), ",")


@register("link_extract", sql=f"""
WITH {PULLS_CTE}
SELECT repo_id, number,
       array_to_string({refs_sql('title')}, ',') AS title_refs,
       array_to_string({refs_sql('body')}, ',') AS body_refs,
       coalesce({refs_sql('title')}[1], {refs_sql('body')}[1]) AS link,
       CASE WHEN {refs_sql('title')}[1] IS NOT NULL THEN 'title'
            WHEN {refs_sql('body')}[1] IS NOT NULL THEN 'body' END AS link_source
FROM pulls
""")
def link_extract(spark, sf_dir):
    """H1 + H2 (title, body) + H16 over every pull request."""
    p = roles.pulls(spark, sf_dir)
    return (lk.pull_links(p, "number")
              .select("repo_id", "number", _joined("title").alias("title_refs"),
                      _joined("body").alias("body_refs"), "link", "link_source"))


@register("link_first_comment", sql=f"""
WITH {COMMENTS_CTE}
SELECT number, comment_link, n_comment_links FROM fc
""")
def link_first_comment(spark, sf_dir):
    """D3: first reference over each pull request's comments, in order."""
    return lk.first_comment_ref(roles.pull_comments(spark, sf_dir), "number")


@register("comment_links", sql=f"""
WITH {COMMENTS_CTE}
SELECT number, seq, CAST(pos AS INTEGER) AS pos, ref FROM cr
""")
def comment_links(spark, sf_dir):
    """All comment references in order, one row each."""
    return lk.comment_refs(roles.pull_comments(spark, sf_dir), "number")


@register("pr_issue_join", sql=f"""
WITH {LINKED_CTE}
SELECT lp.repo_id, lp.number, lp.link_source, o.o_orderkey AS issue_number,
       o.o_orderstatus AS issue_state, lp.created_at
FROM lp JOIN orders o ON o.o_custkey = lp.repo_id AND o.o_orderkey = lp.link
""")
def pr_issue_join(spark, sf_dir):
    """H2 with comments + C3 + B8: each pull request with the issue it closes."""
    return resolved_pulls(spark, sf_dir).select(
        "repo_id", "number", "link_source", "issue_number", "issue_state", "created_at")


@register("pr_unresolved", sql=f"""
WITH {LINKED_CTE}
SELECT repo_id, number, link, link_source FROM lp
WHERE link IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = lp.repo_id AND o.o_orderkey = lp.link)
""")
def pr_unresolved(spark, sf_dir):
    """B8 rejects: pull requests whose referenced issue does not exist."""
    return (lk.resolve_links(linked_pulls(spark, sf_dir), roles.issues(spark, sf_dir), how="left_anti")
              .select("repo_id", "number", "link", "link_source"))


@register("linked_merged_pulls", sql=f"""
WITH {LINKED_CTE}
SELECT repo_id, number, link, created_at FROM lp
WHERE merged_at IS NOT NULL AND link IS NOT NULL
  AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = lp.repo_id AND o.o_orderkey = lp.link)
ORDER BY created_at, number
""")
def linked_merged_pulls(spark, sf_dir):
    """B3 + F4: merged pull requests linked to an existing issue, oldest first."""
    merged = lk.merged_and_linked(linked_pulls(spark, sf_dir))
    found = (lk.resolve_links(merged, roles.issues(spark, sf_dir), how="left_semi")
               .select("repo_id", "number", "link", "created_at"))
    return lk.in_creation_order(found)


@register("first_pr_per_issue", sql=f"""
WITH {LINKED_CTE},
r AS (SELECT lp.repo_id, lp.link AS issue_number, lp.number, lp.created_at
      FROM lp JOIN orders o ON o.o_custkey = lp.repo_id AND o.o_orderkey = lp.link),
w AS (SELECT repo_id, issue_number, number,
             row_number() OVER (PARTITION BY repo_id, issue_number ORDER BY created_at, number) AS rn,
             count(*) OVER (PARTITION BY repo_id, issue_number) AS n_pulls
      FROM r)
SELECT repo_id, issue_number, number AS first_number, CAST(n_pulls AS BIGINT) AS n_pulls
FROM w WHERE rn = 1
""")
def first_pr_per_issue(spark, sf_dir):
    """The earliest pull request reaching each issue wins."""
    return lk.first_pull_per_issue(resolved_pulls(spark, sf_dir), ["repo_id", "issue_number"],
                                   ["created_at"], "number")


@register("link_update", sql=f"""
WITH {LINKED_CTE},
old AS (SELECT repo_id, number, {refs_sql('title')}[1] AS issue_number FROM pulls),
new AS (SELECT lp.repo_id, lp.number, o.o_orderkey AS issue_number
        FROM lp JOIN orders o ON o.o_custkey = lp.repo_id AND o.o_orderkey = lp.link)
SELECT old.repo_id, old.number, coalesce(new.issue_number, old.issue_number) AS issue_number
FROM old LEFT JOIN new ON old.repo_id = new.repo_id AND old.number = new.number
""")
def link_update(spark, sf_dir):
    """K5: stored link (first title reference) replaced by the resolved link where one exists."""
    old = roles.pulls(spark, sf_dir).select(
        "repo_id", "number", F.get(closing_refs("title"), 0).alias("issue_number"))
    new = resolved_pulls(spark, sf_dir).select("repo_id", "number", "issue_number")
    return lk.update_links(old, new, ["repo_id", "number"]).select("repo_id", "number", "issue_number")
