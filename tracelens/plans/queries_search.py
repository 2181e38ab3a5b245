"""Repository search queries: customers play repositories (see ``roles``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as se
from . import roles
from .queries_links import LINKED_CTE, linked_pulls
from .registry import register

# Fixed parameters of the three searches of the reference's notebook, mapped
# onto the role columns (stars, size in KB, forks; a language each; public,
# not archived, pushed since a date; 10 hits each).
NOTEBOOK_SEARCHES = [
    dict(min_stars=9000, language="Building"),
    dict(min_size=20000, language="machinery"),
    dict(min_forks=900, language="AUTOMOBILE"),
]
NOTEBOOK_COMMON = dict(exclude_archived=True, pushed_since="1998-01-01")
NOTEBOOK_LIMIT = 10


@register("repo_search", sql=f"""
WITH {LINKED_CTE}, {roles.repos_cte_sql()},
hits AS (SELECT * FROM repos
         WHERE stars >= 5000 AND lower(language) = 'building' AND NOT coalesce(private, false)
         ORDER BY stars DESC, repo_id LIMIT 20),
cnt AS (SELECT repo_id, count(*) AS n FROM lp
        WHERE merged_at IS NOT NULL AND link IS NOT NULL GROUP BY repo_id)
SELECT full_name, CAST(stars AS VARCHAR) AS stars, CAST(coalesce(n, 0) AS VARCHAR) AS issues,
       CAST(size AS VARCHAR) AS size, url
FROM hits LEFT JOIN cnt ON hits.repo_id = cnt.repo_id
""")
def repo_search(spark, sf_dir):
    """B1 + D2 + F3 + B10 + A17: find-repo report, 20 repositories by stars."""
    found = se.search(roles.repositories(spark, sf_dir), linked_pulls(spark, sf_dir),
                      se.search_predicate(min_stars=5000, language="building"), limit=20)
    return se.report(found)


def _notebook_union(spark, sf_dir):
    repos = roles.repositories(spark, sf_dir, with_pushed_at=True)
    pulls = linked_pulls(spark, sf_dir)
    found = [se.search(repos, pulls, se.search_predicate(**s, **NOTEBOOK_COMMON), NOTEBOOK_LIMIT)
               .withColumn("search", F.lit(i + 1))
             for i, s in enumerate(NOTEBOOK_SEARCHES)]
    return se.union_searches(*found)


def _notebook_sql(select: str) -> str:
    parts = []
    preds = ["stars >= 9000 AND lower(language) = 'building'",
             "size >= 20000 AND lower(language) = 'machinery'",
             "forks >= 900 AND lower(language) = 'automobile'"]
    for i, p in enumerate(preds):
        parts.append(f"""(SELECT {i + 1} AS search, * FROM repos
          WHERE {p} AND NOT coalesce(private, false) AND NOT coalesce(archived, false)
            AND pushed_at >= TIMESTAMP '1998-01-01'
          ORDER BY stars DESC, repo_id LIMIT {NOTEBOOK_LIMIT})""")
    union = "\nUNION ALL\n".join(parts)
    return f"""
WITH {LINKED_CTE}, {roles.repos_cte_sql(with_pushed_at=True)},
hits AS ({union}),
cnt AS (SELECT repo_id, count(*) AS n FROM lp
        WHERE merged_at IS NOT NULL AND link IS NOT NULL GROUP BY repo_id),
found AS (SELECT hits.*, CAST(coalesce(n, 0) AS BIGINT) AS linked_issues
          FROM hits LEFT JOIN cnt ON hits.repo_id = cnt.repo_id)
SELECT {select} FROM found"""


@register("repo_search_union", sql=_notebook_sql(
    "search, full_name, stars, subscribers, forks, size, linked_issues, language"))
def repo_search_union(spark, sf_dir):
    """B2 + G1 + B11: the notebook's three searches appended, seven-column view."""
    return se.table_view(_notebook_union(spark, sf_dir), "search")


@register("repo_search_details", sql=_notebook_sql(
    "search, full_name, description, array_to_string(topics, ', ') AS topics, url"))
def repo_search_details(spark, sf_dir):
    """B11 + H5: detail view (description, topics joined, URL) of the same union."""
    return se.detail_view(_notebook_union(spark, sf_dir), "search")
