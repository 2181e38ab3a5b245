"""Repository search.

The reference sends qualifiers to a remote search and then issues one more
search per hit to count merged, linked pull requests.  Here the qualifiers are
``where`` predicates on a repository table and the per-hit count is one
grouped aggregation joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_topics
from ..session import broadcast_limit


def search_predicate(min_stars: float | None = None, language: str | None = None,
                     min_size: float | None = None, min_forks: float | None = None,
                     public_only: bool = True, exclude_archived: bool = False,
                     pushed_since: str | None = None) -> Column:
    """B1/B2: conjunction of the search qualifiers that were given.

    Language compares case-insensitively (the service does); NULL columns
    never match a qualifier on them.
    """
    cond = F.lit(True)
    if min_stars is not None:
        cond &= F.col("stars") >= F.lit(min_stars)
    if language is not None:
        cond &= F.lower(F.col("language")) == F.lit(language.lower())
    if min_size is not None:
        cond &= F.col("size") >= F.lit(min_size)
    if min_forks is not None:
        cond &= F.col("forks") >= F.lit(min_forks)
    if public_only:
        cond &= ~F.coalesce(F.col("private"), F.lit(False))
    if exclude_archived:
        cond &= ~F.coalesce(F.col("archived"), F.lit(False))
    if pushed_since is not None:
        cond &= F.col("pushed_at") >= F.to_timestamp(F.lit(pushed_since))
    return cond


def linked_counts(linked_pulls: DataFrame, repo: str = "repo_id") -> DataFrame:
    """Merged pull requests with a closing reference, per repository."""
    return (linked_pulls.where(F.col("merged_at").isNotNull() & F.col("link").isNotNull())
                        .groupBy(repo).agg(F.count(F.lit(1)).alias("linked_issues")))


def search(repos: DataFrame, linked_pulls: DataFrame, predicate: Column,
           limit: int | None = None) -> DataFrame:
    """F3 + D2: matching repositories by stars (desc, then id) with their count.

    With a limit, the top rows are chosen first (the count does not affect the
    order); the pull requests are then semi-joined to at most ``limit``
    repositories, a broadcast whose size the limit bounds, before aggregating.
    ``limit=None`` means no limit (the reference's 0 or negative).
    """
    hits = repos.where(predicate)
    if limit is not None and limit > 0:
        hits = hits.orderBy(F.col("stars").desc(), F.col("repo_id").asc()).limit(limit)
        ids = hits.select("repo_id")
        if limit * 16 <= broadcast_limit(repos.sparkSession):  # at most ``limit`` ids
            ids = F.broadcast(ids)
        pulls = linked_pulls.join(ids, "repo_id", "left_semi")
    else:
        pulls = linked_pulls
    counts = linked_counts(pulls)
    return (hits.join(counts, "repo_id", "left")
                .withColumn("linked_issues", F.coalesce("linked_issues", F.lit(0)).cast("bigint")))


def report(found: DataFrame) -> DataFrame:
    """The five-column text report FullName, Stars, Issues, Size, Url."""
    return found.select(
        F.col("full_name"),
        F.col("stars").cast("string").alias("stars"),
        F.col("linked_issues").cast("string").alias("issues"),
        F.col("size").cast("string").alias("size"),
        F.col("url"),
    )


def union_searches(*found: DataFrame, dedupe: bool = False) -> DataFrame:
    """G1: several searches appended, duplicates kept unless ``dedupe``."""
    out = reduce(lambda a, b: a.unionByName(b), found)
    return out.dropDuplicates(["repo_id"]) if dedupe else out


def table_view(found: DataFrame, *keep: str) -> DataFrame:
    """The seven-column view FullName, Stars, Subscribers, Forks, Size, Issues, Lang."""
    return found.select(*keep, "full_name", "stars", "subscribers", "forks", "size",
                        "linked_issues", "language")


def detail_view(found: DataFrame, *keep: str) -> DataFrame:
    """B11 + H5: the four-field detail view with topics joined by ', '."""
    return found.select(*keep, "full_name", "description",
                        join_topics("topics").alias("topics"), "url")
