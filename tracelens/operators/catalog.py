"""Relational store operations.

The reference keeps seven tables in an embedded database and reaches them row
by row.  Here each operation is one set-oriented DataFrame expression over
natural keys (SURVEY 1.4): repository ``repo_id``; issue and pull request
``(repo_id, number)``; file ``(repo_id, path)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cols(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def repo_id_by_name(repos: DataFrame, full_name: str) -> DataFrame:
    """One-column frame with the id of the named repository (empty if unknown)."""
    return repos.where(F.col("full_name") == F.lit(full_name)).select("repo_id")


def scoring_input(repos: DataFrame, issues: DataFrame, resolved_pulls: DataFrame,
                  repo_name: str | None = None) -> DataFrame:
    """C1 + B12: ``(repo_id, full_name, issue_number, title, body, sha_base, created_at)``.

    One row per (issue, pull request) link; ``repo_name`` narrows to one
    repository through C2 (a semi join, planned as a broadcast of one row).
    """
    if repo_name is not None:
        repos = repos.where(F.col("full_name") == F.lit(repo_name))
    i = issues.select("repo_id", F.col("number").alias("issue_number"), "title", "body")
    p = resolved_pulls.select("repo_id", "issue_number", "sha_base",
                              F.col("number").alias("pull_number"), "created_at")
    return (p.join(i, ["repo_id", "issue_number"])
             .join(repos.select("repo_id", "full_name"), "repo_id"))


def files_get_or_create(files: DataFrame, changed: DataFrame,
                        key: Sequence[str] = ("repo_id", "path"),
                        new_id: str = "file_id") -> DataFrame:
    """C4: the file table plus one row for each changed path not in it yet.

    New rows take the smallest ``new_id`` seen among the changed rows of that
    path and ``is_new = true``; existing rows are kept as they are.
    """
    k = _cols(key)
    missing = changed.select(*k, new_id).join(files.select(*k), k, "left_anti")
    new_rows = missing.groupBy(*k).agg(F.min(new_id).alias(new_id))
    return (files.select(*k, new_id).withColumn("is_new", F.lit(False))
                 .unionByName(new_rows.withColumn("is_new", F.lit(True))))


def attach_file_ids(results: DataFrame, files: DataFrame,
                    key: Sequence[str] = ("repo_id", "path"), file_id: str = "file_id") -> DataFrame:
    """C5 (Q16, Q18): add the smallest file id per path; NULL where the path is unknown."""
    k = _cols(key)
    ids = files.groupBy(*k).agg(F.min(file_id).alias(file_id))
    return results.join(ids, k, "left")


def pending(items: DataFrame, done: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Items not processed yet (``left_anti`` on the key)."""
    k = _cols(key)
    return items.join(done.select(*k), k, "left_anti")


def result_counts(results: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Stored results per key (the reference tests ``> 0``)."""
    return results.groupBy(*_cols(key)).agg(F.count(F.lit(1)).alias("n_results"))


def nest_results(ranked: DataFrame, key: Sequence[str] | str,
                 fields: Sequence[str] = ("rank", "path", "file_id", "score")) -> DataFrame:
    """A13 + H15: one row per key with its ranked list, for top-k results.

    Only for bounded (top-k) inputs; the full ranking stays a flat table.
    ``results_json`` is the list serialised as JSON for export.
    """
    k = _cols(key)
    nested = (ranked.groupBy(*k)
                    .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("results")))
    return nested.withColumn("results_json", F.to_json("results"))
