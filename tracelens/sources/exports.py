"""Readers of code-host exports.

The reference pages through a remote API object by object.  Here the same
objects arrive as JSON-lines exports read with a fixed schema (no inference)
and are projected to the stored tables' schemas.  Every reader is a scan plus
column expressions, so Catalyst prunes columns and pushes filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.links import number_from_url


_CORRUPT = "__corrupt"

# The exports of an ingest and the objects in them.
SCHEMAS = {"repositories": S.REPOSITORY_EXPORT, "issues": S.ISSUE_EXPORT, "pulls": S.PULL_EXPORT, "review_comments": S.REVIEW_COMMENT_EXPORT,
           "issue_comments": S.ISSUE_COMMENT_EXPORT, "pull_files": S.PULL_FILE_EXPORT, "tree": S.TREE_EXPORT}


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``value`` (the line) and ``row`` (the parsed struct) of every line that is not blank."""
    fields = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return (spark.read.text(path).where(F.trim("value") != "")
            .select("value", F.from_json("value", fields, options).alias("row")))


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The well-formed lines of an export; the others are in ``read_rejects``."""
    good = _parsed(spark, path, schema).where(F.col(f"row.{_CORRUPT}").isNull())
    return good.select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields])


def read_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``line``: the lines of an export that are not an object of its schema."""
    return _parsed(spark, path, schema).where(F.col(f"row.{_CORRUPT}").isNotNull()).select(F.col("value").alias("line"))


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """Repository export with the searchable attributes (stars, forks, size, ...)."""
    r = _json(spark, path, S.REPOSITORY_EXPORT)
    return r.select(F.col("id").alias("repo_id"), "full_name", "description", "language",
                    F.col("stargazers_count").alias("stars"), "forks", "size", "topics",
                    F.col("html_url").alias("url"), F.col("subscribers_count").alias("subscribers"),
                    "private", "archived", "pushed_at")


def repository_record(repos: DataFrame, full_name: str | None = None) -> DataFrame:
    """A1: the five stored repository fields (one repository when named)."""
    if full_name is not None:
        repos = repos.where(F.col("full_name") == F.lit(full_name))
    return repos.select("repo_id", "full_name", "description", "language", "stars")


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """A4: issues keyed by ``(repo_id, number)``."""
    i = _json(spark, path, S.ISSUE_EXPORT)
    return i.select("repo_id", "number", F.col("id").alias("issue_id"), "title", "body", "state",
                    "created_at")


def read_pulls(spark: SparkSession, path: str) -> DataFrame:
    """A3: pull requests; the number falls back to the URL tail (H3)."""
    p = _json(spark, path, S.PULL_EXPORT)
    return p.select("repo_id",
                    F.coalesce(F.col("number"), number_from_url("html_url")).alias("number"),
                    F.col("id").alias("pull_id"), "title", "body", "state",
                    F.col("base.sha").alias("sha_base"), "created_at", "merged_at")


def read_review_comments(spark: SparkSession, path: str) -> DataFrame:
    """Review comments of pull requests, in order (feeds link extraction)."""
    c = _json(spark, path, S.REVIEW_COMMENT_EXPORT)
    return c.select(F.col("id").alias("comment_id"), "repo_id",
                    F.col("pull_number").alias("number"), "seq", "body")


def read_issue_comments(spark: SparkSession, path: str, issues: DataFrame | None = None) -> DataFrame:
    """A5: issue comments; with ``issues`` only those of known issues (semi join)."""
    c = _json(spark, path, S.ISSUE_COMMENT_EXPORT)
    out = c.select(F.col("id").alias("comment_id"), "repo_id",
                   F.col("issue_number").alias("number"), "seq", "body")
    if issues is not None:
        out = out.join(issues.select("repo_id", "number"), ["repo_id", "number"], "left_semi")
    return out


def read_pull_files(spark: SparkSession, path: str) -> DataFrame:
    """Changed files of pull requests."""
    f = _json(spark, path, S.PULL_FILE_EXPORT)
    return f.select("repo_id", "pull_number", F.col("filename").alias("path"), "sha", "status",
                    "patch", "additions", "deletions", "changes")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """A2 + B7: file entries of a tree listing (directories skipped) as a manifest."""
    t = _json(spark, path, S.TREE_EXPORT)
    return (t.where(F.col("type") != "dir")
             .select("repo_id", "snapshot_sha", "path", F.col("sha").alias("blob_sha")))
