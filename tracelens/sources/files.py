"""Source snapshots read from storage.

A materialised snapshot is a directory tree of files.  ``binaryFile`` lists
and reads them in parallel; the content id is the git blob id, so manifests
built here join with exported tree listings and with the feature store.

Spark's file scan leaves out files of no bytes and all names that begin with
``_`` or ``.`` (``__init__.py``, everything below ``_vendor/``).  Those are
listed and read through Arrow's file systems instead (local, HDFS, S3, GCS; on
any other storage that raises).
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import git_blob_sha
from ..session import qualified_path


def _storage(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system for a path as Spark spells it, and the path in it."""
    if uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return arrow_fs.FileSystem.from_uri(uri)


def _skipped_by_scan(relative: str, size: int) -> bool:
    """Whether Spark's file scan leaves a file out."""
    names = relative.split("/")
    return (size == 0 or names[-1].endswith("._COPYING_")
            or any(n.startswith(".") or n.startswith("_") and "=" not in n for n in names))


def _left_out(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``(path, content)`` of the files below ``root`` that Spark's scan leaves out.

    The listing is made by the driver, as Spark's own is; contents are read in tasks.
    """
    store, top = _storage(root)
    top = top.rstrip("/")
    paths = []
    for info in store.get_file_info(arrow_fs.FileSelector(top, recursive=True)):
        relative = info.path[len(top) + 1:]
        if info.is_file and fnmatch.fnmatchcase(info.base_name, glob) and _skipped_by_scan(relative, info.size):
            paths.append((f"{root.rstrip('/')}/{relative}",))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                opened, inside = _storage(path)
                with opened.open_input_stream(inside) as f:
                    content = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])

    return spark.createDataFrame(paths, "path string").mapInArrow(read, "path string, content binary")


def _files(spark: SparkSession, root: str, glob: str) -> tuple[DataFrame, Column]:
    """The files below ``root`` and their path relative to it; a file elsewhere is an error, never a lost row."""
    files = (spark.read.format("binaryFile")
                  .option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", glob)
                  .load(root)).select("path", "content")
    top = qualified_path(spark, root)
    files = files.unionByName(_left_out(spark, top, glob))
    prefix = top.rstrip("/") + "/"
    relative = F.when(F.startswith(F.col("path"), F.lit(prefix)), F.substr(F.col("path"), F.lit(len(prefix) + 1))).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {prefix}: "), F.col("path"))))
    return files, relative


def _text() -> Column:
    """The content as text; NULL when it is not UTF-8 (``invalid_sources`` lists these files)."""
    return F.try_validate_utf8(F.col("content").cast("string"))


def read_source_tree(spark: SparkSession, root: str, repo_id: int, snapshot_sha: str,
                     glob: str = "*.py") -> DataFrame:
    """``(repo_id, snapshot_sha, path, blob_sha, source)`` of every matching file.

    ``path`` is relative to ``root`` with ``/`` separators (H7); ``source`` is
    the whole file decoded as UTF-8, NULL if it is not.
    """
    files, relative = _files(spark, root, glob)
    return files.select(
        F.lit(repo_id).cast("bigint").alias("repo_id"),
        F.lit(snapshot_sha).alias("snapshot_sha"),
        relative.alias("path"),
        git_blob_sha("content").alias("blob_sha"),
        _text().alias("source"),
    )


def read_source_trees(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """A8 for many snapshots in one scan: ``root/<repo_id>/<snapshot_sha>/<path>``.

    Same columns as ``read_source_tree``; the repository id and the snapshot
    come from the first two folder levels, so thousands of snapshots are one
    ``binaryFile`` scan instead of a union of scans.  A file that is not below
    two such folders is an error.
    """
    files, relative = _files(spark, root, glob)
    rows = files.select(F.split(relative, "/", 3).alias("__p"), "content")
    part = lambda k: F.when(F.size("__p") == 3, F.get("__p", k)).otherwise(
        F.raise_error(F.concat(F.lit("not in a snapshot folder: "), F.array_join("__p", "/"))))
    return rows.select(part(0).cast("bigint").alias("repo_id"),
                       part(1).alias("snapshot_sha"),
                       part(2).alias("path"),
                       git_blob_sha("content").alias("blob_sha"),
                       _text().alias("source"))


def invalid_sources(tree: DataFrame) -> DataFrame:
    """Files whose content is not UTF-8."""
    return tree.where(F.col("source").isNull()).select("repo_id", "snapshot_sha", "path", "blob_sha")


def manifest_of(tree: DataFrame) -> DataFrame:
    """A2: the manifest part of a source tree (no contents)."""
    return tree.select("repo_id", "snapshot_sha", "path", "blob_sha")
