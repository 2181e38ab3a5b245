"""Differences of snapshots by hash trees.

A hash tree gives every directory a hash of what it holds, so two snapshots
are compared from their roots and only directories whose hashes differ are
opened.  Trees are rows ``(tree, name, is_dir, hash)``: ``tree`` is the hash
of the directory, ``hash`` that of the entry.  Repositories bring them along
(``sources.gitobjects.tree_entries``); ``hash_tree`` builds them bottom-up
from a manifest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LANES = 4
LANE_DIGITS = 15


def _cols(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _directory_hash() -> Column:
    """Hash of a directory from its entries, in any order.

    Sums of the four 60-bit lanes of each entry's digest: partial sums are
    combined before the shuffle, so a directory with very many entries is
    never gathered.
    """
    digest = F.sha2(F.concat_ws("\x00", F.col("is_dir").cast("string"), "name", "hash"), 256)
    lanes = [F.sum(F.conv(F.substr(digest, F.lit(1 + i * LANE_DIGITS), F.lit(LANE_DIGITS)), 16, 10).cast("decimal(19,0)"))
             for i in range(LANES)]
    return F.sha2(F.concat_ws(",", *[lane.cast("string") for lane in lanes]), 256)


def hash_tree(manifest: DataFrame, scope: Sequence[str] | str = (), path: str = "path",
              blob: str = "blob_sha") -> tuple[DataFrame, DataFrame]:
    """``(entries, roots)`` of the snapshots named by ``scope``.

    ``entries(tree, name, is_dir, hash)`` holds each distinct directory once,
    however many snapshots have it; ``roots(scope..., tree)`` one row per
    snapshot.  One grouped sum per directory level, deepest first.  Paths are
    unique in a snapshot and use ``/``; NULL paths are not files.
    """
    sc = _cols(scope)
    parts = F.split(path, "/")
    files = manifest.where(F.col(path).isNotNull()).select(
        *sc, F.slice(parts, 1, F.size(parts) - 1).alias("__dir"), F.element_at(parts, -1).alias("name"),
        F.lit(False).alias("is_dir"), F.col(blob).alias("hash"))
    files = materialize(files.withColumn("__depth", F.size("__dir")).withColumn("__dir", F.array_join("__dir", "/")), "tree-files")
    deepest = files.agg(F.max("__depth")).first()[0]
    if deepest is None:
        empty = files.where(F.lit(False))
        return (empty.select(F.lit("").alias("tree"), "name", "is_dir", "hash"), empty.select(*sc, F.col("hash").alias("tree")))
    levels, dirs = [], None
    for depth in range(deepest, -1, -1):
        here = files.where(F.col("__depth") == depth).drop("__depth")
        if dirs is not None:
            here = here.unionByName(dirs)
        hashed = here.groupBy(*sc, "__dir").agg(_directory_hash().alias("tree"))
        level = materialize(here.join(hashed, sc + ["__dir"]), "tree-level")
        levels += level.inputFiles()
        made = level.select(*sc, "__dir", "tree").distinct()
        if depth:
            dirs = made.select(*sc, F.regexp_extract("__dir", r"^(?s:(.*))/", 1).alias("__up"),
                               F.substring_index("__dir", "/", -1).alias("name"), F.lit(True).alias("is_dir"),
                               F.col("tree").alias("hash")).withColumnRenamed("__up", "__dir")
    entries = manifest.sparkSession.read.schema(level.schema).parquet(*levels).select("tree", "name", "is_dir", "hash").distinct()
    return entries, made.select(*sc, "tree")


def tree_diff(pairs: DataFrame, entries: DataFrame, key: Sequence[str] | str = (),
              scope: Sequence[str] | str = ()) -> tuple[DataFrame, DataFrame]:
    """``(differences, opened)`` of pairs of trees.

    ``pairs(key..., scope..., old_tree, new_tree)``, either tree NULL for none;
    ``entries(scope..., tree, name, is_dir, hash)``.  The differences
    ``(key..., scope..., path, old_blob, new_blob, status)`` are those of
    ``snapshots.snapshot_diff``; a name that turns from a file into a
    directory is a removed file and added ones.  ``opened(level, n_trees,
    n_entries)`` counts what was read.  One pair of joins per level; a pair of equal
    hashes is not opened.
    """
    k, sc = _cols(key), _cols(scope)
    ids = k + [c for c in sc if c not in k]
    spark = pairs.sparkSession
    entries = materialize(entries, "tree-entries")
    level = pairs.select(*ids, F.lit("").alias("dir"), "old_tree", "new_tree").where(
        ~F.col("old_tree").eqNullSafe(F.col("new_tree")))
    found, opened = [], []
    on = ids + ["dir", "name"]
    number = 0
    while True:
        level = materialize(level, "tree-open")
        if level.isEmpty():
            break

        def children(side: str) -> DataFrame:
            open_ = level.where(F.col(f"{side}_tree").isNotNull()).select(*ids, "dir", F.col(f"{side}_tree").alias("tree"))
            return open_.join(entries, sc + ["tree"]).select(
                *on, F.when(~F.col("is_dir"), F.col("hash")).alias(f"{side}_blob"), F.when(F.col("is_dir"), F.col("hash")).alias(f"{side}_tree"))

        both = children("old").join(children("new"), on, "full_outer")
        both = materialize(both.withColumn("path", F.concat("dir", "name")), "tree-children")
        n_trees = level.agg(F.sum(F.col("old_tree").isNotNull().cast("long") + F.col("new_tree").isNotNull().cast("long"))).first()[0]
        n_entries = both.agg(F.sum(sum((F.col(c).isNotNull().cast("long") for c in ("old_blob", "old_tree", "new_blob", "new_tree")),
                                       F.lit(0)))).first()[0]
        opened.append((number, int(n_trees or 0), int(n_entries or 0)))
        found += both.inputFiles()
        level = both.where(~F.col("old_tree").eqNullSafe(F.col("new_tree"))).select(
            *ids, F.concat("path", F.lit("/")).alias("dir"), "old_tree", "new_tree")
        number += 1
    counts = spark.createDataFrame(opened, "level int, n_trees long, n_entries long")
    rows = spark.read.schema(both.schema).parquet(*found) if found else _no_children(pairs, ids)
    status = (F.when(F.col("old_blob").isNull(), "added").when(F.col("new_blob").isNull(), "removed").otherwise("modified"))
    differing = rows.where(~F.col("old_blob").eqNullSafe(F.col("new_blob")))
    return differing.select(*ids, "path", "old_blob", "new_blob", status.alias("status")), counts


def _no_children(pairs: DataFrame, ids: list[str]) -> DataFrame:
    none = F.lit(None).cast("string")
    return pairs.where(F.lit(False)).select(*ids, none.alias("path"), none.alias("old_blob"), none.alias("new_blob"))
