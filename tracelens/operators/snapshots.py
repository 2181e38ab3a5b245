"""Snapshots of a repository and their differences.

A snapshot is a manifest ``(repo_id, snapshot_sha, path, blob_sha)``.  Files
are addressed by content (``blob_sha``), so work done for a blob is reused by
every snapshot holding it; the reference's path-keyed caches and commit diffs
become joins on ``blob_sha`` (SURVEY 7.2).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _cols(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def git_blob_sha(content: Column | str) -> Column:
    """Git object id of a file: ``sha1("blob <n>\\0" + bytes)``; text is UTF-8 encoded.

    Equals ``git hash-object`` for the same bytes.
    """
    c = F.col(content) if isinstance(content, str) else content
    return F.sha1(F.concat(
        F.encode(F.concat(F.lit("blob "), F.octet_length(c).cast("string")), "UTF-8"),
        F.unhex(F.lit("00")),
        c.cast("binary"),
    ))


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str] | str = "path",
                  blob: str = "blob_sha") -> DataFrame:
    """Paths that differ between two manifests, with a status.

    ``added`` (only in ``new``), ``removed`` (only in ``old``) or ``modified``
    (content differs).  One full outer join on the path key.
    """
    k = _cols(key)
    a = old.select(*k, F.col(blob).alias("old_blob"))
    b = new.select(*k, F.col(blob).alias("new_blob"))
    j = a.join(b, k, "full_outer")
    status = (F.when(F.col("old_blob").isNull(), "added")
               .when(F.col("new_blob").isNull(), "removed")
               .otherwise("modified"))
    return (j.where(~F.col("old_blob").eqNullSafe(F.col("new_blob")))
             .withColumn("status", status))


def units_to_recompute(units: DataFrame, diff: DataFrame, key: Sequence[str] | str = "path") -> DataFrame:
    """Units whose path is in the difference (``left_semi``)."""
    k = _cols(key)
    return units.join(diff.select(*k), k, "left_semi")


def first_in_order(df: DataFrame, group: Sequence[str] | str, order: Sequence[str] | str,
                   value: str, out: str) -> DataFrame:
    """E3 (literal mode): value of the first row of each group, on every row.

    An aggregation with map-side combine, joined back; no window holds a group.
    """
    g, o = _cols(group), _cols(order)
    firsts = df.groupBy(*g).agg(F.min_by(value, F.struct(*o)).alias(out))
    return df.join(firsts, g, "left")


def previous_in_order(df: DataFrame, group: Sequence[str] | str, order: Sequence[str] | str,
                      value: str, out: str) -> DataFrame:
    """E3 (lag mode): value of the previous row of the same group, NULL for the first.

    Skew-proof: rows are range-partitioned on ``(group, order)`` so one large
    group spans many tasks; ``lag`` runs inside each (group, partition) segment
    and each segment's first row takes the last value of the segment before it
    (a window over one summary row per segment).  The ranged rows are
    written once (shared checkpoint folder) so both uses see the same segments.  ``order`` must be unique
    within a group.
    """
    g, o = _cols(group), _cols(order)
    ranged = materialize(df.repartitionByRange(*[F.col(c) for c in g + o])
                           .withColumn("__seg", F.spark_partition_id()), "segments")
    w = Window.partitionBy(*g, "__seg").orderBy(*o)
    inner = (ranged.withColumn(out, F.lag(value).over(w))
                   .withColumn("__first", F.row_number().over(w) == 1))
    seg_last = (ranged.groupBy(*g, "__seg")
                      .agg(F.max_by(value, F.struct(*o)).alias("__last")))
    seg_prev = seg_last.select(
        *g, "__seg", F.lag("__last").over(Window.partitionBy(*g).orderBy("__seg")).alias("__prev"))
    return (inner.join(seg_prev, g + ["__seg"], "left")
                 .withColumn(out, F.when(F.col("__first"), F.col("__prev")).otherwise(F.col(out)))
                 .drop("__seg", "__first", "__prev"))


def manifest_units(manifest: DataFrame, scope: Sequence[str] = ("repo_id", "snapshot_sha"),
                   blob: str = "blob_sha") -> DataFrame:
    """K4: distinct (scope, blob) pairs of the snapshots to score."""
    return manifest.select(*scope, blob).distinct()
