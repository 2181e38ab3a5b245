"""Equi-joins that stay balanced when one key holds a large share of the rows.

The case here is content addressing: one blob (a licence file, an empty
``__init__.py``) can be part of a large share of all snapshots, so a join of
the (snapshot, blob) units with per-blob data on ``blob`` would send every
copy to one task.  ``salted_join`` finds such keys exactly and spreads their
rows over several salts; the small side is replicated only for those keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_limit, materialize

ROWS_PER_TASK_KEY = "tracelens.rowsPerKeyTask"
DEFAULT_ROWS_PER_TASK = 200_000


def _cols(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def rows_per_task(df: DataFrame) -> int:
    value = df.sparkSession.conf.get(ROWS_PER_TASK_KEY, None)
    return int(value) if value else DEFAULT_ROWS_PER_TASK


def hot_keys(many: DataFrame, key: Sequence[str] | str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows in ``many`` and their salt count.

    Exact (a grouped count with map-side combine).  The result has at most
    ``rows(many) / limit`` rows and is written once, so its size is known.
    """
    k = _cols(key)
    counts = many.groupBy(*k).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.where(F.col("__n") > limit).select(
        *k, F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__salts"))
    return materialize(hot, "hot-keys")


def salted_join(many: DataFrame, few: DataFrame, key: Sequence[str] | str,
                limit: int | None = None) -> DataFrame:
    """Inner join ``many`` and ``few`` on ``key``; hot keys are spread over salts.

    Each row of ``many`` with a hot key takes one salt from a hash of its
    other columns (deterministic, so retries see the same assignment); the
    ``few`` rows of that key are replicated once per salt.  Other keys use
    salt 0 and are not replicated.  The result equals ``many.join(few, key)``.
    """
    k = _cols(key)
    limit = rows_per_task(many) if limit is None else limit
    hot = hot_keys(many, k, limit)
    n_hot = hot.count()
    if n_hot == 0:
        return many.join(few, k)
    if n_hot * (24 * len(k) + 32) <= broadcast_limit(many.sparkSession):
        hot = F.broadcast(hot)
    others = [c for c in many.columns if c not in k]
    # Rows of a key differ in their other columns; with none, the row id
    # spreads them (each row still meets exactly one replica, so the join
    # result does not depend on which salt a row takes).
    spread = (F.xxhash64(*[F.col(c) for c in others]) if others
              else F.xxhash64(F.monotonically_increasing_id()))
    m = (many.join(hot, k, "left")
             .withColumn("__salt", F.when(F.col("__salts").isNull(), F.lit(0))
                                    .otherwise(F.pmod(spread, F.col("__salts"))))
             .drop("__salts"))
    f = (few.join(hot, k, "left")
            .withColumn("__salt", F.explode(F.sequence(
                F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
            .drop("__salts"))
    return m.join(f, k + ["__salt"]).drop("__salt")
