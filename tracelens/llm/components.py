"""Connected components of an edge table by alternating star contractions.

Each round links neighbours to the smallest vertex they know of (first those
above a vertex, then those below), with grouped minima and joins only, so a
vertex with very many edges is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def _with_least(sym: DataFrame) -> DataFrame:
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, root``: the smallest vertex reachable, for every vertex that is not a root itself.

    Null ends and loops are ignored.  Each round is written to the checkpoint
    folder, so a lost executor costs one round at most.
    """
    e = (edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
         .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = materialize(e, "components")
    before = None
    for _ in range(MAX_ROUNDS):
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(sym).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where(F.col("u") != F.col("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v")))).where(F.col("u") != F.col("v")).distinct()
        e = materialize(small, "components")
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
