"""Many-to-many cosine by blocks.

Every query of a scope meets every unit of that scope.  Both sides are dealt
into blocks of bounded size within their scope, and each pair of blocks is
one matrix product that keeps the best k units per query.  The key of the
exchange is (scope, query block, unit block), so a scope that holds a third of
all rows is spread over as many tasks as it has pairs of blocks; a row is
copied once per block of the other side of its own scope.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast, materialize
from .similarity import rank_within

BLOCK_ROWS = 4096
# Scores are rounded after the product: what could round to the k-th best is kept.
SLACK = 1e-6


def _cols(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of length 1; one without length becomes NaN."""
    rows = vectors.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(rows), -1)
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths, out=np.full_like(matrix, np.nan), where=lengths > 0)


class _BestOfBlocks:
    def __init__(self, k: int, scope: list[str], query_key: list[str], unit_key: list[str], slack: float):
        self.k, self.scope, self.query_key, self.unit_key, self.slack = k, scope, query_key, unit_key, slack

    def __call__(self, queries: pa.Table, units: pa.Table) -> pa.Table:
        if not queries.num_rows or not units.num_rows:
            names = queries.select(self.scope + self.query_key).slice(0, 0)
            keys = units.select(self.unit_key).slice(0, 0)
            q = u = np.zeros(0, np.int64)
            found = np.zeros(0)
        else:
            names, keys = queries.select(self.scope + self.query_key), units.select(self.unit_key)
            scores = _unit_rows(queries.column("__v")) @ _unit_rows(units.column("__v")).T
            order = np.where(np.isnan(scores), -2.0, scores)  # no score: after all others
            k = min(self.k, units.num_rows)
            least = np.partition(order, units.num_rows - k, axis=1)[:, units.num_rows - k]
            q, u = np.nonzero(order >= least[:, None] - self.slack)
            found = scores[q, u]
        table = names.take(pa.array(q))
        for name in self.unit_key:
            table = table.append_column(name, keys.column(name).take(pa.array(u)))
        return table.append_column("score", pa.array(found, pa.float64(), mask=np.isnan(found)))


def block_top_k(queries: DataFrame, units: DataFrame, scope: Sequence[str] | str, query_key: Sequence[str] | str,
                unit_key: Sequence[str] | str, k: int, query_vec: str = "vector", unit_vec: str = "vector",
                block_rows: int = BLOCK_ROWS, digits: int | None = 6) -> DataFrame:
    """``(scope..., query_key..., unit_key..., score, rank)``: the k units of its scope closest to each query.

    The same rows as ``rank_within(cosine_scores(...))``: rows whose vector is
    NULL take no part, a vector without length has the score NULL and comes
    last, ties go to the smaller unit key.  Vectors of one scope have one
    length.  Key columns of the two sides have different names.
    """
    sc, qk, uk = _cols(scope), _cols(query_key), _cols(unit_key)
    if not sc or not uk or set(qk) & set(uk):
        raise ValueError("a scope and unit keys apart from the query keys are needed")
    q = queries.where(F.col(query_vec).isNotNull()).select(*sc, *qk, F.col(query_vec).alias("__v"))
    u = units.where(F.col(unit_vec).isNotNull()).select(*sc, *uk, F.col(unit_vec).alias("__v"))

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*sc).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(name))

    sizes = materialize(blocks(q, "__nq").join(blocks(u, "__nu"), sc), "block-sizes")
    if fits_broadcast(sizes):
        sizes = F.broadcast(sizes)

    def dealt(side: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
        placed = side.join(sizes, sc).withColumn(f"__{own}", F.pmod(F.xxhash64(*(keys or ["__v"])), F.col(f"__n{own}")))
        placed = placed.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.col(f"__n{other}") - 1)))
        # Columns of their own for each side: both may come from one table.
        return placed.select(*[F.col(c).alias(c) for c in sc + keys], "__v", F.col("__q").cast("int").alias("__q"), F.col("__u").cast("int").alias("__u"))

    by = sc + ["__q", "__u"]
    left, right = dealt(q, qk, "q", "u"), dealt(u, uk, "u", "q")
    types = dict(left.dtypes) | dict(right.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in sc + qk + uk) + ", score double"
    product = _BestOfBlocks(k, sc, qk, uk, 0.0 if digits is None else SLACK)
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: product(a, b), schema)
    if digits is not None:
        best = best.withColumn("score", F.round("score", digits))
    return rank_within(best, sc + qk, uk, k)
