"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ARROW_ROWS_KEY, TEXT_ROWS, bound_batches, broadcast_limit, ensure_checkpoint_dir, materialize, ship_package  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def in_sample(name: str, key: str | Column, share: float | Column) -> Column:
    """True for about this share of the keys, chosen by a 53-bit hash: the share may be as small as the table is large."""
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") / float(1 << 53)
    return unit < share


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that turns one batch into a dict of columns.

    The output schema is the DDL string; columns are cast to it by name.
    """
    bound_batches(df.sparkSession)
    return df.mapInArrow(_BatchFn(fn, schema), schema)


class _BatchFn:
    def __init__(self, fn, schema: str):
        self.fn, self.schema = fn, arrow_schema(schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield to_batch(self.fn(batch), self.schema)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        col = columns[f.name]
        arrays.append(col.cast(f.type) if isinstance(col, pa.Array) else pa.array(col, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string (the few types the operators emit)."""
    types = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(),
             "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
             "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
             "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    fields = []
    for part in ddl.split(","):
        name, kind = part.strip().split()
        fields.append(pa.field(name, types[kind]))
    return pa.schema(fields)
