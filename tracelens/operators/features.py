"""Feature store keyed by content.

The reference caches one vector (or one descriptive text) per path or per
(path, function name) in an embedded database, reading and writing one row
at a time.  Here the store is a Parquet table keyed by ``blob_sha`` (plus the
unit inside the blob), and every operation is a bulk join:

* lookup (A14): ``units LEFT JOIN store``;
* misses (K1, C7): ``units LEFT ANTI JOIN store`` on the key, distinct blobs;
* upsert (A15): ``store LEFT ANTI new`` union ``new``, written as a new table;
* reset (A16): drop the table.

Model work (J1 describe, J2 embed) is a pluggable pandas batch function
``pd.Series[str] -> pd.Series[list[float]]`` run through a Pandas UDF on the
misses only.  No weights ship with the library; ``hashing_encoder`` is a
deterministic stand-in for tests.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path, path_exists

Encoder = Callable[[pd.Series], pd.Series]
# Source text -> description text, one pandas batch at a time.
Describer = Callable[[pd.Series], pd.Series]


def _cols(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def lookup(units: DataFrame, store: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Units with their stored features; NULL where none is stored."""
    return units.join(store, _cols(key), "left")


def misses(units: DataFrame, store: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """K1: distinct keys of ``units`` that the store lacks (compute these only)."""
    k = _cols(key)
    return units.select(*k).distinct().join(store.select(*k), k, "left_anti")


def upsert(store: DataFrame, new: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Rows of ``new`` replace stored rows with the same key; others are kept."""
    k = _cols(key)
    return store.join(new.select(*k), k, "left_anti").unionByName(new)


def write_store(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Persist a store version (atomic per write; readers use the finished path)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The store, or an empty frame of ``schema`` when none was written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def drop_store(spark: SparkSession, path: str) -> None:
    """Remove a store, wherever its storage is."""
    delete_path(spark, path)


def encode(texts: Column | str, encoder: Encoder) -> Column:
    """Apply a pandas batch encoder to a text column (Arrow batches)."""
    udf = F.pandas_udf(encoder, T.ArrayType(T.FloatType()))
    return udf(F.col(texts) if isinstance(texts, str) else texts)


def describe(sources: Column | str, describer: Describer) -> Column:
    """Apply a pandas batch describer (e.g. a code summarisation model) to source text."""
    udf = F.pandas_udf(describer, T.StringType())
    return udf(F.col(sources) if isinstance(sources, str) else sources)


def hashing_encoder(dim: int = 64) -> Encoder:
    """Deterministic bag-of-words hashing encoder (stand-in for a sentence model)."""
    import zlib

    import regex

    pat = regex.compile(r"[\p{L}\p{N}_]{2,}")  # same word rule as the tokeniser

    def enc(s: pd.Series) -> pd.Series:
        out = []
        for text in s:
            v = np.zeros(dim, dtype=np.float32)
            for tok in pat.findall((text or "").lower()):
                h = zlib.crc32(tok.encode("utf-8"))
                v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            out.append(v)
        return pd.Series(out)

    return enc
