"""Small helpers that the operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, stored  # noqa: F401

#: Rows that an operator works on at a time. Spark itself bounds the bytes of a batch (64 MB by default).
BATCH_ROWS = 256
#: Bits of a filter of keys at most (16 MB), and bits for each key below that.
FILTER_BITS, BITS_PER_KEY = 1 << 27, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder of the shared store, and the path in it."""
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and "://" not in uri else uri)


def discard(folder: str, *names: str) -> None:
    """Remove tables of the shared folder that nothing reads any more."""
    store, base = filesystem(folder)
    for name in names:
        store.delete_dir(f"{base}/{name}")


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over slices of at most BATCH_ROWS rows, as texts may be long; no setting of the session changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(batch.slice(lo, BATCH_ROWS) for batch in batches for lo in range(0, batch.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def key_filter(keys: DataFrame, most_bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A condition that holds for every value of the one long column of ``keys``, and for few others.

    It is a table of bits, sent to all tasks and of at most ``most_bits`` whatever the number of
    keys: with more of them it lets more other values through, up to all. So it only narrows what a
    join sees, and the join must follow.
    """
    spark, name = keys.sparkSession, keys.columns[0]
    bits = min(most_bits, max(1 << 10, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    places = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(name), F.lit(k)), F.lit(bits)) for k in range(2)])).alias("at")
    words = keys.select(places).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most most_bits / 64 short rows
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    sent = spark.sparkContext.broadcast(table.view(np.uint64))

    @F.pandas_udf("boolean")
    def held(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for at in (a.to_numpy(np.int64), b.to_numpy(np.int64)):
            out &= sent.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0
        return pd.Series(out)

    return lambda key: held(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(2)])


def spread(df: DataFrame, *by: str, most: int = 20_000) -> DataFrame:
    """A short table of work items (files, blocks), dealt to about as many tasks: Spark would join short rows in one."""
    return df.repartition(max(1, min(df.count(), most)), *by)


def fresh(name: str) -> str:
    """A column name that no table of the user's has."""
    return f"{name}_{uuid.uuid4().hex}"


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
