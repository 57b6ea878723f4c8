"""Results per key when a handful of keys hold most rows.

Each input split is dictionary-encoded and counted into a dense accumulator array (numpy bincount), so a task's work follows
the rows of its split and never a key. What leaves a split is one entry for each key it saw (and one more each time that HELD keys are
exceeded); these blocks are summed by Spark's aggregation, which spills where the keys don't fit in memory. A key that holds a third
of all rows arrives as a few entries per split.

Defined results: null is a key of its own (in counts) and never counts as a distinct value; an empty table gives no rows; repeated
rows count each time; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a task holds at once before it hands on what it has (its memory, whatever the number of keys).
HELD = 200_000


def _accumulate(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """(key, n) -> (key, n): sums by key over a split, in a dense array of at most about `held` keys.

    A batch is dictionary-encoded by itself; its codes are numpy's bins, and its keys are looked up among those held.
    """
    place: dict = {}
    acc = np.zeros(1024, np.int64)

    def out(kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(place), kind), pa.array(acc[: len(place)])], ["key", "n"])

    kind = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column(0).type
        coded = pc.dictionary_encode(batch.column(0), null_encoding="encode")
        n = batch.column(1).to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ones = np.bincount(codes, minlength=len(coded.dictionary))
        sums = ones if (n == 1).all() else np.add.reduceat(n[np.argsort(codes, kind="stable")], np.concatenate([[0], np.cumsum(ones)[:-1]]))
        at = np.array([place.setdefault(k, len(place)) for k in coded.dictionary.to_pylist()])
        if len(place) > len(acc):
            acc = np.concatenate([acc, np.zeros(max(len(acc), len(place) - len(acc)), np.int64)])
        acc[at] += sums
        if len(place) > held:
            yield out(kind)
            place, acc = {}, np.zeros(1024, np.int64)
    if place:
        yield out(kind)


def dense_counts(df: DataFrame, key: str, n: str = "rows") -> DataFrame:
    """(key, n): the number of rows of each value of key, null included."""
    kind = df.schema[key].dataType.simpleString()
    pairs = df.select(F.col(key).alias("key"), F.lit(1).cast("long").alias("n"))
    splits = pairs.mapInArrow(_accumulate, f"key {kind}, n bigint")
    return splits.groupBy("key").agg(F.sum("n").alias(n)).withColumnRenamed("key", key)


def dense_distinct(df: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """(key, n): the number of distinct values other than null for each key.

    The distinct pairs are hashed by key and value together, so a hot key spreads over all tasks; they are then counted in splits.
    """
    pairs = df.select(F.col(key).alias("__key"), F.col(value).alias("__value")).where(F.col("__value").isNotNull()).distinct()
    return dense_counts(pairs.withColumnRenamed("__key", key), key, n)


def counts_by_key(df: DataFrame, key: str, distinct: dict[str, str]) -> DataFrame:
    """(key, rows, *distinct): row counts of each key and, for each name in distinct, the number of distinct values of its column."""
    out = dense_counts(df, key).withColumnRenamed(key, "__k")
    for name, value in distinct.items():
        other = dense_distinct(df, key, value, name).withColumnRenamed(key, "__o")
        out = out.join(other, F.col("__k").eqNullSafe(F.col("__o")), "left").drop("__o")
    return out.select(F.col("__k").alias(key), "rows", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in distinct])


def heavy_hitters(df: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """(key_field, key_value): the values other than null that hold at least `share` of all rows."""
    counted = None
    for key in keys:
        one = dense_counts(df, key).select(F.lit(key).alias("key_field"), F.col(key).cast("string").alias("key_value"), "rows")
        counted = one if counted is None else counted.unionByName(one)
    total = counted.where(F.col("key_field") == keys[0]).agg(F.sum("rows").alias("total"))  # one row
    return counted.where(F.col("key_value").isNotNull()).join(F.broadcast(total), F.col("rows") >= F.col("total") * F.lit(share)).select("key_field", "key_value")
