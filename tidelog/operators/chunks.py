"""Ordered work within a key, cut into chunks of positions, so that a hot key is many tasks' work.

Each chunk is sorted by itself; what it hands on (its last row, or its sum) is one
small row, and only these are put in order over a whole key. Chunks are ranges of
positions, so their number for a key grows with its log, and their size does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a chunk.
CHUNK = 1 << 18


def _chunked(rows: DataFrame, position: str, chunk: int) -> DataFrame:
    return rows.withColumn("_chunk", F.floor(F.col(position) / chunk).cast("long"))


def previous(rows: DataFrame, key: Sequence[str], position: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """The rows with the value of the key's row before, null at its first; positions are numbers, one for each row of a key."""
    rows = _chunked(rows.withColumn("_value", F.struct(value.alias("v"))), position, chunk)
    inner = Window.partitionBy(*key, "_chunk").orderBy(position)
    over = Window.partitionBy(*key).orderBy("_chunk")
    last = rows.groupBy(*key, "_chunk").agg(F.max_by("_value", position).alias("_last"))
    carried = last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_chunk").alias("_c"), F.lag("_last").over(over).alias("_carried"))
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.withColumn("_own", F.lag("_value").over(inner)).join(carried, same)
    kept = [c for c in rows.columns if c not in ("_value", "_chunk")]
    return out.select(*kept, F.coalesce("_own", "_carried")["v"].alias(name))


def running_sum(rows: DataFrame, key: Sequence[str], position: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """The rows with the sum of a value over the key's rows up to theirs."""
    rows = _chunked(rows.withColumn("_value", value), position, chunk)
    inner = Window.partitionBy(*key, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(*key, "_chunk").agg(F.sum("_value").alias("_total"))
    carried = total.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_carried"))
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.withColumn("_own", F.sum("_value").over(inner)).join(carried, same)
    kept = [c for c in rows.columns if c not in ("_value", "_chunk")]
    return out.select(*kept, (F.coalesce("_own", F.lit(0)) + F.col("_carried")).alias(name))
