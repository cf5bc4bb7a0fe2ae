"""Data manipulation over tables as DataFrames, and comparisons with all or any of a subquery's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(state: DataFrame, rows: DataFrame, key: Sequence[str], on_duplicate: str | dict[str, Column] = "error") -> DataFrame:
    """The table with rows put in, both with one row a key; their keys have no nulls.

    Of a key that is there already: ``error`` raises, ``ignore`` keeps the old row,
    ``replace`` takes the new one; a dictionary updates columns by expressions over
    the old row's columns and the new row's, named ``new_`` and the column.
    """
    if on_duplicate == "ignore":
        return state.unionByName(rows.join(state.select(*key), list(key), "left_anti").select(*state.columns))
    if on_duplicate == "replace":
        return state.join(rows.select(*key), list(key), "left_anti").select(*state.columns).unionByName(rows.select(*state.columns))
    others = [c for c in state.columns if c not in key]
    new = rows.select(*key, *(F.col(c).alias(f"new_{c}") for c in others), F.lit(True).alias("_new"))
    both = state.withColumn("_old", F.lit(True)).join(new, list(key), "full")
    again = F.col("_old") & F.col("_new")
    if on_duplicate == "error":
        made = {c: F.when(again, F.raise_error(F.lit("duplicate key"))).when(F.col("_new"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in others}
    else:
        made = {c: F.when(again, on_duplicate.get(c, F.col(c))).when(F.col("_new"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in others}
    return both.select(*(made[c].cast(state.schema[c].dataType).alias(c) if c in made else F.col(c) for c in state.columns))


def update(state: DataFrame, where: Column, sets: dict[str, Column]) -> DataFrame:
    """The table with columns set where a condition is true; expressions see the old row."""
    hit = F.coalesce(where, F.lit(False))
    return state.select(*(F.when(hit, sets[c]).otherwise(F.col(c)).cast(state.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in state.columns))


def delete(state: DataFrame, where: Column) -> DataFrame:
    """The table less the rows for which a condition is true."""
    return state.where(~F.coalesce(where, F.lit(False)))


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """A join on all columns of the same name, each of which is there once."""
    return a.join(b, [c for c in a.columns if c in b.columns], how)


def quantified(rows: DataFrame, column: str, op: str, values: DataFrame, every: bool, name: str) -> DataFrame:
    """The rows with a three-valued column: column op ALL (every) or ANY of the values of a one-column table.

    Order comparisons need the values' ends alone; ``=`` and ``<>`` need the distinct
    values, joined by them.
    """
    (v,) = values.columns
    ends = values.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count(v).alias("_known"), F.count_distinct(v).alias("_kinds"))
    x = F.col(column)
    if op in ("=", "<>"):
        there = values.where(F.col(v).isNotNull()).select(F.col(v).alias("_v")).distinct().withColumn("_in", F.lit(True))
        rows = rows.join(there, x == F.col("_v"), "left").drop("_v")
        some = F.coalesce(F.col("_in"), F.lit(False))
        another = F.col("_kinds") > some.cast("int")
        # what is true of one known value, and of all known values
        one, all_ = (some, some & ~another) if op == "=" else (another, ~some)
    else:
        low, high = {"<": (x < F.col("_hi"), x < F.col("_lo")), "<=": (x <= F.col("_hi"), x <= F.col("_lo")), ">": (x > F.col("_lo"), x > F.col("_hi")), ">=": (x >= F.col("_lo"), x >= F.col("_hi"))}[op]
        one, all_ = low, high
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    nulls = F.col("_known") < F.col("_n")
    unknown = F.lit(None).cast("boolean")
    if every:
        made = F.when(F.col("_n") == 0, True).when(x.isNull(), unknown).when((F.col("_known") > 0) & ~all_, False).when(nulls, unknown).otherwise(True)
    else:
        made = F.when(F.col("_n") == 0, False).when(x.isNull(), unknown).when((F.col("_known") > 0) & one, True).when(nulls, unknown).otherwise(False)
    return rows.withColumn(name, made).drop("_lo", "_hi", "_n", "_known", "_kinds", "_in")
