"""The current state of a table from its change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changelog import DELETE


def latest_state(changes: DataFrame, key: Sequence[str], position: str, op: str = "op", after: Sequence[str] = ("after_value",)) -> DataFrame:
    """The last image of each live key, deleted keys left out.

    max_by sums up each key on the map side, so one hot key moves one row a task
    where a ranking window would move and sort all of its rows.
    """
    last = F.max_by(F.struct(op, *after), F.col(position)).alias("last")
    rows = changes.where(F.col(op).isNotNull()).groupBy(*key).agg(last, F.max(position).alias(position))
    return rows.where(F.col(f"last.{op}") != DELETE).select(*key, position, *(F.col(f"last.{c}").alias(c) for c in after))


def merge_changes(state: DataFrame, changes: DataFrame, key: Sequence[str], position: str, op: str = "op", after: Sequence[str] = ("after_value",)) -> DataFrame:
    """The state with further changes merged in, by position, so that merging twice changes nothing."""
    seen = state.select(*key, position, F.lit("u").alias(op), *after)
    return latest_state(seen.unionByName(changes.select(*key, position, op, *after)), key, position, op, after)
