"""Row changes and their envelopes.

A change has a key, a row image before and after, an operation (``c`` create,
``u`` update, ``d`` delete, ``r`` read by a snapshot) and where it comes from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import previous

CREATE, UPDATE, DELETE, READ, TOMBSTONE, TRUNCATE = "c", "u", "d", "r", "t", "x"


def from_events(events: DataFrame) -> DataFrame:
    """The change log of one table ``user_state``, derived from events: one row of state for each user.

    An ``error`` event deletes the row (and does nothing where there is none); any
    other one creates or updates it. Each row's predecessor gives all images; a hot user's rows are chained chunk by chunk.
    """
    rows = events.select("event_id", "user_id", "event_type", "value", "ts")
    rows = previous(rows, ["user_id"], "event_id", F.struct("event_type", "value"), "before")
    existed = F.coalesce(F.col("before.event_type") != "error", F.lit(False))
    gone = F.col("event_type") == "error"
    op = F.when(gone & existed, DELETE).when(gone, None).when(existed, UPDATE).otherwise(CREATE)
    out = rows.select("event_id", "user_id", "event_type", "value", "ts", op.alias("op"), F.col("before.value").alias("previous"))
    return out.select(
        F.col("event_id").alias("position"),
        F.expr("event_id div 10").alias("xid"),
        "user_id",
        "event_type",
        "ts",
        "op",
        F.when(F.col("op").isin(UPDATE, DELETE), F.col("previous")).alias("before_value"),
        F.when(F.col("op").isin(CREATE, UPDATE), F.col("value")).alias("after_value"),
    )


def envelope(changes: DataFrame, key: Sequence[str], before: Column, after: Column, source: Column, ts_ms: Column, op: str = "op") -> DataFrame:
    """(key, value): the key's columns as a struct, and {before, after, source, op, ts_ms}. Rows without an operation go."""
    value = F.struct(before.alias("before"), after.alias("after"), source.alias("source"), F.col(op).alias("op"), ts_ms.alias("ts_ms"))
    return changes.where(F.col(op).isNotNull()).select(F.struct(*key).alias("key"), value.alias("value"))


def snapshot(table: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Envelopes of operation ``r`` for the rows that a table has now."""
    image = F.struct(*table.columns)
    none = F.lit(None).cast(table.select(image.alias("x")).schema["x"].dataType)
    source = F.struct(F.lit(name).alias("table"), F.lit(True).alias("snapshot"))
    return envelope(table.withColumn("_op", F.lit(READ)), key, none, image, source, F.lit(None).cast("long"), "_op")


def snapshot_then_changes(snapshot_rows: DataFrame, changes: DataFrame, position: str) -> DataFrame:
    """A snapshot's records before all changes: they have position -1. Works for a stream of changes too."""
    return snapshot_rows.withColumn(position, F.lit(-1).cast(changes.schema[position].dataType)).unionByName(changes)


def name_columns(row: Column, columns: Sequence[str], types: Sequence[str] = ()) -> Column:
    """A row image of values by position as a struct; a shorter image leaves the rest null."""
    return F.struct(*(F.get(row, F.lit(i)).try_cast(types[i]).alias(c) if types else F.get(row, F.lit(i)).alias(c) for i, c in enumerate(columns)))


def expand_key_changes(changes: DataFrame, old_key: str, new_key: str, before: str, after: str, tombstones: bool = True) -> DataFrame:
    """(ordinal, key, op, before, after): a change of key becomes a delete, a tombstone and a create; other changes stay.

    A null old key is a create. Without tombstones the middle record goes, and the one after a delete.
    """
    kind = changes.schema[before].dataType
    none = F.lit(None).cast(kind)

    def one(key: Column, op: str, b: Column, a: Column) -> Column:
        return F.struct(key.alias("key"), F.lit(op).alias("op"), b.alias("before"), a.alias("after"))

    old, new, b, a = F.col(old_key), F.col(new_key), F.col(before), F.col(after)
    mark = [one(old, TOMBSTONE, none, none)] if tombstones else []
    records = (
        F.when(old.isNull(), F.array(one(new, CREATE, none, a)))
        .when(new.isNull(), F.array(one(old, DELETE, b, none), *mark))
        .when(old == new, F.array(one(new, UPDATE, b, a)))
        .otherwise(F.array(one(old, DELETE, b, none), *mark, one(new, CREATE, none, a)))
    )
    kept = [c for c in changes.columns if c not in (old_key, new_key, before, after)]
    return changes.select(*kept, F.posexplode(records).alias("ordinal", "r")).select(*kept, "ordinal", "r.*")


def tombstones(changes: DataFrame, key: Sequence[str], op: str = "op") -> DataFrame:
    """A record with a null value after each delete."""
    return changes.where(F.col(op) == DELETE).select(*key, F.lit(None).cast("string").alias("value"))
