"""Positions in a log, and where to begin again after a stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gtid
from .chunks import running_sum


def ordering(file: Column, pos: Column, event: Column, row: Column) -> Column:
    """A struct that orders positions; names of files in either case."""
    return F.struct(F.lower(file).alias("file"), pos.cast("long").alias("pos"), event.cast("long").alias("event"), row.cast("long").alias("row"))


def at_or_before(recorded: Column, desired: Column, recorded_gtids: Column | None = None, desired_gtids: Column | None = None) -> Column:
    """If a recorded position is at or before a desired one; sets of transaction ids decide where both have them.

    With ids on the desired side alone the answer is yes, on the recorded side alone no.
    """
    plain = recorded <= desired
    if recorded_gtids is None or desired_gtids is None:
        return plain
    inside = gtid.contained_within(gtid.parse(recorded_gtids), gtid.parse(desired_gtids))
    return (
        F.when(recorded_gtids.isNotNull() & desired_gtids.isNotNull(), inside)
        .when(desired_gtids.isNotNull(), F.lit(True))
        .when(recorded_gtids.isNotNull(), F.lit(False))
        .otherwise(plain)
    )


def restart_offsets(log: DataFrame, stream: Sequence[str], order: str, kind: str, pos: str, length: str) -> DataFrame:
    """Rows with ``restart``: the position from which a reader that stopped after the row begins again.

    Within a transaction (after BEGIN, before XID) that is its BEGIN; else the end of the row's event.
    """
    line = Window.partitionBy(*stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    begin = F.last(F.when(F.col(kind) == "BEGIN", F.col(pos)), ignorenulls=True).over(line)
    depth = F.sum(F.when(F.col(kind) == "BEGIN", 1).when(F.col(kind) == "XID", -1).otherwise(0)).over(line)
    return log.withColumn("restart", F.when(depth > 0, begin).otherwise(F.col(pos) + F.col(length)))


def rotation_epochs(log: DataFrame, stream: Sequence[str], order: str, kind: str) -> DataFrame:
    """Rows with ``epoch``: how many ROTATE events there were up to each; table numbers hold within an epoch. order is a number."""
    return running_sum(log, stream, order, (F.col(kind) == "ROTATE").cast("long"), "epoch")


def row_offsets(rows: DataFrame, event: Sequence[str], order: str) -> DataFrame:
    """Rows with ``next_row``: the row of the event to go on with; after the last it is the number of rows."""
    line = Window.partitionBy(*event)
    n = F.row_number().over(line.orderBy(order))
    return rows.withColumn("next_row", F.least(n, F.count(F.lit(1)).over(line)))


def skip_done(rows: DataFrame, event: Sequence[str], order: str, first_event: Column, done_rows: int) -> DataFrame:
    """Rows less the first done_rows of the event in which a reader had stopped."""
    n = F.row_number().over(Window.partitionBy(*event).orderBy(order))
    return rows.withColumn("_n", n).where(~first_event | (F.col("_n") > done_rows)).drop("_n")


def take_while(rows: DataFrame, order: str, holds: Column) -> DataFrame:
    """Rows before the first, in order, for which a predicate does not hold."""
    stop = rows.where(~holds).agg(F.min(order).alias("_stop"))
    return rows.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")  # one row


def window_batches(rows: DataFrame, scn: str, start: int, size: int = 10_000) -> DataFrame:
    """Rows with the number of their half-open window of change numbers."""
    return rows.withColumn("batch", F.floor((F.col(scn) - F.lit(start)) / F.lit(size)).cast("long"))


def position_at(log: DataFrame, ts: str, position: str, when: Column) -> DataFrame:
    """One row with the first position at or after a time; null if there is none."""
    return log.where(F.col(ts) >= when).agg(F.min(position).alias("position"))


def log_files(redo: DataFrame, archived: DataFrame, start: int, end: int) -> DataFrame:
    """One file for each first change: files of both lists, (name, first_change, next_change), that overlap a half-open window."""
    both = redo.select("name", "first_change", "next_change").union(archived.select("name", "first_change", "next_change")).distinct()
    overlapping = both.where((F.col("first_change") < end) & (F.col("next_change") > start))
    return overlapping.groupBy("first_change").agg(F.min("name").alias("name"), F.min("next_change").alias("next_change"))


def tracked_ids(log: DataFrame, stream: Sequence[str], order: str, n: str) -> DataFrame:
    """Rows with ``seen`` and ``restart_seen``: the highest transaction number with this row, and before its transaction."""
    line = Window.partitionBy(*stream).orderBy(order)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    seen = log.withColumn("seen", F.max(n).over(upto)).withColumn("_b", F.lag("seen").over(line))
    return seen.withColumn("restart_seen", F.max(F.when(F.col("seen") > F.col("_b"), F.col("_b"))).over(upto)).drop("_b")


def context(file: Column, pos: Column) -> Column:
    """A transaction's name: where it begins."""
    return F.concat(F.lit("file="), file, F.lit(",pos="), pos.cast("string"))


def as_of(events: DataFrame, versions: DataFrame, key: Sequence[str], position: str, value: str) -> DataFrame:
    """Events with the last version at or before their position: one sort of both sides by key, no range join."""
    kept = [c for c in events.columns if c not in (*key, position)]
    left = events.select(*key, position, F.struct(*kept).alias("_e") if kept else F.lit(0).alias("_e"), F.lit(1).alias("_side"))
    kind = left.schema["_e"].dataType
    right = versions.select(*key, position, F.lit(None).cast(kind).alias("_e"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = left.withColumn("_v", F.lit(None).cast(versions.schema[value].dataType)).unionByName(right)
    line = Window.partitionBy(*key).orderBy(position, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(value, F.last("_v", ignorenulls=True).over(line)).where("_side = 1")
    return out.select(*key, position, *(["_e.*"] if kept else []), value)
