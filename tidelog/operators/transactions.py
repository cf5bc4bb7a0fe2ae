"""Transactions: release on commit, discard on rollback, statements and large objects in pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import previous

COMMIT, ROLLBACK = 7, 36
# Operation codes of the redo log and their names.
OPERATIONS = {
    0: "INTERNAL", 1: "INSERT", 2: "DELETE", 3: "UPDATE", 5: "DDL", 6: "START", 7: "COMMIT", 9: "SELECT_LOB_LOCATOR",
    10: "LOB_WRITE", 11: "LOB_TRIM", 25: "SELECT_FOR_UPDATE", 28: "LOB_ERASE", 34: "MISSING_SCN", 36: "ROLLBACK",
    68: "XML_DOC_BEGIN", 70: "XML_DOC_WRITE", 71: "XML_DOC_END", 255: "UNSUPPORTED",
}


def operation_name(code: Column) -> Column:
    """The name of an operation code; unknown ones are UNSUPPORTED."""
    names = F.create_map(*(F.lit(x) for pair in OPERATIONS.items() for x in pair))
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(names, code), F.lit("UNSUPPORTED")))


def outcomes(log: DataFrame, xid: Sequence[str], code: str, scn: str) -> DataFrame:
    """(xid, commit_scn, rolled_back) of each transaction; a transaction of neither is open."""
    return log.groupBy(*xid).agg(
        F.max(F.when(F.col(code) == COMMIT, F.col(scn))).alias("commit_scn"),
        F.max(F.when(F.col(code) == ROLLBACK, F.lit(1)).otherwise(F.lit(0))).alias("rolled_back"),
    )


def committed(changes: DataFrame, done: DataFrame, xid: Sequence[str]) -> DataFrame:
    """Changes of transactions that committed and did not roll back, with their commit_scn.

    The outcome of a transaction is one row, so it is joined to its changes: a hot transaction splits like any skewed join.
    """
    ended = done.where(F.col("commit_scn").isNotNull() & (F.col("rolled_back") == 0)).select(*xid, "commit_scn")
    return changes.join(ended, list(xid))


def trim_overlap(changes: DataFrame, scn: str) -> DataFrame:
    """Changes up to the last commit that was seen; later ones are read again."""
    top = changes.agg(F.max("commit_scn").alias("_top"))
    return changes.join(F.broadcast(top), F.col(scn) <= F.col("_top")).drop("_top")  # one row


def stitch(rows: DataFrame, thread: Sequence[str], order: str, continues: str, text: str, sep: str = "") -> DataFrame:
    """(thread, start, pieces, text): statements whole again from rows that say if they continue in the next one."""
    line = Window.partitionBy(*thread).orderBy(order)
    starts = F.when(F.coalesce(F.lag(continues).over(line), F.lit(False)), F.lit(0)).otherwise(F.lit(1))
    numbered = rows.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    grouped = numbered.groupBy(*thread, "_g").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("pieces"), pieces.alias("p"))
    return grouped.select(*thread, "start", "pieces", F.array_join(F.col("p.t"), sep).alias("text"))


def assemble_lobs(chunks: DataFrame, key: Sequence[str], order: str, text: str, sep: str = "") -> DataFrame:
    """(key, chunks, text): the chunks of each large object in order; null chunks are left out."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    grouped = chunks.where(F.col(text).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("chunks"), pieces.alias("p"))
    return grouped.select(*key, "chunks", F.array_join(F.col("p.t"), sep).alias("text"))


def merge_lobs(changes: DataFrame, lobs: DataFrame, key: Sequence[str], column: str, text: str, after: str = "after") -> DataFrame:
    """Changes with their large objects put into the after image, a map of columns; lobs: one row for each key and column."""
    filled = lobs.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(column, text))).alias("_lobs"))
    names = F.map_keys(F.col("_lobs"))
    kept = F.map_filter(F.coalesce(F.col(after), F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(names, k))
    merged = F.when(F.col("_lobs").isNull(), F.col(after)).otherwise(F.map_concat(kept, F.col("_lobs")))
    return changes.join(filled, list(key), "left").withColumn(after, merged).drop("_lobs")


def cancel_savepoints(changes: DataFrame, key: Sequence[str], scn: str, op: str, undo: str) -> DataFrame:
    """Changes less those that a savepoint rollback undid: an undo row cancels the nearest change before it of its inverse operation.

    key: what an undo row shares with its change (transaction, table, row id).
    """
    inverse = F.create_map(F.lit("INSERT"), F.lit("DELETE"), F.lit("DELETE"), F.lit("INSERT"), F.lit("UPDATE"), F.lit("UPDATE"))
    line = Window.partitionBy(*key, "_kind").orderBy(F.desc(scn))
    kind = F.when(F.col(undo), F.try_element_at(inverse, F.col(op))).otherwise(F.col(op))
    marked = changes.withColumn("_kind", kind).withColumn("_step", F.when(F.col(undo), F.lit(1)).otherwise(F.lit(-1)))
    # going backwards, a change is undone while more undo rows than changes lie after it
    depth = F.sum("_step").over(line.rowsBetween(Window.unboundedPreceding, 0))
    floor = F.min("_d").over(line.rowsBetween(Window.unboundedPreceding, -1))
    walked = marked.withColumn("_d", depth).withColumn("_f", F.least(F.lit(0), F.coalesce(floor, F.lit(0))))
    return walked.where(~F.col(undo) & (F.col("_d") < F.col("_f"))).drop("_kind", "_step", "_d", "_f")


def run_groups(rows: DataFrame, order: str, value: str, partition: Sequence[str] = ()) -> DataFrame:
    """Rows with ``run``, the number of their run of equal values in order."""
    line = Window.partitionBy(*partition).orderBy(order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(line)) & F.lag(order).over(line).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def drop_repeats(rows: DataFrame, partition: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before; order is a number."""
    before = previous(rows, partition, order, F.struct(F.col(value).alias("v")), "_p")
    return before.where(F.col("_p").isNull() | ~F.col(value).eqNullSafe(F.col("_p.v"))).drop("_p")
