"""Admission, retries, failures and counters of a running stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def clamp(reached: int, available: int, most: int) -> int:
    """How far the next batch goes: what there is, at most so much beyond what was reached."""
    return min(available, reached + most)


def delays(first_ms: int = 2000, factor: float = 1.0, most_ms: int = 10_000, tries: int = 3) -> Iterator[int]:
    """Waits between tries, growing by a factor up to a bound."""
    wait = float(first_ms)
    for _ in range(tries):
        yield int(min(wait, most_ms))
        wait *= factor


def retried(action: Callable[[], object], waits: Iterator[int], sleep: Callable[[float], None], transient: tuple[type[Exception], ...] = (OSError,)) -> object:
    """The result of an action, tried again after each wait; the last error is raised."""
    while True:
        try:
            return action()
        except transient:
            wait = next(waits, None)
            if wait is None:
                raise
            sleep(wait / 1000)


def on_failure(rows: DataFrame, made: Column, name: str, failed: Column, mode: str, message: str = "a value cannot be converted") -> DataFrame:
    """A converted column under a failure mode: fail raises, warn keeps null and says so in _error, skip drops the row, ignore keeps null."""
    if mode == "fail":
        return rows.withColumn(name, F.when(failed, F.raise_error(F.lit(message))).otherwise(made))
    if mode == "skip":
        return rows.where(~F.coalesce(failed, F.lit(False))).withColumn(name, made)
    out = rows.withColumn(name, F.when(~F.coalesce(failed, F.lit(False)), made))
    return out.withColumn("_error", F.when(failed, F.lit(message))) if mode == "warn" else out


def jdbc_sink(url: str, table: str, **properties: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that appends to a table over JDBC, one commit for each partition.

    Rows carry their batch's number; a batch that runs again first removes what its earlier run wrote.
    """

    def write(batch: DataFrame, n: int) -> None:
        manager = batch.sparkSession.sparkContext._jvm.java.sql.DriverManager
        settings = batch.sparkSession.sparkContext._jvm.java.util.Properties()
        for name, value in properties.items():
            settings.setProperty(name, value)
        connection = manager.getConnection(url, settings)
        try:
            if connection.getMetaData().getTables(None, None, table, None).next():
                connection.createStatement().executeUpdate(f"DELETE FROM {table} WHERE batch = {int(n)}")
        finally:
            connection.close()
        batch.withColumn("batch", F.lit(n)).write.jdbc(url, table, mode="append", properties=properties)

    return write


def counted(changes: DataFrame, name: str = "changes", op: str = "op", position: str = "position") -> tuple[DataFrame, Observation]:
    """Changes with counters that an action fills: rows, rows of each operation, last position."""
    seen = Observation(name)
    by_op = [F.count(F.when(F.col(op) == o, 1)).alias(f"op_{o}") for o in "rcud"]
    return changes.observe(seen, F.count(F.lit(1)).alias("rows"), *by_op, F.max(position).alias("last_position")), seen
