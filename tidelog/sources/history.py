"""Schema history as JSON lines, schema-change messages, heartbeats and source structs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "server string, position long, db string, sql string"


def append_history(history: DataFrame, path: str) -> None:
    """Adds statements to a history; columns as in HISTORY."""
    history.select("server", "position", "db", "sql").write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, server: str | None = None, upto: int | None = None) -> DataFrame:
    """A history of one server, or of all, up to and with a position; lines that cannot be read are left out."""
    rows = spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path).where("position is not null and sql is not null")
    rows = rows.where(F.col("server") == server) if server is not None else rows
    return rows.where(F.col("position") <= upto) if upto is not None else rows


def schema_change_messages(versions: DataFrame) -> DataFrame:
    """(key, value) for a topic of schema changes: the database, and what changed as JSON."""
    return versions.select(F.col("db").alias("key"), F.to_json(F.struct("position", "db", "table", "kind", "definition")).alias("value"))


def heartbeats(spark: SparkSession, server: str, seconds: int = 10) -> DataFrame:
    """A stream of (key, ts_ms), one row for each interval."""
    rows = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000).load()
    return rows.select(F.lit(server).alias("key"), F.unix_millis("timestamp").alias("ts_ms"))


def source_struct(
    name: str, file: Column, pos: Column, row: Column, ts_sec: Column, db: Column, table: Column, server_id: int = 0, gtid: Column | None = None, snapshot: bool = False, query: Column | None = None
) -> Column:
    """Where a change comes from; inserts, updates and deletes have the same fields."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(name).alias("name"), F.lit(server_id).cast("long").alias("server_id"), ts_sec.cast("long").alias("ts_sec"), (none if gtid is None else gtid).alias("gtid"), file.alias("file"), pos.cast("long").alias("pos"),
        row.cast("int").alias("row"), F.lit(snapshot).alias("snapshot"), db.alias("db"), table.alias("table"), (none if query is None else query).alias("query"),
    )


def key_columns(table: str, primary_key: Sequence[str], custom: dict[str, Sequence[str]]) -> list[str]:
    """Columns of a record's key: of the first pattern that matches the table, else the primary key."""
    import re

    for pattern, columns in custom.items():
        if re.fullmatch(pattern, table, re.IGNORECASE):
            return list(columns)
    return list(primary_key)
