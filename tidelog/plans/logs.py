"""Queries over binary logs: ``events`` written as log files in the scratch folder and read back through the source."""

from __future__ import annotations

import struct
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import binlog as b
from ..session import scratch_path, table
from ..sources.binlog_source import BinlogSource
from .catalogue import register

#: Columns of the written table: id, user, type, value, moment, price, kind.
_TYPES = bytes((b.LONGLONG, b.LONG, b.VARCHAR, b.DOUBLE, b.DATETIME2, b.NEWDECIMAL, b.STRING))
_META = bytes((80, 0, 8, 6, 12, 4, b.ENUM, 1))


def _event(kind: int, body: bytes, at: int, seconds: int) -> bytes:
    size = 19 + len(body) + 4
    return struct.pack("<IBIIIH", seconds, kind, 1, size, at + size, 0) + body + b"\0\0\0\0"


def _big(numbers, size: int) -> np.ndarray:
    """The last bytes of numbers, the highest first, one row each."""
    return np.asarray(numbers, ">i8").view("u1").reshape(-1, 8)[:, 8 - size :]


def _images(rows: pd.DataFrame) -> list[bytes]:
    """Row images: null bits, id, user, type, value, moment, price, kind."""
    year, month, day, hour, minute, second, micro = (getattr(rows.ts.dt, x).to_numpy("int64") for x in ("year", "month", "day", "hour", "minute", "second", "microsecond"))
    packed = ((year * 13 + month) << 22 | day << 17 | hour << 12 | minute << 6 | second) + (1 << 39)
    # decimal(12,4): eight digits and four; negative ones are inverted
    cents = rows.cents.to_numpy("int64")
    if (np.abs(cents) >= 10**12).any():
        raise ValueError("a price of more than twelve digits")
    price = np.abs(cents) // 10000 << 16 | np.abs(cents) % 10000
    price = np.where(cents < 0, price ^ (1 << 48) - 1, price) ^ (1 << 47)
    value = rows.value.to_numpy("float64")
    absent = np.isnan(value)
    n = len(rows)
    head = np.hstack([(8 * absent).astype("u1")[:, None], rows.event_id.to_numpy("<i8").view("u1").reshape(n, 8), rows.user_id.to_numpy("<i4").view("u1").reshape(n, 4)]).tobytes()
    tail = np.hstack([_big(packed, 5), _big(micro, 3), _big(price, 6), _big(rows.kind, 1)]).tobytes()
    values = value.astype("<f8").tobytes()
    named = {x: bytes((len(x.encode()),)) + x.encode() for x in rows.event_type.unique()}
    return [
        head[13 * i : 13 * i + 13] + named[x] + (b"" if none else values[8 * i : 8 * i + 8]) + tail[15 * i : 15 * i + 15]
        for i, (x, none) in enumerate(zip(rows.event_type.tolist(), absent.tolist()))
    ]


def log_file(rows: pd.DataFrame) -> bytes:
    """A log file of rows in order: transactions of ten, each row created, then deleted or updated if its kind says so."""
    out = bytearray(b.MAGIC)
    seconds = int(rows.ts.iloc[0].timestamp())
    out += _event(b.FORMAT, struct.pack("<H50sIB", 4, b"8.0.0", 0, 19) + bytes(40) + b"\1", len(out), seconds)
    xids = rows.event_id.to_numpy() // 10
    order = np.argsort(xids, kind="stable")
    made = zip(xids[order].tolist(), rows.kind.to_numpy()[order].tolist(), map(_images(rows).__getitem__, order.tolist()))
    name = struct.pack("<6sH", b"\7\0\0\0\0\0", 1) + b"\4shop\0" + b"\6events\0" + bytes((7,)) + _TYPES + bytes((len(_META),)) + _META + b"\x08"
    head, full = struct.pack("<6sHHB", b"\7\0\0\0\0\0", 1, 2, 7), b"\x7f"
    for xid, own in groupby(made, itemgetter(0)):
        out += _event(b.GTID, b"\0" + bytes(range(16)) + int(xid + 1).to_bytes(8, "little") + bytes(10), len(out), seconds)
        out += _event(b.QUERY, struct.pack("<IIBHH", 1, 0, 4, 0, 0) + b"shop\0BEGIN", len(out), seconds)
        out += _event(b.TABLE_MAP, name, len(out), seconds)
        images = [(kind, x) for _, kind, x in own]
        out += _event(b.WRITE[1], head + full + b"".join(x for _, x in images), len(out), seconds)
        if changed := [x + x for k, x in images if k == 2]:
            out += _event(b.UPDATE[1], head + full + full + b"".join(changed), len(out), seconds)
        if gone := [x for k, x in images if k == 3]:
            out += _event(b.DELETE[1], head + full + b"".join(gone), len(out), seconds)
        out += _event(b.XID, struct.pack("<Q", xid), len(out), seconds)
    return bytes(out)


def _written_logs(spark, sf_dir: str) -> str:
    from pyarrow import fs as pafs

    uri = scratch_path(spark, "binlog")
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("int").alias("user_id"), "event_type", F.when(e % 11 != 0, F.col("value")).alias("value"), F.col("ts").cast("timestamp").alias("ts"),
        (F.when(e % 2 == 0, e * 7).otherwise(-e * 7)).alias("cents"), (e % 3 + 1).alias("kind"), F.expr("event_id div 5000").alias("file"),
    )

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/bin.{int(pdf.file.iloc[0]):06d}", compression=None) as f:
            f.write(log_file(pdf.sort_values("event_id")))
        return pd.DataFrame({"file": [int(pdf.file.iloc[0])]})

    rows.groupBy("file").applyInPandas(write, "file long").write.format("noop").mode("overwrite").save()
    return uri


@register("""WITH e AS (SELECT *, event_id % 3 + 1 AS kind, (CASE WHEN event_id % 2 = 0 THEN 7 ELSE -7 END * event_id)::DECIMAL(12, 0) / 10000 AS p FROM events),
r AS (SELECT 'c' AS op, * FROM e UNION ALL SELECT 'u', * FROM e WHERE kind = 2 UNION ALL SELECT 'd', * FROM e WHERE kind = 3)
SELECT op, event_id AS id, user_id::INT AS user_id, event_type, CASE WHEN event_id % 11 <> 0 THEN value END AS value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS moment, p::DECIMAL(12, 4)::VARCHAR AS price, kind::INT AS kind,
printf('bin.%06d', event_id // 5000) AS file, '00010203-0405-0607-0809-0a0b0c0d0e0f:' || (event_id // 10 + 1) AS gtid FROM r""")
def binlog_rows(spark, sf_dir):
    spark.dataSource.register(BinlogSource)
    rows = spark.read.format("binlog").option("table", "events").load(_written_logs(spark, sf_dir)).where(F.col("op").isin("c", "u", "d"))
    image = F.col("image")
    return rows.select("op", F.from_json(F.coalesce("after", "before"), "array<string>").alias("image"), "file", "gtid").select(
        "op", image[0].cast("long").alias("id"), image[1].cast("int").alias("user_id"), image[2].alias("event_type"), image[3].cast("double").alias("value"), image[4].alias("moment"),
        image[5].cast("decimal(12,4)").cast("string").alias("price"), image[6].cast("int").alias("kind"), "file", "gtid",
    )


@register("SELECT count(DISTINCT event_id // 10) AS begins, count(DISTINCT event_id // 10) AS commits, max(event_id) % 10 AS last_row FROM events")
def binlog_transactions(spark, sf_dir):
    """BEGIN statements and commits of the log, and the number of the last transaction's last created row."""
    spark.dataSource.register(BinlogSource)
    rows = spark.read.format("binlog").load(_written_logs(spark, sf_dir))
    last = F.max(F.when(F.col("op") == "c", F.struct("file", "pos", "row")))
    return rows.agg(F.count(F.when(F.col("query") == "BEGIN", 1)).alias("begins"), F.count(F.when(F.col("op") == "k", 1)).alias("commits"), last["row"].alias("last_row"))
