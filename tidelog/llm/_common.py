"""Scratch tables, broadcasts and Arrow helpers of the subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage is cut there."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and their measured bytes, up to which a side of a join is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def _width(df: DataFrame) -> F.Column:
    """Bytes of a row, about: variable ones as they are, others by their type."""
    fixed, varied = 16, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            varied.append(F.coalesce(F.octet_length(f.name), F.lit(0)) + 16)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            varied.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)))
        else:
            fixed += 8
    return sum(varied, F.lit(fixed)).cast("long")


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """The rows, marked for broadcast if they are few and narrow; measures them where their number is not given.

    Give a number only for rows of fixed width.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    if rows is None:
        n = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes")).first()
        return F.broadcast(df) if n["n"] <= limit and n["bytes"] <= BROADCAST_BYTES else df
    return F.broadcast(df) if rows <= limit else df


#: Rows of an Arrow batch: documents are long, and a batch lies in the JVM and in Python at once.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """The rows, to be sent to Python in batches of BATCH_ROWS unless the session asks for smaller ones.

    The setting is the session's and stays.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


try:
    _LIBC = ctypes.CDLL(None)
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def _trim() -> None:
    """Gives a task's freed memory back, since workers live on through stages that need none."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def give_back(spark) -> None:
    """Frees what plans that have run left in the driver: its garbage, shuffles and broadcasts that Spark drops only then, and the JVM's native memory.

    The last is done where the JVM knows the command (HotSpot on glibc), and passed over elsewhere.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    named = jvm.java.lang.Class.forName
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    try:
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class is closed to callers
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        pass
    _trim()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about max_bytes of the column, one row at least."""
    for batch in batches:
        at, rows = 0, batch.num_rows
        if not rows:
            continue
        mean = max(1, batch.column(column).nbytes // rows)
        step = max(1, max_bytes // mean)
        while at < rows:
            yield batch.slice(at, step)
            at += step
        # what batches before have freed goes back, so that a worker does not keep its largest ones
        pa.default_memory_pool().release_unused()
    _trim()


def word_array(text: str, pattern: str) -> F.Column:
    """Words of a text column as an array, cut at a pattern of separators; null has none."""
    c = F.coalesce(F.col(text), F.lit(""))
    return F.filter(F.split(c, pattern), lambda w: w != "")


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def ascii_lower(c: F.Column) -> F.Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)
