"""Session and table helpers."""

from __future__ import annotations

import getpass
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def importable(spark: SparkSession) -> SparkSession:
    """The session, its Python workers told where this package lies.

    That holds where workers see the driver's files; on a cluster the package is shipped with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *known]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table; the path may be any URI that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: int | str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidelog")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master uses the machine's temporary folder and
    a cluster uses a folder in its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"file://{os.path.join(tempfile.gettempdir(), f'tidelog-{getpass.getuser()}')}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidelog_scratch"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
