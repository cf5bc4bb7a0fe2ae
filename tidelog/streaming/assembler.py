"""Transactions in a stream: changes wait for their commit, keyed by transaction.

State lies in the state store of the checkpoint, so a restart goes on where it
was. Order holds within a transaction; rows carry commit_scn, by which a sink
orders transactions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.transactions import COMMIT, ROLLBACK

OUTPUT = "xid long, commit_scn long, scn long, payload string"


class Assembler(StatefulProcessor):
    """Holds a transaction's changes until it commits; drops them when it rolls back, or after ttl_ms without an end."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "scn long, payload string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held: list[tuple[int, str]] = []
        ended, rolled_back = None, False
        for batch in rows:
            for scn, code, payload in batch[["scn", "code", "payload"]].itertuples(index=False):
                if code == COMMIT:
                    ended = max(scn, ended or scn)
                elif code == ROLLBACK:
                    rolled_back = True
                else:
                    held.append((int(scn), payload))
        if rolled_back:
            self.pending.clear()
            return
        if ended is None:
            if held:
                self.pending.appendList(held)
            return
        released = sorted([*((r[0], r[1]) for r in self.pending.get()), *held], key=lambda r: r[0])
        self.pending.clear()
        if released:
            yield pd.DataFrame({"xid": key[0], "commit_scn": int(ended), "scn": [r[0] for r in released], "payload": [r[1] for r in released]})

    def close(self) -> None:
        pass


def assemble(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Changes of committed transactions; log: (xid, scn, code, payload) in a stream. Needs the RocksDB state store.

    Without ttl_ms an open transaction waits for ever.
    """
    rows = log.select(F.col("xid").cast("long").alias("xid"), F.col("scn").cast("long").alias("scn"), F.col("code").cast("int").alias("code"), F.col("payload").cast("string").alias("payload"))
    return rows.groupBy("xid").transformWithStateInPandas(Assembler(ttl_ms), OUTPUT, "Append", "ProcessingTime" if ttl_ms else "None")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that there is now into Parquet; rows are written once, also after a restart."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def materialize_batches(changes: DataFrame, path: str, checkpoint: str, key: list[str], position: str, after: list[str]):
    """Keeps the latest state of a stream of changes in Parquet: each batch merges into a new version of the table.

    A version is named by its batch, so a batch that runs again writes the same version. A batch after the first
    needs the version before: without it a FileNotFoundError is raised. Versions before that one go.
    """
    from ..operators.materialize import merge_changes

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n - 1}")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        kept = ["op", *key, position, *after]
        rows = batch.select(*kept)
        if n and not fs.exists(at):
            raise FileNotFoundError(f"{at}: the state before batch {n}")
        state = spark.read.parquet(str(at)) if n else rows.where("false").select(*key, position, *after)
        merge_changes(state, rows, key, position, "op", after).write.mode("overwrite").parquet(f"{path}/version={n}")
        # batch n may run again from n - 1; nothing reads what is older
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={n - 2}"), True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
