"""Queries that run a stream over all that there is, and schema histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry
from ..session import scratch_path, table
from ..streaming import assembler
from .catalogue import register
from .changes import ENDED, LOG


@register(f"WITH {LOG}, {ENDED} SELECT xid, commit_scn, position AS scn, op AS payload FROM changes JOIN ended USING (xid) WHERE op IS NOT NULL")
def stream_equals_batch(spark, sf_dir):
    """The streaming assembler over files of the marked log; equal to txn_commit_release."""
    from .changes import _log, _marked

    log = _log(spark, sf_dir)
    rows = log.where("op is not null").select("xid", F.col("position").alias("scn"), F.lit(1).alias("code"), F.col("op").alias("payload"))
    ends = _marked(log).select("xid", F.col("position").alias("scn"), "code", F.lit(None).cast("string").alias("payload"))
    path = scratch_path(spark, "log")
    rows.unionByName(ends).write.parquet(path)
    stream = spark.readStream.schema("xid long, scn long, code int, payload string").option("maxFilesPerTrigger", 1000).parquet(path)
    out, checkpoint = scratch_path(spark, "released"), scratch_path(spark, "state")
    assembler.run_available(assembler.assemble(stream), out, checkpoint)
    return spark.read.schema(assembler.OUTPUT).parquet(out)


@register("SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) // 1000000 AS start, event_type, count(*) AS n FROM events WHERE ts < time_bucket(INTERVAL '1 day', (SELECT max(ts) FROM events) - INTERVAL '10 minutes') GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Daily counts of a stream with a watermark: days that the watermark has passed."""
    path = scratch_path(spark, "events")
    table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(path).withWatermark("ts", "10 minutes")
    counts = stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = scratch_path(spark, "windows")
    assembler.run_available(counts.select(F.unix_seconds("w.start").alias("start"), "event_type", "n"), out, scratch_path(spark, "state"))
    return spark.read.schema("start long, event_type string, n long").parquet(out)


@register("""WITH e AS (SELECT *, user_id % 10 AS server, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS epoch FROM events),
m AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY server, epoch) AS made FROM e)
SELECT server, event_id AS position, CASE event_type WHEN 'signup' THEN 'create_table' WHEN 'error' THEN 'drop_table' ELSE 'alter_table' END AS kind,
CASE WHEN event_type <> 'error' AND event_id >= made THEN 1 + sum(CASE WHEN event_type IN ('click', 'view', 'purchase') AND event_id >= made THEN 1 ELSE 0 END) OVER (PARTITION BY server, epoch ORDER BY event_id) ELSE 0 END::INT AS columns FROM m""")
def ddl_replay(spark, sf_dir):
    """A schema history for each of ten servers, derived from events."""
    add = F.concat(F.lit("ALTER TABLE `t` ADD COLUMN `c"), F.col("event_id").cast("string"), F.lit("` DECIMAL(10,2) NOT NULL DEFAULT '0,5' COMMENT 'x, (y)'"))
    create = F.lit("CREATE TABLE IF NOT EXISTS t (id INT(11) UNSIGNED AUTO_INCREMENT, PRIMARY KEY (`id`)) ENGINE=InnoDB")
    sql = F.when(F.col("event_type") == "signup", create).when(F.col("event_type") == "error", "DROP TABLE IF EXISTS shop.t").otherwise(add)
    history = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("server"), F.col("event_id").alias("position"), sql.alias("sql"), F.lit("shop").alias("db"))
    return registry.replay(history, ["server"], "position", "sql", "db", definitions=False).select("server", "position", "kind", "columns")
