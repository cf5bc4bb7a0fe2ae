"""Queries over the change log that is derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import redo
from ..operators import changelog, gtid, materialize, positions, predicates, transactions
from ..session import scratch_path, table
from .catalogue import register

#: The change log in DuckDB, as the first tables of a WITH.
LOG = """
typed AS (SELECT *, lag(event_type) OVER w AS prev_type, lag(value) OVER w AS prev_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
ops AS (SELECT *, coalesce(prev_type <> 'error', false) AS existed FROM typed),
log AS (
  SELECT event_id AS position, event_id // 10 AS xid, user_id, event_type, ts,
    CASE WHEN event_type = 'error' AND existed THEN 'd' WHEN event_type = 'error' THEN NULL WHEN existed THEN 'u' ELSE 'c' END AS op,
    prev_value, value
  FROM ops),
changes AS (
  SELECT position, xid, user_id, event_type, ts, op,
    CASE WHEN op IN ('u', 'd') THEN prev_value END AS before_value, CASE WHEN op IN ('c', 'u') THEN value END AS after_value
  FROM log)"""
ENDED = """
ended AS (SELECT xid, max(position) AS commit_scn FROM changes WHERE xid % 7 <> 0 AND xid % 11 <> 0 GROUP BY xid)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts"))


def _marked(log: DataFrame) -> DataFrame:
    """The log with a commit or rollback row at the end of each transaction that has one."""
    ends = log.groupBy("xid").agg(F.max("position").alias("position"))
    code = F.when(F.col("xid") % 7 == 0, transactions.ROLLBACK).when(F.col("xid") % 11 != 0, transactions.COMMIT)
    return ends.select("xid", "position", code.alias("code")).where("code is not null")


@register(f"WITH {LOG} SELECT position, user_id, op, round(before_value, 4) AS before_value, round(after_value, 4) AS after_value FROM changes WHERE op IS NOT NULL")
def envelope_create_update_delete(spark, sf_dir):
    log = _log(spark, sf_dir)
    source = F.struct(F.lit("user_state").alias("table"), F.col("position"))
    out = changelog.envelope(log, ["user_id"], F.col("before_value"), F.col("after_value"), source, F.unix_millis(F.col("ts").cast("timestamp")))
    v = out.select("key.user_id", "value.*")
    return v.select(F.col("source.position").alias("position"), "user_id", "op", F.round("before", 4).alias("before_value"), F.round("after", 4).alias("after_value"))


@register("SELECT c_custkey, 'r' AS op, c_name AS after_name, CAST(NULL AS VARCHAR) AS before_name FROM customer")
def snapshot_read(spark, sf_dir):
    out = changelog.snapshot(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], "customer")
    return out.select("key.c_custkey", F.col("value.op").alias("op"), F.col("value.after.c_name").alias("after_name"), F.col("value.before.c_name").alias("before_name"))


@register(f"""WITH {LOG}, last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY position DESC) AS rn FROM changes WHERE op IS NOT NULL)
SELECT user_id, position, round(after_value, 4) AS after_value FROM last WHERE rn = 1 AND op <> 'd'""")
def latest_state(spark, sf_dir):
    return materialize.latest_state(_log(spark, sf_dir), ["user_id"], "position").withColumn("after_value", F.round("after_value", 4))


@register(f"""WITH {LOG}, {ENDED}, kept AS (SELECT c.* FROM changes c JOIN ended USING (xid) WHERE op IS NOT NULL),
last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY position DESC) AS rn FROM kept)
SELECT user_id, position, round(after_value, 4) AS after_value FROM last WHERE rn = 1 AND op <> 'd'""")
def latest_committed_state(spark, sf_dir):
    log = _log(spark, sf_dir)
    kept = transactions.committed(log, transactions.outcomes(_marked(log), ["xid"], "code", "position"), ["xid"])
    return materialize.latest_state(kept, ["user_id"], "position").withColumn("after_value", F.round("after_value", 4))


@register(f"""WITH {LOG}, last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY position DESC) AS rn FROM changes WHERE op IS NOT NULL)
SELECT user_id, position, round(after_value, 4) AS after_value FROM last WHERE rn = 1 AND op <> 'd'""")
def merge_in_steps(spark, sf_dir):
    log = _log(spark, sf_dir)
    half = log.agg(F.expr("cast(max(position) div 2 as bigint)").alias("m"))
    parts = log.crossJoin(F.broadcast(half))  # one row
    # deleted keys come back only through later changes, so two merges equal one
    first = materialize.latest_state(parts.where("position <= m"), ["user_id"], "position")
    out = materialize.merge_changes(first, parts.where("position > m"), ["user_id"], "position")
    return out.withColumn("after_value", F.round("after_value", 4))


_KEYED = """keyed AS (SELECT o_orderkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS old_key, o_custkey AS new_key,
  lag(o_orderstatus) OVER (ORDER BY o_orderkey) AS before, o_orderstatus AS after FROM orders)"""


def _chained_orders(spark, sf_dir):
    """Orders as versions of one row whose key changes: chained in order of o_orderkey, by range and not in one task."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: bounds of ranges are sampled, and the parts are read twice
    path = scratch_path(spark, "ranged")
    rows.repartitionByRange(parts, "o_orderkey").withColumn("p", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    line = Window.partitionBy("p").orderBy("o_orderkey")
    inner = ranged.withColumn("prev", F.lag(F.struct("o_custkey", "o_orderstatus")).over(line))
    # the last row of each part leads into the next: one row a part
    ends = ranged.groupBy("p").agg(F.max_by(F.struct("o_custkey", "o_orderstatus"), "o_orderkey").alias("end"), F.max("o_orderkey").alias("k"))
    heads = ends.select("p", F.lag("end").over(Window.orderBy("k")).alias("lead_in"))
    out = inner.join(heads, "p").withColumn("prev", F.coalesce("prev", "lead_in"))
    return out.select("o_orderkey", F.col("prev.o_custkey").alias("old_key"), F.col("o_custkey").alias("new_key"), F.col("prev.o_orderstatus").alias("before"), F.col("o_orderstatus").alias("after"))


@register(f"""WITH {_KEYED}
SELECT o_orderkey, 0 AS ordinal, new_key AS "key", 'c' AS op, NULL AS before, after FROM keyed WHERE old_key IS NULL
UNION ALL SELECT o_orderkey, 0, new_key, 'u', before, after FROM keyed WHERE old_key = new_key
UNION ALL SELECT o_orderkey, 0, old_key, 'd', before, NULL FROM keyed WHERE old_key <> new_key
UNION ALL SELECT o_orderkey, 1, old_key, 't', NULL, NULL FROM keyed WHERE old_key <> new_key
UNION ALL SELECT o_orderkey, 2, new_key, 'c', NULL, after FROM keyed WHERE old_key <> new_key""")
def key_change_expansion(spark, sf_dir):
    return changelog.expand_key_changes(_chained_orders(spark, sf_dir), "old_key", "new_key", "before", "after")


@register(f"WITH {LOG} SELECT position, user_id, CAST(NULL AS VARCHAR) AS value FROM changes WHERE op = 'd'")
def tombstones(spark, sf_dir):
    return changelog.tombstones(_log(spark, sf_dir), ["position", "user_id"])


@register(f"WITH {LOG}, {ENDED} SELECT commit_scn, position, xid, user_id, op FROM changes JOIN ended USING (xid) WHERE op IS NOT NULL")
def txn_commit_release(spark, sf_dir):
    log = _log(spark, sf_dir)
    done = transactions.outcomes(_marked(log), ["xid"], "code", "position")
    out = transactions.committed(log.where("op is not null"), done, ["xid"])
    return out.select("commit_scn", "position", "xid", "user_id", "op").orderBy("commit_scn", "position")


@register(f"""WITH {LOG}, {ENDED} SELECT position, xid, user_id FROM changes WHERE xid % 7 <> 0 AND op IS NOT NULL
AND position <= (SELECT max(commit_scn) FROM ended)""")
def txn_overlap_trim(spark, sf_dir):
    log = _log(spark, sf_dir)
    done = transactions.outcomes(_marked(log), ["xid"], "code", "position")
    pending = log.where("op is not null").join(done, "xid", "left").where(F.coalesce("rolled_back", F.lit(0)) == 0)
    return transactions.trim_overlap(pending, "position").select("position", "xid", "user_id")


@register("""WITH marked AS (SELECT conv_id, turn, text, turn % 3 <> 2 AS csf FROM conversations),
starts AS (SELECT *, CASE WHEN coalesce(lag(csf) OVER (PARTITION BY conv_id ORDER BY turn), false) THEN 0 ELSE 1 END AS s FROM marked),
groups AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM starts)
SELECT conv_id, min(turn) AS start, count(*) AS pieces, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM groups GROUP BY conv_id, g""")
def csf_stitch(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("csf", F.col("turn") % 3 != 2)
    out = transactions.stitch(rows, ["conv_id"], "turn", "csf", "text")
    return out.select("conv_id", "start", "pieces", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("SELECT conv_id, count(*) AS chunks, md5(string_agg(text, '|' ORDER BY turn)) AS text_md5, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def lob_assemble(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    out = transactions.assemble_lobs(rows, ["conv_id"], "turn", "text", "|")
    return out.select("conv_id", "chunks", F.md5(F.col("text").cast("binary")).alias("text_md5"), (F.char_length("text") - F.col("chunks") + 1).cast("long").alias("chars"))


@register("SELECT event_id, 'shop.' || event_type AS table_id FROM events WHERE event_type IN ('click', 'purchase')")
def table_whitelist_semi(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("shop."), "event_type").alias("table_id"))
    allowed = spark.createDataFrame([("shop.click",), ("shop.purchase",), ("shop.none",)], "table_id string")
    return predicates.in_whitelist(rows, allowed, ["table_id"]).select("event_id", "table_id")


@register(f"""WITH {LOG} SELECT position, xid FROM changes WHERE xid NOT IN
(SELECT xid FROM changes GROUP BY xid HAVING count(*) > 1 AND sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 2)""")
def rollback_anti(spark, sf_dir):
    log = _log(spark, sf_dir)
    bad = log.groupBy("xid").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "error").cast("int")).alias("e")).where("n > 1 and e > 2")
    return log.join(bad, "xid", "left_anti").select("position", "xid")


@register("""WITH l AS (SELECT event_id AS scn, user_id, event_type, event_id % 5 = 4 AS undo FROM events WHERE event_type IN ('click', 'view')),
d AS (SELECT *, sum(CASE WHEN undo THEN 1 ELSE -1 END) OVER (PARTITION BY user_id, event_type ORDER BY scn DESC) AS depth FROM l),
f AS (SELECT *, least(0, coalesce(min(depth) OVER (PARTITION BY user_id, event_type ORDER BY scn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM d)
SELECT scn, user_id FROM f WHERE NOT undo AND depth < low""")
def savepoint_undo(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    undo = F.col("event_id") % 5 == 4
    op = F.when(F.col("event_type") == "click", F.when(undo, "DELETE").otherwise("INSERT")).otherwise("UPDATE")
    rows = rows.select(F.col("event_id").alias("scn"), "user_id", op.alias("operation"), undo.alias("undo"))
    return transactions.cancel_savepoints(rows, ["user_id"], "scn", "operation", "undo").select("scn", "user_id")


@register("""SELECT event_id, CASE WHEN ('b' || lpad((event_id // 1000)::VARCHAR, 6, '0'), event_id % 1000) <= ('b000003', 500) THEN 1 ELSE 0 END AS before FROM events""")
def position_compare(spark, sf_dir):
    file = F.concat(F.lit("B"), F.lpad(F.expr("cast(event_id div 1000 as string)"), 6, "0"))
    zero = F.lit(0)
    recorded = positions.ordering(file, F.col("event_id") % 1000, zero, zero)
    desired = positions.ordering(F.lit("b000003"), F.lit(500), zero, zero)
    return table(spark, sf_dir, "events").select("event_id", positions.at_or_before(recorded, desired).cast("int").alias("before"))


@register("""WITH l AS (SELECT event_id, event_id // 1000 AS f, (event_id % 1000) * 100 AS pos,
    CASE event_id % 5 WHEN 0 THEN 'BEGIN' WHEN 4 THEN 'XID' ELSE 'ROWS' END AS kind FROM events),
b AS (SELECT *, max(CASE WHEN kind = 'BEGIN' THEN pos END) OVER w AS begin_pos, sum(CASE kind WHEN 'BEGIN' THEN 1 WHEN 'XID' THEN -1 ELSE 0 END) OVER w AS depth
  FROM l WINDOW w AS (PARTITION BY f ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, kind, CASE WHEN depth > 0 THEN begin_pos ELSE pos + 100 END AS restart FROM b""")
def restart_offset(spark, sf_dir):
    kind = F.when(F.col("event_id") % 5 == 0, "BEGIN").when(F.col("event_id") % 5 == 4, "XID").otherwise("ROWS")
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 1000").alias("f"), ((F.col("event_id") % 1000) * 100).alias("pos"), kind.alias("kind"), F.lit(100).alias("len"))
    return positions.restart_offsets(rows, ["f"], "event_id", "kind", "pos", "len").select("event_id", "kind", "restart")


@register("""SELECT event_id, sum(CASE WHEN event_id % 250 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 3 ORDER BY event_id)::BIGINT AS epoch FROM events""")
def rotate_epochs(spark, sf_dir):
    kind = F.when(F.col("event_id") % 250 == 0, "ROTATE").otherwise("ROWS")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("s"), kind.alias("kind"))
    return positions.rotation_epochs(rows, ["s"], "event_id", "kind").select("event_id", "epoch")


@register("""SELECT event_id, least(row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id), count(*) OVER (PARTITION BY event_id // 10))::BIGINT AS next_row FROM events""")
def row_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 10").alias("xid"))
    return positions.row_offsets(rows, ["xid"], "event_id").select("event_id", F.col("next_row").cast("long").alias("next_row"))


@register("SELECT event_id FROM events WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE value >= 49), 1e18)")
def halt_take_while(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return positions.take_while(rows, "event_id", F.col("value") < 49).select("event_id")


_POINTS = "points AS (SELECT DISTINCT 'srv' || (user_id % 3) AS server, event_id AS n FROM events), runs AS (SELECT server, n, n - row_number() OVER (PARTITION BY server ORDER BY n) AS g FROM points)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("srv"), (F.col("user_id") % 3).cast("string")).alias("server"), F.col("event_id").alias("n"))


@register(f"WITH {_POINTS} SELECT server, min(n) AS lo, max(n) AS hi FROM runs GROUP BY server, g")
def gtid_intervals(spark, sf_dir):
    return gtid.intervals_of_points(_points(spark, sf_dir), "server", "n")


@register("""SELECT event_id, CASE WHEN user_id % 3 = 0 AND (event_id BETWEEN 1 AND 50 OR event_id BETWEEN 60 AND 99) OR user_id % 3 = 1 AND event_id = 7 THEN 1 ELSE 0 END AS inside FROM events""")
def gtid_contains(spark, sf_dir):
    ids = gtid.fixed("srv0:1-20:21-50:60-99,srv1:7")
    return _points(spark, sf_dir).select(F.col("n").alias("event_id"), gtid.contains(ids, F.col("server"), F.col("n")).cast("int").alias("inside"))


@register("""SELECT event_id, CASE WHEN event_id % 10 >= 2 AND event_id % 10 + 3 <= 9 THEN 1 ELSE 0 END AS inside FROM events""")
def gtid_containment(spark, sf_dir):
    lo = F.col("n") % 10
    a = gtid.parse(F.concat(F.lit("u:"), lo.cast("string"), F.lit("-"), (lo + 3).cast("string")))
    return _points(spark, sf_dir).select(F.col("n").alias("event_id"), gtid.contained_within(a, gtid.fixed("v:1-100,u:2-9")).cast("int").alias("inside"))


@register("""SELECT event_id, CASE WHEN k = 0 THEN 'u:' || (k + 2) || '-20' WHEN k >= 20 THEN 'u:1-' || (k - 1) ELSE 'u:1-' || (k - CASE WHEN k = 1 THEN 0 ELSE 1 END) || CASE WHEN k + 2 <= 20 THEN ':' || (k + 2) || '-20' ELSE '' END END AS left_over
FROM (SELECT event_id, 2 + event_id % 17 AS k FROM events)""")
def gtid_subtract(spark, sf_dir):
    k = F.lit(2) + F.col("n") % 17
    b = gtid.parse(F.concat(F.lit("u:"), k.cast("string"), F.lit("-"), (k + 1).cast("string")))
    return _points(spark, sf_dir).select(F.col("n").alias("event_id"), gtid.render(gtid.subtract(gtid.fixed("u:1-10:11-20"), b)).alias("left_over"))


@register("SELECT event_id // 1000 AS batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def scn_window_batches(spark, sf_dir):
    rows = positions.window_batches(table(spark, sf_dir, "events").select("event_id"), "event_id", 0, 1000)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@register("""WITH files AS (SELECT event_id // 100 AS first_change, 'redo' || (event_id % 7) AS name FROM events UNION SELECT event_id // 100, 'arch' || (event_id % 5) FROM events WHERE event_id % 2 = 0)
SELECT first_change, min(name) AS name, count(*) AS files FROM files GROUP BY first_change""")
def logfile_union_min(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("first_change"), "event_id")
    redo_files = rows.select("first_change", F.concat(F.lit("redo"), (F.col("event_id") % 7).cast("string")).alias("name"))
    archived = rows.where("event_id % 2 = 0").select("first_change", F.concat(F.lit("arch"), (F.col("event_id") % 5).cast("string")).alias("name"))
    both = redo_files.union(archived).distinct()
    return both.groupBy("first_change").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("files"))


@register("""WITH a AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase')
SELECT user_id, day, 'added' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT user_id, day, 'removed' FROM (FROM a EXCEPT FROM b)""")
def whitelist_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return predicates.whitelist_changes(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"), ["user_id", "day"])


@register("""WITH v AS (SELECT event_id AS position, user_id, 'v' || event_id AS version FROM events WHERE event_type = 'signup'),
e AS (SELECT event_id AS position, user_id FROM events)
SELECT e.position, e.user_id, v.version FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.position >= v.position""")
def schema_asof(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("position"), "event_type")
    versions = rows.where("event_type = 'signup'").select("user_id", "position", F.concat(F.lit("v"), F.col("position").cast("string")).alias("version"))
    return positions.as_of(rows.select("user_id", "position"), versions, ["user_id"], "position", "version").select("position", "user_id", "version")


@register("""WITH c AS (SELECT event_id, event_id // 1000 AS f, user_id % 3 AS db, CASE WHEN user_id % 3 IS DISTINCT FROM lag(user_id % 3) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) THEN 1 ELSE 0 END AS ch FROM events),
g AS (SELECT *, sum(ch) OVER (PARTITION BY f ORDER BY event_id) AS run FROM c)
SELECT f, run::BIGINT AS run, min(db) AS db, count(*) AS statements FROM g GROUP BY f, run""")
def ddl_grouping(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 1000").alias("f"), (F.col("user_id") % 3).alias("db"))
    return transactions.run_groups(rows, "event_id", "db", ["f"]).groupBy("f", "run").agg(F.min("db").alias("db"), F.count(F.lit(1)).alias("statements"))


@register("""WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT event_id, user_id, event_type FROM l WHERE p IS NULL OR p <> event_type""")
def dedup_consecutive(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return transactions.drop_repeats(rows, ["user_id"], "event_id", "event_type")


@register("""SELECT event_id, 'c' AS op, 'S' || user_id AS owner, 'T''' || event_type AS name, user_id::VARCHAR AS after_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'it''s, (' || event_type || ') and' END AS after_note FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'u', 'S' || user_id, 'T''' || event_type, user_id::VARCHAR, event_type FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 'd', 'S' || user_id, 'T''' || event_type, NULL, NULL FROM events WHERE event_id % 3 = 2""")
def redo_sql_parse(spark, sf_dir):
    q = redo.quoted
    where = F.concat(F.lit('"S'), F.col("user_id").cast("string"), F.lit('"."T\''), "event_type", F.lit('"'))
    note = F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("it's, ("), "event_type", F.lit(") and")))
    ident = q(F.col("user_id"))
    insert = F.concat(F.lit("insert into "), where, F.lit('("ID","NOTE") values ('), ident, F.lit(","), q(note), F.lit(");"))
    update = F.concat(F.lit("update "), where, F.lit(' set "NOTE" = '), q(F.col("event_type")), F.lit(' where "ID" = '), ident, F.lit(' and "NOTE" IS NULL;'))
    delete = F.concat(F.lit("delete from "), where, F.lit(' where "ID" = '), ident, F.lit(";"))
    sql = F.when(F.col("event_id") % 3 == 0, insert).when(F.col("event_id") % 3 == 1, update).otherwise(delete)
    parsed = table(spark, sf_dir, "events").select("event_id", redo.parse_redo(sql).alias("r"))
    return parsed.select("event_id", "r.op", "r.owner", "r.name", F.col("r.after")["ID"].alias("after_id"), F.col("r.after")["NOTE"].alias("after_note"))


@register("""WITH files AS (SELECT 'redo' || (event_id % 7) AS name, event_id // 100 * 100 AS first_change, event_id // 100 * 100 + 100 AS next_change FROM events
UNION SELECT 'arch' || (event_id % 5), event_id // 100 * 100, event_id // 100 * 100 + 100 FROM events WHERE event_id % 2 = 0)
SELECT first_change, min(name) AS name, min(next_change) AS next_change FROM files WHERE first_change < 450 AND next_change > 150 GROUP BY first_change""")
def logfiles_of_window(spark, sf_dir):
    first = F.expr("event_id div 100 * 100")
    rows = table(spark, sf_dir, "events").select("event_id", first.alias("first_change"), (first + 100).alias("next_change"))
    redo_files = rows.withColumn("name", F.concat(F.lit("redo"), (F.col("event_id") % 7).cast("string")))
    archived = rows.where("event_id % 2 = 0").withColumn("name", F.concat(F.lit("arch"), (F.col("event_id") % 5).cast("string")))
    return positions.log_files(redo_files, archived, 150, 450)


@register("SELECT min(event_id) AS position FROM events WHERE ts >= (SELECT min(ts) + INTERVAL '12 hours' FROM events)")
def position_at_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    start = rows.agg((F.min("ts") + F.expr("INTERVAL '12' HOUR")).alias("t0"))
    return positions.position_at(rows.join(F.broadcast(start)), "ts", "event_id", F.col("t0"))  # one row


@register("SELECT event_id, user_id AS id, event_type AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value::INT END AS amount FROM (SELECT event_id, user_id, event_type, floor(value) AS value FROM events)")
def row_image_columns(spark, sf_dir):
    amount = F.when(F.col("event_id") % 4 == 0, F.lit("odd")).otherwise(F.floor("value").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", F.array(F.col("user_id").cast("string"), "event_type", amount).alias("row"))
    return rows.select("event_id", changelog.name_columns(F.col("row"), ["id", "kind", "amount"], ["long", "string", "int"]).alias("r")).select("event_id", "r.*")


@register(f"""WITH {LOG} SELECT -1 AS position, c_custkey AS "key", 'r' AS op FROM customer UNION ALL SELECT position, user_id, op FROM changes WHERE op IS NOT NULL""")
def snapshot_then_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("r").alias("op"))
    changes = _log(spark, sf_dir).where("op is not null").select("position", F.col("user_id").alias("key"), "op")
    return changelog.snapshot_then_changes(rows, changes, "position").select("position", "key", "op")


@register("""SELECT event_id, event_id // 10 AS seen, CASE WHEN event_id % 1000 >= 10 THEN event_id // 10 - 1 END AS restart_seen FROM events""")
def gtid_tracking(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 1000").alias("f"), F.expr("event_id div 10").alias("n"))
    return positions.tracked_ids(rows, ["f"], "event_id", "n").select("event_id", "seen", "restart_seen")


@register("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'INTERNAL' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'UPDATE' WHEN 5 THEN 'DDL' ELSE 'UNSUPPORTED' END AS operation FROM events")
def operation_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", transactions.operation_name((F.col("event_id") % 6).cast("int")).alias("operation"))


@register(f"WITH {LOG} SELECT 'shop.' || event_type AS table_id, coalesce(op, '-') AS op, count(*) AS n FROM changes GROUP BY ALL")
def op_counts_by_table(spark, sf_dir):
    rows = _log(spark, sf_dir).select(F.concat(F.lit("shop."), "event_type").alias("table_id"), F.coalesce("op", F.lit("-")).alias("op"))
    return rows.groupBy("table_id", "op").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {LOG} SELECT position, op FROM changes WHERE op IN ('c', 'd')")
def op_filter(spark, sf_dir):
    return predicates.keep_operations(_log(spark, sf_dir), "op", ["u", "r"]).select("position", "op")
