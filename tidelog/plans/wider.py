"""Queries over schema statements by kind, sets of transaction ids, sources of changes, JSON changes and data manipulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_edit
from ..operators import changelog, dml, gtid, registry
from ..session import table
from ..sources import history
from .catalogue import register

_BASE = "CREATE TABLE t (a INT, b VARCHAR(10) NOT NULL DEFAULT 'x', PRIMARY KEY (a)); "
#: Scripts, and what table t's columns and key are after them (no table: null).
SCRIPTS = [
    (_BASE, "a:int b:varchar*", "a"),
    (_BASE + "CREATE TABLE u LIKE t; DROP TABLE t; RENAME TABLE u TO t", "a:int b:varchar*", "a"),
    (_BASE + "ALTER TABLE t ADD COLUMN c DECIMAL(8,2) FIRST", "c:decimal a:int b:varchar*", "a"),
    (_BASE + "ALTER TABLE t ADD COLUMN (c BIGINT UNSIGNED, d DATE)", "a:int b:varchar* c:bigint unsigned d:date", "a"),
    (_BASE + "ALTER TABLE t ADD c TEXT AFTER a", "a:int c:text b:varchar*", "a"),
    (_BASE + "ALTER TABLE t CHANGE COLUMN b e BIGINT", "a:int e:bigint", "a"),
    (_BASE + "ALTER TABLE t MODIFY COLUMN b DATETIME(3) FIRST", "b:datetime a:int", "a"),
    (_BASE + "ALTER TABLE t DROP COLUMN b", "a:int", "a"),
    (_BASE + "ALTER TABLE t RENAME TO s; ALTER TABLE s RENAME TO t", "a:int b:varchar*", "a"),
    (_BASE + "ALTER TABLE t ALTER COLUMN b DROP DEFAULT", "a:int b:varchar", "a"),
    (_BASE + "ALTER TABLE t ALTER COLUMN a SET DEFAULT 5", "a:int* b:varchar*", "a"),
    (_BASE + "ALTER TABLE t DROP PRIMARY KEY", "a:int b:varchar*", ""),
    (_BASE + "ALTER TABLE t DROP PRIMARY KEY, ADD PRIMARY KEY (b)", "a:int b:varchar*", "b"),
    (_BASE + "ALTER TABLE t RENAME COLUMN b TO f", "a:int f:varchar*", "a"),
    (_BASE + "DROP TABLE IF EXISTS t, u", None, None),
    (_BASE + "TRUNCATE TABLE t", "a:int b:varchar*", "a"),
    ("CREATE TABLE t (a INT, g ENUM('x','y,z') CHARACTER SET latin1); CREATE UNIQUE INDEX i ON t (g)", "a:int g:enum", "g"),
    ("CREATE TABLE t (h CHARACTER VARYING(5), i NATIONAL CHARACTER(2), j DOUBLE PRECISION, k SERIAL)", "h:varchar i:char j:double k:bigint unsigned", "k"),
    ("CREATE TABLE other.t (a INT); USE other; ALTER TABLE t ADD b INT; USE d; CREATE TABLE t (z INT)", "z:int", ""),
    ("CREATE TABLE t (a INT, UNIQUE KEY k (a)); ALTER TABLE t ADD UNIQUE KEY l (a)", "a:int", "a"),
]


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _case(n: int) -> str:
    return " ".join(f"WHEN {i} THEN {_text(s[n])}" for i, s in enumerate(SCRIPTS))


@register(f"SELECT event_id, CASE event_id % {len(SCRIPTS)} {_case(1)} END AS columns, CASE event_id % {len(SCRIPTS)} {_case(2)} END AS key FROM events")
def ddl_kinds(spark, sf_dir):
    """Each event's script is read once for all events that have it."""
    scripts = F.array(*(F.lit(s[0]) for s in SCRIPTS))
    rows = table(spark, sf_dir, "events").select("event_id", F.get(scripts, (F.col("event_id") % len(SCRIPTS)).cast("int")).alias("sql"))
    return registry.outcomes(rows, "sql", "d", "t").select("event_id", "columns", "key")


@register("""SELECT event_id, CASE WHEN u = 0 THEN 'srv0:' || n || '-' || (n + 5) || ',x:1-9' ELSE 'srv0:1-3,srv' || u || ':' || n || '-' || (n + 5) || ',x:1-9' END AS joined,
CASE WHEN u = 0 THEN 'srv0:' || n || '-' || (n + 5) ELSE 'srv0:1-3' END AS kept, CASE WHEN u = 0 THEN 'srv0:' || n || '-' || n ELSE 'srv' || u || ':' || n || '-' || n END AS began,
CASE WHEN u = 0 THEN 'srv0:1-3' ELSE 'srv0:1-3,srv' || u || ':' || n || '-' || (n + 5) END AS started
FROM (SELECT event_id, user_id % 3 AS u, 2 + event_id % 100 AS n FROM events)""")
def gtid_algebra(spark, sf_dir):
    n = F.lit(2) + F.col("event_id") % 100
    own = F.concat(F.lit("srv"), (F.col("user_id") % 3).cast("string"), F.lit(":"), n.cast("string"), F.lit("-"), (n + 5).cast("string"))
    # the row's own set is parsed once, and joined with the fixed one once
    rows = table(spark, sf_dir, "events").select("event_id", gtid.parse(own).alias("b")).select("event_id", "b", gtid.with_(gtid.fixed("srv0:1-3,x:1-9"), F.col("b")).alias("both"))
    return rows.select(
        "event_id", gtid.render(F.col("both")).alias("joined"), gtid.render(gtid.retain(F.col("both"), ["srv0"])).alias("kept"), gtid.render(gtid.beginning(F.col("b"))).alias("began"),
        gtid.render(gtid.start_set(gtid.fixed("srv0:1-3"), F.col("b"))).alias("started"),
    )


@register("""SELECT event_id, 'main' AS name, 7::BIGINT AS server_id, (epoch_us(ts) // 1000000)::BIGINT AS ts_sec, 'u:' || event_id AS gtid, 'bin.' || (event_id // 1000) AS file, (event_id % 1000)::BIGINT AS pos,
(event_id % 10)::INT AS row, false AS snapshot, 'shop' AS db, 'user_state' AS tbl, NULL::VARCHAR AS query, value AS after_value FROM events""")
def source_structs(spark, sf_dir):
    e = F.col("event_id")
    source = history.source_struct(
        "main", F.concat(F.lit("bin."), F.expr("event_id div 1000").cast("string")), e % 1000, e % 10, F.unix_seconds(F.col("ts").cast("timestamp")), F.lit("shop"), F.lit("user_state"), 7, F.concat(F.lit("u:"), e.cast("string"))
    )
    rows = table(spark, sf_dir, "events").withColumn("op", F.lit("c"))
    out = changelog.envelope(rows, ["event_id"], F.lit(None).cast("double"), F.col("value"), source, F.unix_millis(F.col("ts").cast("timestamp")))
    s = "value.source."
    return out.select("key.event_id", *(f"{s}{c}" for c in ("name", "server_id", "ts_sec", "gtid", "file", "pos", "row", "snapshot", "db")), F.col(f"{s}table").alias("tbl"), f"{s}query", F.col("value.after").alias("after_value"))


@register("""SELECT event_id, '{"a": ' || event_id || ', "k": ' || k || '}' AS set_new, '{"k": 5}' AS set_old, props AS insert_old, '{"k": 5}' AS replaced, props AS replace_new, '{}' AS removed, '{"k": [' || k || ', 1]}' AS appended,
'{"z": {"y": 1}}' AS patched, '{"k": [' || k || ', 3]}' AS preserved, k = 3 AS overlap, CASE WHEN event_type = 'click' THEN '$.p[1]' END AS found
FROM (SELECT event_id, props, event_type, (props->>'$.k')::BIGINT AS k FROM events)""")
def json_changes(spark, sf_dir):
    p, e, j = F.col("props"), F.col("event_id").cast("string"), json_edit
    return table(spark, sf_dir, "events").select(
        "event_id", j.json_set(p, "$.a", e).alias("set_new"), j.json_set(p, "$.k", F.lit("5")).alias("set_old"), j.json_insert(p, "$.k", F.lit("5")).alias("insert_old"), j.json_replace(p, "$.k", F.lit("5")).alias("replaced"),
        j.json_replace(p, "$.z", F.lit("5")).alias("replace_new"), j.json_remove(p, "$.k").alias("removed"), j.json_array_append(p, "$.k", F.lit("1")).alias("appended"), j.json_merge_patch(p, F.lit('{"k": null, "z": {"y": 1}}')).alias("patched"),
        j.json_merge_preserve(p, F.lit('{"k": 3}')).alias("preserved"), j.json_overlaps(p, F.lit('{"k": 3, "x": 1}')).alias("overlap"),
        j.json_search(F.concat(F.lit('{"p": ["a", "'), "event_type", F.lit('"]}')), "click").alias("found"),
    )


@register("SELECT n_regionkey, to_json(map_from_entries(list((n_name, n_nationkey) ORDER BY n_name)))::VARCHAR AS members FROM nation GROUP BY n_regionkey")
def json_objectagg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(json_edit.json_objectagg("n_name", "n_nationkey").alias("members"))


@register("""WITH v AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x FROM customer WHERE c_nationkey = 3), w AS (SELECT c_acctbal AS x FROM customer WHERE c_nationkey = 4), k AS (SELECT o_custkey AS x FROM orders)
SELECT c_custkey, c_acctbal > ALL (SELECT x FROM w) AS above_all, c_acctbal <= ANY (SELECT x FROM w) AS below_any, c_acctbal > ALL (SELECT x FROM v) AS unsure_all, c_acctbal < ANY (SELECT x FROM v) AS unsure_any,
c_custkey = ANY (SELECT x FROM k) AS orders, c_custkey <> ALL (SELECT x FROM k) AS no_orders, c_acctbal > ALL (SELECT x FROM w WHERE x > 1e9) AS of_none FROM customer""")
def quantified_subqueries(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    v = c.where("c_nationkey = 3").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("x"))
    w = c.where("c_nationkey = 4").select(F.col("c_acctbal").alias("x"))
    k = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("x"))
    out = c.select("c_custkey", "c_acctbal")
    for column, op, values, every, name in (
        ("c_acctbal", ">", w, True, "above_all"), ("c_acctbal", "<=", w, False, "below_any"), ("c_acctbal", ">", v, True, "unsure_all"), ("c_acctbal", "<", v, False, "unsure_any"),
        ("c_custkey", "=", k, False, "orders"), ("c_custkey", "<>", k, True, "no_orders"), ("c_acctbal", ">", w.where("x > 1e9"), True, "of_none"),
    ):
        out = dml.quantified(out, column, op, values, every, name)
    return out.drop("c_acctbal")


_NEW = "n AS (SELECT o_custkey + 50 AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)"


@register(f"""WITH s AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), {_NEW},
ins AS (SELECT k, v FROM s UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM s)), rep AS (SELECT k, v FROM n UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM n)),
dup AS (SELECT k, CASE WHEN s.k IS NOT NULL AND n.k IS NOT NULL THEN s.v + n.v WHEN n.k IS NOT NULL THEN n.v ELSE s.v END AS v FROM s FULL JOIN n USING (k)),
upd AS (SELECT k, CASE WHEN v < 0 THEN 0 ELSE v END AS v FROM s), del AS (SELECT k, v FROM s WHERE NOT coalesce(v < 0, false))
SELECT 'ignore' AS kind, count(*) AS n, round(sum(v), 2) AS total FROM ins UNION ALL SELECT 'replace', count(*), round(sum(v), 2) FROM rep UNION ALL SELECT 'duplicate', count(*), round(sum(v), 2) FROM dup
UNION ALL SELECT 'update', count(*), round(sum(v), 2) FROM upd UNION ALL SELECT 'delete', count(*), round(sum(v), 2) FROM del""")
def dml_statements(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    n = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 50).alias("k")).agg(F.max("o_totalprice").alias("v"))
    made = {
        "ignore": dml.insert(s, n, ["k"], "ignore"), "replace": dml.insert(s, n, ["k"], "replace"), "duplicate": dml.insert(s, n, ["k"], {"v": F.col("v") + F.col("new_v")}),
        "update": dml.update(s, F.col("v") < 0, {"v": F.lit(0)}), "delete": dml.delete(s, F.col("v") < 0),
    }
    out = [df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total")) for kind, df in made.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@register("""WITH a AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name FROM nation), b AS (SELECT c_nationkey AS k, c_custkey FROM customer), c AS (SELECT r_regionkey AS r, r_name FROM region)
SELECT k, r, n_name, c_custkey, r_name FROM a JOIN b USING (k) NATURAL JOIN c""")
def join_using_natural(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"), "n_name")
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    c = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), "r_name")
    return dml.natural_join(a.join(b, ["k"]), c).select("k", "r", "n_name", "c_custkey", "r_name")


@register("SELECT event_type, count(DISTINCT (user_id, ts::DATE)) AS pairs, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_distinct_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    return rows.groupBy("event_type").agg(F.count_distinct("user_id", "day").alias("pairs"), F.count_distinct("user_id").alias("users"))
