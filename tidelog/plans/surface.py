"""Queries over the SQL surface: aggregates, windows, joins, sets, subqueries and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import mysql
from ..session import table
from .catalogue import register


@register("""SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS gid, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@register("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 10""")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).where("n > 10")


@register("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n"),
    )


@register("""SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey DESC) AS names, string_agg(DISTINCT left(n_name, 1), ',' ORDER BY left(n_name, 1)) AS letters FROM nation GROUP BY n_regionkey""")
def group_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("o", -F.col("n_nationkey")).withColumn("letter", F.left("n_name", F.lit(1)))
    return rows.groupBy("n_regionkey").agg(mysql.group_concat("n_name", "o", ";").alias("names"), mysql.group_concat("letter", distinct=True).alias("letters"))


@register("""SELECT event_type, round(stddev_pop(value), 4) AS std, round(var_pop(value), 4) AS variance, round(stddev_samp(value), 4) AS std_samp, round(var_samp(value), 4) AS var_samp,
round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type""")
def stddev_var_pop(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        *(F.round(f("value"), 4).alias(n) for f, n in ((F.stddev_pop, "std"), (F.var_pop, "variance"), (F.stddev_samp, "std_samp"), (F.var_samp, "var_samp"), (F.avg, "mean"))),
        F.min("value").alias("least"), F.max("value").alias("most"),
    )


@register("SELECT event_type, bit_and(user_id) AS a, bit_or(user_id) AS o, bit_xor(user_id) AS x, count(DISTINCT user_id) AS users, sum(DISTINCT user_id)::BIGINT AS total FROM events GROUP BY event_type")
def bit_aggs(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.bit_and("user_id").alias("a"), F.bit_or("user_id").alias("o"), F.bit_xor("user_id").alias("x"), F.count_distinct("user_id").alias("users"), F.sum_distinct("user_id").alias("total")
    )


@register("SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS names FROM nation GROUP BY n_regionkey")
def json_arrayagg(spark, sf_dir):
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(names).alias("names"))


@register("""SELECT event_id, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd, ntile(4) OVER w AS nt
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id), v AS (PARTITION BY user_id ORDER BY event_type)""")
def ranking_windows(spark, sf_dir):
    w, v = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id").orderBy("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"),
        F.round(F.percent_rank().over(v), 6).alias("pr"), F.round(F.cume_dist().over(v), 6).alias("cd"), F.ntile(4).over(w).alias("nt"),
    )


@register("""SELECT event_id, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3, first_value(event_id) OVER w AS first, last_value(event_id) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last,
nth_value(event_id, 2) OVER w AS second, lag(event_id, 2, -1) OVER w AS back2, lead(event_id) OVER w AS next, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def frame_windows(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last3"), F.first_value("event_id").over(w).alias("first"), F.last_value("event_id").over(rest).alias("last"),
        F.nth_value("event_id", 2).over(w).alias("second"), F.lag("event_id", 2, -1).over(w).alias("back2"), F.lead("event_id").over(w).alias("next"),
        F.count(F.lit(1)).over(w.rangeBetween(-100, 100)).alias("near"),
    )


@register("""WITH c AS (SELECT c_custkey, c_nationkey FROM customer), o AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT 'inner' AS kind, count(*) AS n FROM c JOIN o ON c_custkey = o_custkey UNION ALL SELECT 'left', count(*) FROM c LEFT JOIN o ON c_custkey = o_custkey
UNION ALL SELECT 'right', count(*) FROM c RIGHT JOIN o ON c_custkey = o_custkey UNION ALL SELECT 'full', count(*) FROM c FULL JOIN o ON c_custkey = o_custkey
UNION ALL SELECT 'semi', count(*) FROM c SEMI JOIN o ON c_custkey = o_custkey UNION ALL SELECT 'anti', count(*) FROM c ANTI JOIN o ON c_custkey = o_custkey
UNION ALL SELECT 'cross', count(*) FROM nation CROSS JOIN region""")
def join_kinds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    out = table(spark, sf_dir, "nation").crossJoin(table(spark, sf_dir, "region")).agg(F.lit("cross").alias("kind"), F.count(F.lit(1)).alias("n"))
    for name, how in (("inner", "inner"), ("left", "left"), ("right", "right"), ("full", "full"), ("semi", "left_semi"), ("anti", "left_anti")):
        out = out.unionByName(c.join(o, c["c_custkey"] == o["o_custkey"], how).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n")))
    return out


@register("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY n_name, r_name""")
def join_chain(spark, sf_dir):
    # small dimensions are broadcast by their statistics; orders and customer are not hinted
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).drop("r_name")


_SUBQUERIES = """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)
AND c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"""


@register(_SUBQUERIES)
def subqueries(spark, sf_dir):
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    rich = o.where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    mean = c.agg(F.avg("c_acctbal").alias("m"))
    near = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    out = c.join(rich, "c_custkey", "left_semi").join(near, "c_nationkey", "left_semi")
    return out.join(F.broadcast(mean), F.col("c_acctbal") > F.col("m")).select("c_custkey")  # one row


@register("""WITH a AS (SELECT user_id, ts::DATE AS day FROM events WHERE event_type IN ('click', 'view')), b AS (SELECT user_id, ts::DATE AS day FROM events WHERE event_type IN ('click', 'purchase'))
SELECT 'all' AS kind, count(*) AS n FROM (SELECT user_id, day FROM a UNION ALL SELECT user_id, day FROM b)
UNION ALL SELECT 'distinct', count(*) FROM (SELECT user_id, day FROM a UNION SELECT user_id, day FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT user_id, day FROM a INTERSECT SELECT user_id, day FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT user_id, day FROM a EXCEPT SELECT user_id, day FROM b)""")
def union_all_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    a, b = (rows.where(F.col("event_type").isin("click", x)).select("user_id", "day") for x in ("view", "purchase"))
    sets = {"all": a.unionAll(b), "distinct": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = [df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, df in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def topk_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).offset(10)


@register("SELECT event_id, (props->>'$.k')::BIGINT AS k, json_valid(props) AS ok, json_array_length('[1,' || (props->>'$.k') || ']')::INT AS n FROM events")
def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        "event_id", k.cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"), F.json_array_length(F.concat(F.lit("[1,"), k, F.lit("]"))).alias("n")
    )


@register("""SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name)::INT AS n, reverse(c_name) AS rev, lpad(c_custkey::VARCHAR, 6, '0') AS padded, left(c_name, 3) AS l3, right(c_name, 2) AS r2,
replace(c_name, 'C', 'K') AS rep, instr(c_name, '#')::INT AS at, c_mktsegment || '-' || c_name AS cat, ascii(c_name)::INT AS asc, repeat('ab', 2) AS twice, split_part(c_name, '#', 1) AS before,
CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS field, trim('  x ') AS trimmed, octet_length(encode(c_name))::INT AS bytes FROM customer""")
def string_funcs(spark, sf_dir):
    c, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(c).alias("up"), F.lower(m).alias("low"), F.char_length(c).alias("n"), F.reverse(c).alias("rev"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("padded"),
        F.left(c, F.lit(3)).alias("l3"), F.right(c, F.lit(2)).alias("r2"), F.replace(c, F.lit("C"), F.lit("K")).alias("rep"), F.instr(c, "#").alias("at"), F.concat_ws("-", m, c).alias("cat"),
        F.ascii(c).alias("asc"), F.repeat(F.lit("ab"), 2).alias("twice"), F.substring_index(c, "#", 1).alias("before"), mysql.field(m, "BUILDING", "MACHINERY").alias("field"),
        F.trim(F.lit("  x ")).alias("trimmed"), F.octet_length(c).alias("bytes"),
    )


@register("""SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, dayofyear(o_orderdate)::INT AS doy, strftime(last_day(o_orderdate), '%Y-%m-%d') AS eom,
strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS later, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS days, strftime(o_orderdate, '%Y%m') AS period, dayname(o_orderdate) AS name, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719528)::INT AS to_days FROM orders""")
def date_funcs(spark, sf_dir):
    c = F.col("o_orderdate")
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(c).alias("y"), F.quarter(c).alias("q"), F.month(c).alias("m"), F.dayofmonth(c).alias("d"), F.dayofyear(c).alias("doy"), day(F.last_day(c)).alias("eom"), day(F.date_add(c, 40)).alias("later"),
        F.datediff(c, F.lit("1992-01-01").cast("date")).alias("days"), F.date_format(c, "yyyyMM").alias("period"), F.date_format(c, "EEEE").alias("name"), mysql.to_days(c).alias("to_days"),
    )


@register("""SELECT p_partkey, round(sqrt(p_retailprice), 4) AS root, round(ln(p_retailprice), 4) AS ln, round(power(p_size, 2), 2) AS sq, p_size % 7 AS md, floor(p_retailprice)::BIGINT AS fl, ceil(p_retailprice)::BIGINT AS ce, sign(p_size - 25)::INT AS sg,
greatest(p_size, 10)::INT AS ge, least(p_size, 10)::INT AS le, round(degrees(1.0), 4) AS dg, bit_count(p_size)::INT AS bits, hex(p_partkey) AS hx, p_size & 6 AS ba, p_size | 6 AS bo, xor(p_size, 6) AS bx, p_size << 2 AS sl, p_partkey // 7 AS dv, round(atan2(p_size, 3), 4) AS at, bin(p_size) AS bn FROM part""")
def math_funcs(spark, sf_dir):
    s, p, k = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.sqrt(p), 4).alias("root"), F.round(F.ln(p), 4).alias("ln"), F.round(F.pow(s, F.lit(2)), 2).alias("sq"), (s % 7).alias("md"), F.floor(p).alias("fl"), F.ceil(p).alias("ce"), F.sign(s - 25).cast("int").alias("sg"),
        F.greatest(s, F.lit(10)).alias("ge"), F.least(s, F.lit(10)).alias("le"), F.round(F.degrees(F.lit(1.0)), 4).alias("dg"), F.bit_count(s).alias("bits"), F.hex(k).alias("hx"), s.bitwiseAND(6).alias("ba"), s.bitwiseOR(6).alias("bo"), s.bitwiseXOR(6).alias("bx"),
        F.shiftleft(s, 2).alias("sl"), F.expr("p_partkey div 7").alias("dv"), F.round(F.atan2(s, F.lit(3)), 4).alias("at"), F.bin(s).alias("bn"),
    )


@register("""SELECT event_id, ((10 * 256 + event_id % 256) * 256 + 3) * 256 + event_id // 256 % 256 AS aton, '10.' || (event_id % 256) || '.3.' || (event_id // 256 % 256) AS ntoa,
CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'a,b' END AS made, (CASE WHEN event_id % 12 < 2 THEN 202011 + event_id % 12 ELSE 202101 + event_id % 12 - 2 END)::BIGINT AS period,
CASE WHEN event_id % 2 = 1 THEN 'Y' ELSE 'N' END || ',' || CASE WHEN event_id // 2 % 2 = 1 THEN 'Y' ELSE 'N' END AS exported, (event_id % 2 = 0) <> (event_id % 3 = 0) AS x FROM events""")
def mysql_funcs(spark, sf_dir):
    e = F.col("event_id")
    ip = F.concat(F.lit("10."), (e % 256).cast("string"), F.lit(".3."), (F.expr("event_id div 256") % 256).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", mysql.inet_aton(ip).alias("aton"), mysql.inet_ntoa(mysql.inet_aton(ip)).alias("ntoa"), mysql.make_set(e % 4, "a", "b").alias("made"), mysql.period_add(F.lit(202011), e % 12).alias("period"),
        mysql.export_set(e % 4, "Y", "N", ",", 2).alias("exported"), mysql.xor(e % 2 == 0, e % 3 == 0).alias("x"),
    )


@register("""SELECT event_id, event_type IN ('click', 'view') AS listed, value BETWEEN 10 AND 20 AS inside, event_type LIKE 'c%' AS liked, regexp_matches(event_type, '^p') AS matched, (NULLIF(event_type, 'click') IS NOT DISTINCT FROM NULL) AS same,
coalesce(NULLIF(event_type, 'click'), '-') AS filled FROM events""")
def predicate_kinds(spark, sf_dir):
    t = F.col("event_type")
    nulled = F.nullif(t, F.lit("click"))
    return table(spark, sf_dir, "events").select(
        "event_id", t.isin("click", "view").alias("listed"), F.col("value").between(10, 20).alias("inside"), t.like("c%").alias("liked"), t.rlike("^p").alias("matched"), nulled.eqNullSafe(F.lit(None)).alias("same"), F.ifnull(nulled, F.lit("-")).alias("filled")
    )


@register("SELECT vec_id, label, len(embedding)::INT AS n, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 3) AS norm FROM embeddings")
def array_ops(spark, sf_dir):
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("n"), F.round(F.sqrt(square), 3).alias("norm"))


@register("SELECT page_id, length(html)::INT AS n, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, contains(html, '<nav>') AS nav FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.char_length("html").alias("n"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.contains("html", F.lit("<nav>")).alias("nav"))


@register("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows_tumbling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


@register("""WITH s AS (SELECT epoch_us(ts) // 1000000 AS sec FROM events), w AS (SELECT sec, unnest([sec // 1800 * 1800, sec // 1800 * 1800 - 1800]) AS start FROM s)
SELECT start, count(*) AS n FROM w WHERE sec < start + 3600 GROUP BY start""")
def event_windows_sliding(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_seconds("w.start").alias("start"), "n")


@register("""WITH l AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS g FROM l)
SELECT user_id, min(us) AS start, count(*) AS n FROM s GROUP BY user_id, g""")
def event_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start"), "n")


@register("""SELECT event_id, sum(value::DECIMAL(20,6)) OVER w::VARCHAR AS total, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, count(*) OVER w AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)""")
def named_windows(spark, sf_dir):
    return spark.sql(
        """SELECT event_id, cast(cast(sum(cast(value AS DECIMAL(20,6))) OVER w AS DECIMAL(38,6)) AS STRING) AS total, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, count(*) OVER w AS n
        FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)""",
        events=table(spark, sf_dir, "events"),
    )


@register("SELECT doc_id, md5(source) AS m, sha1(source) AS s1, sha256(source) AS s2, lower(hex(source::BLOB)) AS hx, base64(source::BLOB) AS b64 FROM documents")
def crypto_funcs(spark, sf_dir):
    raw = F.col("source").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(raw).alias("m"), F.sha1(raw).alias("s1"), F.sha2(raw, 256).alias("s2"), F.lower(F.hex(raw)).alias("hx"), F.base64(raw).alias("b64"))


@register("""SELECT event_id, CASE WHEN value > 25 THEN 'high' ELSE 'low' END AS level, coalesce(NULLIF(event_type, 'view'), 'none') AS filled, NULLIF(event_type, 'view') IS NULL AS missing, TRY_CAST(substr(event_type, 1, 1) AS INT) AS number, value::INT AS whole FROM (SELECT event_id, event_type, floor(value) AS value FROM events)""")
def control_funcs(spark, sf_dir):
    t, v = F.col("event_type"), F.floor("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(v > 25, "high").otherwise("low").alias("level"), F.ifnull(F.nullif(t, F.lit("view")), F.lit("none")).alias("filled"), F.isnull(F.nullif(t, F.lit("view"))).alias("missing"),
        F.substring(t, 1, 1).try_cast("int").alias("number"), v.cast("int").alias("whole"),
    )


@register("""SELECT user_id, '{"n":' || count(*) || ',"first":"' || arg_min(event_type, event_id) || '"}' AS summary, list_contains(list(event_type), 'error') AS has_error FROM events GROUP BY user_id""")
def json_objects(spark, sf_dir):
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_type", "event_id").alias("first"), F.array_contains(F.collect_set("event_type"), "error").alias("has_error"))
    return grouped.select("user_id", F.to_json(F.struct("n", "first")).alias("summary"), "has_error")


@register("""SELECT nation.n_name, p.kind, p.amount FROM (SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY c_nationkey)
UNPIVOT (amount FOR kind IN (building, machinery)) p JOIN nation ON n_nationkey = c_nationkey""")
def pivot_unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    wide = wide.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))
    long_ = wide.unpivot("c_nationkey", ["building", "machinery"], "kind", "amount")
    return long_.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "kind", "amount")


@register("""SELECT o_orderkey, strftime(make_date(2000 + (o_orderkey % 20)::INT, 1, 1) + (o_orderkey % 366)::INT, '%Y-%m-%d') AS made, date_diff('hour', TIMESTAMP '1992-01-01', o_orderdate) AS hours, week(o_orderdate)::INT AS week,
dayofweek(o_orderdate)::INT + 1 AS dow, strftime(o_orderdate - INTERVAL 3 MONTH, '%Y-%m-%d') AS before, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, hour(o_orderdate)::INT AS h,
strftime(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y'), '%Y-%m-%d') AS parsed FROM orders""")
def more_date_funcs(spark, sf_dir):
    c, k = F.col("o_orderdate"), F.col("o_orderkey")
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", day(mysql.makedate((k % 20 + 2000).cast("int"), k % 366 + 1)).alias("made"), F.timestamp_diff("HOUR", F.lit("1992-01-01").cast("timestamp"), c.cast("timestamp")).alias("hours"), F.weekofyear(c).alias("week"),
        F.dayofweek(c).alias("dow"), day(F.add_months(c, -3)).alias("before"), day(F.date_trunc("month", c)).alias("month_start"), F.hour(c).alias("h"),
        day(F.to_date(F.date_format(c, "dd/MM/yyyy"), "dd/MM/yyyy")).alias("parsed"),
    )


@register("""SELECT event_id, event_type || ',' || event_id AS joined, list_position(['a', event_type, 'b'], event_type)::INT AS at, rpad(event_type, 10, '*') AS padded, 'Qu' || 'What' || substr(event_type, 3) AS inserted, concat_ws(':', event_type, NULL, 'x') AS ws,
lpad(bin(event_id % 8), 4, '0') AS bits, hex(event_id) AS hx, chr((65 + event_id % 26)::INT) AS letter, translate(event_type, 'aeiou', '12345') AS moved, length(event_type) * 8 AS bit_length, split_part(props, ':', -1) AS tail FROM events""")
def more_string_funcs(spark, sf_dir):
    t, e = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(t, F.lit(","), e.cast("string")).alias("joined"), F.find_in_set(t, F.concat(F.lit("a,"), t, F.lit(",b"))).alias("at"), F.rpad(t, 10, "*").alias("padded"),
        mysql.insert(F.concat(F.lit("Quxxxx"), F.substring(t, 3, 100)), 3, 4, "What").alias("inserted"), F.concat_ws(":", t, F.lit(None).cast("string"), F.lit("x")).alias("ws"), F.lpad(F.bin(e % 8), 4, "0").alias("bits"), F.hex(e).alias("hx"),
        F.char(F.lit(65) + e % 26).alias("letter"), F.translate(t, "aeiou", "12345").alias("moved"), F.bit_length(t).cast("long").alias("bit_length"), F.substring_index("props", ":", -1).alias("tail"),
    )


@register("""SELECT event_id, 'k' AS keys, 1 AS n, 'OBJECT' AS kind, CASE event_id % 3 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'ARRAY' ELSE 'STRING' END AS kind2, CASE event_id % 3 WHEN 1 THEN 2 ELSE 1 END AS n2,
event_type AS unquoted, true AS has_k, false AS has_z FROM events""")
def json_funcs(spark, sf_dir):
    e = F.col("event_id")
    odd = F.when(e % 3 == 0, "5").when(e % 3 == 1, "[1,2]").otherwise('"x"')
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(mysql.json_keys(F.col("props")), ",").alias("keys"), mysql.json_length(F.col("props")).alias("n"), mysql.json_type(F.col("props")).alias("kind"), mysql.json_type(odd).alias("kind2"), mysql.json_length(odd).alias("n2"),
        mysql.json_unquote(F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("unquoted"), mysql.json_contains_path(F.col("props"), "$.z", "$.k").alias("has_k"), mysql.json_contains_path(F.col("props"), "$.z").alias("has_z"),
    )
