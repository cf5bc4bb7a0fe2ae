"""Queries over filters, mappers and typed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert, redo
from ..operators import mappers, predicates
from ..session import table
from .catalogue import register


@register("SELECT event_id FROM events WHERE regexp_full_match(lower('SHOP.' || event_type), 'shop\\.(cl.*|view)') AND NOT regexp_full_match(lower('SHOP.' || event_type), 'shop\\.err.*')")
def regex_include_exclude(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("SHOP").alias("db"), "event_type")
    return rows.where(predicates.selected_table(F.col("db"), F.col("event_type"), "sh.p", None, r"shop\.(cl.*|view)", r"shop\..*")).select("event_id")


@register("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click') AND event_type <> 'error'")
def builtin_filter(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "MySQL").when(F.col("event_type") == "error", "sys").otherwise("shop")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", name.alias("db"))
    return rows.where(predicates.selected_table(F.col("db"), F.col("event_type"))).select("event_id", "event_type")


@register("SELECT c_custkey, c_name, c_nationkey FROM customer")
def column_exclude(spark, sf_dir):
    return predicates.without_columns(table(spark, sf_dir, "customer"), r"c_acctbal, shop\.customer\.c_mkt.*", "shop.customer")


@register("SELECT doc_id, substr(text, 1, 3) AS text, substr(lang, 1, 1) AS lang, source FROM documents")
def truncate_strings(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mappers.apply(rows, [("text", mappers.truncate(3)), ("doc.lang", mappers.truncate(1))], ["doc_id"], "doc")


@register("SELECT event_id, '****' AS event_type, props FROM events")
def mask_strings(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    nulled = F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("event_type")
    return mappers.apply(rows.select("event_id", nulled, "props"), [("event_.*", mappers.mask(4))], ["event_id"])


@register("SELECT doc_id, sha256('salt' || source) AS source FROM documents")
def hash_mask(spark, sf_dir):
    return mappers.apply(table(spark, sf_dir, "documents").select("doc_id", "source"), [("source", mappers.hashed("salt"))])


_SIGNED = "(event_id % 400 - 200)"


@register(f"""SELECT event_id, CASE WHEN {_SIGNED} < 0 THEN {_SIGNED} + 256 ELSE {_SIGNED} END AS u8, CASE WHEN {_SIGNED} < 0 THEN {_SIGNED} + 65536 ELSE {_SIGNED} END AS u16,
CASE WHEN {_SIGNED} < 0 THEN {_SIGNED} + 16777216 ELSE {_SIGNED} END AS u24, CASE WHEN {_SIGNED} < 0 THEN {_SIGNED} + 4294967296 ELSE {_SIGNED} END AS u32,
(CASE WHEN {_SIGNED} < 0 THEN {_SIGNED}::HUGEINT + 18446744073709551616 ELSE {_SIGNED} END)::VARCHAR AS u64 FROM events""")
def unsigned_ints(spark, sf_dir):
    c = F.expr(_SIGNED)
    u = convert.unsigned
    return table(spark, sf_dir, "events").select(
        "event_id", u(c, "tinyint").alias("u8"), u(c, "smallint").alias("u16"), u(c, "mediumint").alias("u24"), u(c, "int").alias("u32"), u(c, "bigint").cast("string").alias("u64")
    )


@register("SELECT o_orderkey, o_totalprice::DECIMAL(12,2)::VARCHAR AS text, round(o_totalprice, 4) AS dbl, (o_totalprice::DECIMAL(12,2) * 100)::BIGINT AS cents FROM orders")
def decimal_modes(spark, sf_dir):
    c = F.col("o_totalprice")
    cents = (convert.decimal(c, "precise", 12, 2) * 100).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", convert.decimal(c, "string", 12, 2).alias("text"), F.round(convert.decimal(c, "double"), 4).alias("dbl"), cents.alias("cents"))


@register("""SELECT event_id, date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS days, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) * 1000 AS ns,
strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS zoned FROM events""")
def epoch_time_types(spark, sf_dir):
    c = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", convert.epoch_days(c).alias("days"), convert.epoch(c, 3).alias("ms"), convert.epoch(c, 6).alias("us"), convert.epoch(c, 9).alias("ns"), convert.zoned(c).alias("zoned")
    )


@register("""SELECT event_id, CASE WHEN y BETWEEN 0 AND 69 THEN y + 2000 WHEN y BETWEEN 70 AND 99 THEN y + 1900 ELSE y END::INT AS year
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 100 ELSE 1900 + event_id % 200 END AS y FROM events)""")
def year_adjust(spark, sf_dir):
    y = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100).otherwise(F.lit(1900) + F.col("event_id") % 200)
    return table(spark, sf_dir, "events").select("event_id", convert.year(y).alias("year"))


@register("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) *
((event_id % 838) * 3600000000 + (event_id % 60) * 60000000 + (event_id % 59) * 1000000 + CASE WHEN event_id % 5 = 0 THEN 500000 ELSE 0 END) END AS us FROM events""")
def time_to_micros(spark, sf_dir):
    e = F.col("event_id")
    text = F.concat(F.when(e % 2 == 0, "-").otherwise(""), F.format_string("%02d", e % 838), F.format_string(":%02d:%02d", e % 60, e % 59), F.when(e % 5 == 0, ".5").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", convert.time_micros(F.when(e % 7 == 0, F.lit("odd")).otherwise(text)).alias("us"))


@register("""SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 13 = 0 OR event_id % 29 = 0 THEN NULL
ELSE strftime(make_date(2000 + event_id % 20, event_id % 13, event_id % 29), '%Y-%m-%d') END AS day FROM events""")
def zero_date_null(spark, sf_dir):
    e = F.col("event_id")
    text = F.format_string("%04d-%02d-%02d", F.when(e % 5 == 0, F.lit(0)).otherwise(e % 20 + 2000).cast("int"), e % 13, e % 29)
    return table(spark, sf_dir, "events").select("event_id", convert.date(text).cast("string").alias("day"))


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS e,
CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'a,b' WHEN 4 THEN 'c' WHEN 5 THEN 'a,c' WHEN 6 THEN 'b,c' WHEN 7 THEN 'a,b,c' WHEN 8 THEN '' ELSE 'a,' END AS s FROM events""")
def enum_set_decode(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", convert.enum(e % 4, ["a", "b"]).alias("e"), convert.enum_set(e % 10, ["a", "b", "c"], 8).alias("s"))


@register("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS optional, CASE WHEN event_id % 13 = 0 THEN 'none' ELSE event_type END AS defaulted,
CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS required, CASE WHEN event_id % 11 = 0 THEN 0 ELSE user_id END AS number FROM events""")
def null_rules(spark, sf_dir):
    c = F.when(F.col("event_id") % 13 != 0, F.col("event_type"))
    n = F.when(F.col("event_id") % 11 != 0, F.col("user_id"))
    rule = convert.null_rule
    return table(spark, sf_dir, "events").select(
        "event_id", rule(c, "string").alias("optional"), rule(c, "string", False, "none").alias("defaulted"), rule(c, "string", False).alias("required"), rule(n, "bigint", False).alias("number")
    )


@register("""SELECT event_id, try_cast(printf('%04d-%02d-%02d', v >> 9, (v >> 5) % 16, v % 32) AS DATE)::VARCHAR AS day,
event_id % 2 = 1 AS flag, lpad(hex(event_id % 256), 2, '0') || lpad(hex(event_id // 256 % 256), 2, '0') AS bits
FROM (SELECT event_id, ((2020 << 9) + event_id % 512) AS v FROM events)""")
def packed_values(spark, sf_dir):
    e = F.col("event_id")
    v = (F.lit(2020 << 9) + e % 512).cast("long")
    return table(spark, sf_dir, "events").select("event_id", convert.packed_date(v).cast("string").alias("day"), convert.bits(e % 2, 1).alias("flag"), F.hex(convert.bits(e, 16)).alias("bits"))


@register("""SELECT event_id, lower(hex(event_type::BLOB)) AS hex, base64(event_type::BLOB) AS b64 FROM events""")
def binary_modes(spark, sf_dir):
    raw = F.col("event_type").cast("binary")
    return table(spark, sf_dir, "events").select("event_id", convert.binary(raw, "hex").alias("hex"), convert.binary(raw, "base64").alias("b64"))


@register("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'BEGIN' WHEN 1 THEN 'COMMIT' WHEN 2 THEN 'DML' WHEN 3 THEN 'DDL' ELSE 'XA' END AS kind FROM events""")
def statement_classes(spark, sf_dir):
    listed = F.array(*(F.lit(x) for x in ("BEGIN", " commit", "insert into t values (1)", "ALTER TABLE t ADD c INT", "xa prepare 'x'")))
    return table(spark, sf_dir, "events").select("event_id", predicates.statement_class(F.get(listed, (F.col("event_id") % 5).cast("int"))).alias("kind"))


@register("""SELECT event_id, 'NOTE' AS col, CASE WHEN event_id % 2 = 0 THEN 'it''s ' || event_type END AS text, CASE WHEN event_id % 2 = 1 THEN hex(event_type::BLOB) END AS hex FROM events""")
def lob_chunks(spark, sf_dir):
    head = F.lit('declare loc_c clob; begin select "NOTE" into loc_c from "S"."T" where "ID" = 1 for update; ')
    clob = F.concat(head, F.lit("buf_c := 'it''s "), "event_type", F.lit("';\n  dbms_lob.write(loc_c, 1, 1, buf_c); end;"))
    blob = F.concat(F.lit('declare begin select "NOTE" into loc_b from "S"."T" for update; buf_b := HEXTORAW(\''), F.hex(F.col("event_type").cast("binary")), F.lit("');\n  dbms_lob.write(loc_b, 1, 1, buf_b); end;"))
    sql = F.when(F.col("event_id") % 2 == 0, clob).otherwise(blob)
    return table(spark, sf_dir, "events").select("event_id", redo.lob_chunk(sql).alias("c")).select("event_id", F.col("c.column").alias("col"), "c.text", "c.hex")
