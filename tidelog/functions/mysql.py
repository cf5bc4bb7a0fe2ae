"""Scalar functions of the source's SQL that Spark lacks under that meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(c: Column, *options: str) -> Column:
    """1-based place of a value among options; 0 if it is none of them, or null."""
    return F.coalesce(F.array_position(F.array(*(F.lit(o) for o in options)), c), F.lit(0)).cast("int")


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def oct_(c: Column) -> Column:
    return F.conv(c.cast("string"), 10, 8)


def inet_aton(c: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    part = lambda i: F.try_element_at(F.split(c, r"\."), F.lit(i)).cast("long")
    ok = c.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$")
    return F.when(ok, ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def inet_ntoa(c: Column) -> Column:
    n = c.cast("long")
    return F.concat_ws(".", *((F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)))


def period_add(period: Column, months: Column) -> Column:
    """A period yyyymm some months on."""
    total = F.floor(period / 100) * 12 + period % 100 - 1 + months
    return (F.floor(total / 12) * 100 + total % 12 + 1).cast("long")


def period_diff(a: Column, b: Column) -> Column:
    months = lambda p: F.floor(p / 100) * 12 + p % 100
    return (months(a) - months(b)).cast("long")


def to_days(c: Column) -> Column:
    """Days since year 0."""
    return F.unix_date(c.cast("date")) + 719528


def from_days(n: Column) -> Column:
    return F.date_from_unix_date((n - 719528).cast("int"))


def sec_to_time(c: Column) -> Column:
    n = F.abs(c.cast("long"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.when(c < 0, "-").otherwise(""), two(F.floor(n / 3600)), F.lit(":"), two(F.floor(n / 60) % 60), F.lit(":"), two(n % 60))


def time_to_sec(c: Column) -> Column:
    parts = F.split(F.ltrim(c), ":")
    part = lambda i: F.abs(F.try_element_at(parts, F.lit(i)).cast("long"))
    return F.when(c.startswith("-"), -1).otherwise(1) * (part(1) * 3600 + part(2) * 60 + part(3))


def make_set(bits: Column, *options: str) -> Column:
    listed = F.array(*(F.when(F.shiftright(bits.cast("long"), i) % 2 == 1, F.lit(o)) for i, o in enumerate(options)))
    return F.array_join(listed, ",")


def export_set(bits: Column, on: str, off: str, sep: str = ",", n: int = 64) -> Column:
    return F.array_join(F.array(*(F.when(F.shiftright(bits.cast("long"), i) % 2 == 1, F.lit(on)).otherwise(F.lit(off)) for i in range(n))), sep)


def insert(c: Column, at: int, length: int, new: str) -> Column:
    """A text with length characters from a place on replaced."""
    return F.when((F.char_length(c) >= at) & F.lit(at >= 1), F.overlay(c, F.lit(new), at, length)).otherwise(c)


def quote(c: Column) -> Column:
    escaped = F.regexp_replace(c, r"([\\'])", r"\\$1")
    return F.when(c.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))


def xor(a: Column, b: Column) -> Column:
    return a != b


def sounds_like(a: Column, b: Column) -> Column:
    return F.soundex(a) == F.soundex(b)


def group_concat(c: str, order: str | None = None, sep: str = ",", distinct: bool = False) -> Column:
    """Values of a group joined in order, nulls left out; distinct values are ordered by themselves."""
    if distinct:
        return F.array_join(F.array_sort(F.collect_set(c)), sep)
    pairs = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order or c).alias("o"), F.col(c).cast("string").alias("v")))))
    return F.array_join(pairs["v"], sep)


def as_number(c: Column) -> Column:
    """A text as a decimal, else null: wide enough for what a cascade of wider and wider types would hold."""
    return c.try_cast("decimal(38,10)")


def avro_name(c: Column) -> Column:
    """A name with characters that Avro does not allow replaced."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.]", "_"), r"^(?=\d)", "_")


def aes_key(key: bytes) -> bytes:
    """A key folded to 16 bytes: each byte is combined with those 16 further on."""
    out = bytearray(16)
    for i, b in enumerate(key):
        out[i % 16] ^= b
    return bytes(out)


def aes_encrypt(c: Column, key: bytes) -> Column:
    return F.aes_encrypt(c, F.lit(aes_key(key)), F.lit("ECB"), F.lit("PKCS"))


def aes_decrypt(c: Column, key: bytes) -> Column:
    return F.try_aes_decrypt(c, F.lit(aes_key(key)), F.lit("ECB"), F.lit("PKCS"))


def makedate(year: Column, day: Column) -> Column:
    """The day of a year; null below day 1."""
    return F.when(day > 0, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int")))


def json_keys(c: Column) -> Column:
    return F.json_object_keys(c)


def json_length(c: Column) -> Column:
    """Members of an array or object, 1 for a scalar; null for what is no JSON."""
    valid = F.try_parse_json(c).isNotNull()
    return F.when(valid, F.coalesce(F.json_array_length(c), F.when(F.json_object_keys(c).isNotNull(), F.size(F.json_object_keys(c))), F.lit(1)))


def json_type(c: Column) -> Column:
    """OBJECT, ARRAY, STRING, INTEGER, DOUBLE, BOOLEAN or NULL."""
    text = F.ltrim(c)
    return F.when(F.try_parse_json(c).isNotNull(), F.when(text.startswith("{"), "OBJECT").when(text.startswith("["), "ARRAY").when(text.startswith('"'), "STRING")
        .when(text.isin("true", "false"), "BOOLEAN").when(text == "null", "NULL").when(text.rlike(r"^-?\d+\s*$"), "INTEGER").otherwise("DOUBLE"))


def json_unquote(c: Column) -> Column:
    """A JSON string's text; other values as they are."""
    return F.when(c.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")).otherwise(c)


def json_contains_path(c: Column, *paths: str) -> Column:
    """If one of the paths holds a value."""
    found = F.lit(False)
    for p in paths:
        found = found | F.get_json_object(c, p).isNotNull()
    return found


def st_distance(a: Column, b: Column) -> Column:
    """Distance in the plane of two {x, y}."""
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))


def st_as_text(p: Column) -> Column:
    return F.when(p.isNotNull(), F.concat(F.lit("POINT("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")")))
