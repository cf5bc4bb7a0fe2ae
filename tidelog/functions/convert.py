"""Values of source columns as typed values.

Null rule: null stays null in an optional column; else the column's default
counts, else the type's fallback.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a required column without a default has for null, by type.
FALLBACKS = {"int": 0, "bigint": 0, "smallint": 0, "double": 0.0, "float": 0.0, "string": "", "boolean": False}
# How many bits an unsigned integer type has.
UNSIGNED_BITS = {"tinyint": 8, "smallint": 16, "mediumint": 24, "int": 32, "bigint": 64}


def null_rule(c: Column, kind: str, optional: bool = True, default: object = None) -> Column:
    if optional:
        return c
    return F.coalesce(c, F.lit(FALLBACKS.get(kind, "") if default is None else default).cast(kind))


def unsigned(c: Column, kind: str) -> Column:
    """A stored integer read as unsigned; bigint gives a decimal."""
    if kind == "bigint":
        wide = c.cast("decimal(20,0)")
        return F.when(wide < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")
    wide = c.cast("bigint")
    return F.when(wide < 0, wide + (1 << UNSIGNED_BITS[kind])).otherwise(wide)


def decimal(c: Column, mode: str, precision: int = 10, scale: int = 0) -> Column:
    """A number in mode precise (decimal), double or string (plain digits); precise has no NaN or infinity."""
    if mode == "double":
        return c.cast("double")
    if mode == "string":
        return c.cast(f"decimal({precision},{scale})").cast("string")
    odd = F.isnan(c.cast("double")) | c.cast("double").isin(float("inf"), float("-inf"))
    return F.when(odd, F.raise_error(F.lit("no decimal has this value"))).otherwise(c.cast(f"decimal({precision},{scale})"))


def year(c: Column, adjust: bool = True) -> Column:
    """A year; of two digits 0 to 69 count from 2000, 70 to 99 from 1900."""
    if not adjust:
        return c.cast("int")
    return F.when((c >= 0) & (c <= 69), c + 2000).when((c >= 70) & (c <= 99), c + 1900).otherwise(c).cast("int")


def time_micros(c: Column) -> Column:
    """Microseconds of a time ``[-]hhh:mm:ss[.ffffff]``, with its sign; null if it is none."""
    pattern = r"^(-?)(\d{1,3}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    seconds = part(2).cast("long") * 3600 + part(3).cast("long") * 60 + part(4).cast("long")
    micros = F.substring(F.rpad(part(5), 9, "0"), 1, 6).cast("long")
    return F.when(c.rlike(pattern), F.when(part(1) == "-", -1).otherwise(1) * (seconds * 1_000_000 + micros))


def date(c: Column) -> Column:
    """A date ``yyyy-mm-dd``; null if any part is zero or it is no date."""
    pattern = r"^(\d{4})-(\d{2})-(\d{2})"
    zero = F.regexp_extract(c, pattern, 1).isin("0000") | F.regexp_extract(c, pattern, 2).isin("00") | F.regexp_extract(c, pattern, 3).isin("00")
    return F.when(c.rlike(pattern) & ~zero, F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def epoch_days(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def epoch(c: Column, precision: int) -> Column:
    """Milliseconds, microseconds or nanoseconds since 1970, by the column's number of digits of a second."""
    ts = c.cast("timestamp")
    if precision <= 3:
        return F.unix_millis(ts)
    return F.unix_micros(ts) if precision <= 6 else F.unix_micros(ts) * 1000


def zoned(c: Column) -> Column:
    """ISO text with offset."""
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")


def enum(index: Column, options: list[str]) -> Column:
    """The option of a 1-based index; 0 is empty, and null lies beyond the options."""
    listed = F.array(*(F.lit(o) for o in options))
    return F.when(index == 0, F.lit("")).when((index > 0) & (index <= len(options)), F.get(listed, (index - 1).cast("int")))


def enum_set(bits: Column, options: list[str], width: int = 64) -> Column:
    """Options of a bit mask, comma-joined.

    A bit beyond the options adds no text, but its separator where a known bit went before.
    """
    listed = F.array(*(F.lit(o) for o in options))
    at = F.sequence(F.lit(0), F.lit(width - 1))
    chosen = F.filter(at, lambda i: (F.call_function("shiftrightunsigned", bits.cast("long"), i) % 2) != 0)
    texts = F.transform(chosen, lambda i: F.coalesce(F.get(listed, i), F.lit("")))
    return F.array_join(texts, ",")


def bits(c: Column, length: int) -> Column:
    """One bit as a boolean, more as little-endian bytes."""
    if length == 1:
        return c.cast("long") != 0
    n = -(-length // 8)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex(F.call_function("shiftrightunsigned", c.cast("long"), i * 8) % 256), 2, "0")), ""))


def padded_binary(c: Column, length: int) -> Column:
    """Bytes filled with zeros on the right."""
    return F.rpad(c, F.lit(length), F.lit(b"\x00"))


def binary(c: Column, mode: str) -> Column:
    """Bytes as they are, as base64, or as lower-case hex."""
    return {"bytes": c, "base64": F.base64(c), "hex": F.lower(F.hex(c))}[mode]


def packed_date(v: Column) -> Column:
    """A date packed as day + 32 * (month + 16 * year); null if any part is zero."""
    day, month, y = v % 32, F.shiftright(v, 5) % 16, F.shiftright(v, 9)
    real = (day > 0) & (month > 0) & (y > 0)
    return F.when(real, F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd"))


def packed_datetime(v: Column) -> Column:
    """A date and time packed in 40 bits, the sign bit first; null if year, month or day is zero."""
    months = F.shiftright(v, 22) % (1 << 17)
    y, month, day = F.floor(months / 13), months % 13, F.shiftright(v, 17) % 32
    hour, minute, second = F.shiftright(v, 12) % 32, F.shiftright(v, 6) % 64, v % 64
    made = F.try_make_timestamp(*(x.cast("int") for x in (y, month, day, hour, minute)), second.cast("double"))
    return F.when((y > 0) & (month > 0) & (day > 0), made)


def packed_time(v: Column) -> Column:
    """Microseconds of a time packed in 24 bits, offset by 0x800000; below the offset it is negative."""
    n = F.abs(v - 0x800000)
    micros = ((F.shiftright(n, 12) % 1024) * 3600 + (F.shiftright(n, 6) % 64) * 60 + n % 64) * 1_000_000
    return F.when(v < 0x800000, -micros).otherwise(micros).cast("long")


def point(raw: Column) -> Column:
    """{srid, x, y} of four bytes of little-endian SRID and a little-endian WKB point; null if it is of another size; SRID 0 is null."""
    text = F.hex(raw)
    # bytes of a double, highest first
    flip = lambda at: F.concat(*(F.substring(text, at + 14 - 2 * i, 2) for i in range(8)))

    def double(at: int) -> Column:
        high, low = F.conv(F.substring(flip(at), 1, 8), 16, 10).cast("long"), F.conv(F.substring(flip(at), 9, 8), 16, 10).cast("long")
        sign, exponent = F.when(F.shiftright(high, 31) % 2 == 1, -1.0).otherwise(1.0), F.shiftright(high, 20) % 2048
        fraction = ((high % (1 << 20)) * float(1 << 32) + low) / float(1 << 52)
        return F.when((exponent == 0) & (fraction == 0), sign * 0.0).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))

    srid = F.conv(F.concat(*(F.substring(text, 7 - 2 * i, 2) for i in range(4))), 16, 10).cast("int")
    return F.when(
        F.octet_length(raw) == 25, F.struct(F.when(srid != 0, srid).alias("srid"), double(19).alias("x"), double(35).alias("y"))
    )
