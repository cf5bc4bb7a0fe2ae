"""Sets of global transaction ids: for each server a list of closed intervals.

Sets are ``map<string, array<struct<lo: bigint, hi: bigint>>>`` columns, so the
algebra stays in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import previous, running_sum

KIND = "map<string, array<struct<lo:bigint,hi:bigint>>>"
_INTERVALS = "array<struct<lo:bigint,hi:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once, however often, and in whatever lambda, the expression names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _interval(text: Column) -> Column:
    lo = F.substring_index(text, "-", 1).cast("long")
    return F.struct(lo.alias("lo"), F.substring_index(text, "-", -1).cast("long").alias("hi"))


def merged(intervals: Column) -> Column:
    """Intervals in order, those that touch or overlap joined."""

    def step(done: Column, x: Column) -> Column:
        top = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(top["lo"].alias("lo"), F.greatest(top["hi"], x["hi"]).alias("hi"))),
        )
        return F.when((F.size(done) > 0) & (x["lo"] <= top["hi"] + 1), joined).otherwise(F.concat(done, F.array(x)))

    # try semantics: element_at of an empty list must not fail before the size is looked at
    def safe(done: Column, x: Column) -> Column:
        return F.when(F.size(done) == 0, F.array(x)).otherwise(step(done, x))

    return _let(intervals, lambda xs: F.when(F.size(xs) <= 1, xs).otherwise(F.aggregate(F.sort_array(xs), F.array().cast(_INTERVALS), safe)))


def parse(text: Column) -> Column:
    """A set from ``uuid:1-3:5,uuid2:7``; of a server named twice the later part wins."""
    parts = F.filter(F.split(F.translate(text, " \t\n\x0b\f\r", ""), ","), lambda p: p != "")
    entry = lambda w: F.struct(F.get(w, F.lit(0)).alias("k"), merged(F.transform(F.slice(w, F.lit(2), F.size(w) - 1), _interval)).alias("v"))

    def later(entries: Column) -> Column:
        return F.aggregate(
            entries,
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{_INTERVALS}>")),
            lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))),
        )

    # most sets name a server once
    once = lambda entries: F.size(F.array_distinct(F.transform(entries, lambda e: e["k"]))) == F.size(entries)
    entries = F.transform(parts, lambda p: _let(F.split(p, ":"), entry))
    return _let(entries, lambda es: F.when(once(es), F.map_from_entries(es)).otherwise(later(es))).cast(KIND)


def fixed(text: str) -> Column:
    """The set of a text that is the same for all rows, as a constant: Spark would parse a literal once a row."""
    sets: dict[str, list[list[int]]] = {}
    for server, *spans in (p.split(":") for p in re.sub(r"\s", "", text, flags=re.ASCII).split(",") if p):
        done: list[list[int]] = []
        for lo, hi in sorted((int(x.split("-")[0]), int(x.split("-")[-1])) for x in spans):
            if done and lo <= done[-1][1] + 1:
                done[-1][1] = max(done[-1][1], hi)
            else:
                done.append([lo, hi])
        sets.pop(server, None)
        sets[server] = done
    span = lambda lo, hi: F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
    made = [x for k, v in sets.items() for x in (F.lit(k), F.array(*(span(*i) for i in v)).cast(_INTERVALS))]
    return (F.create_map(*made) if made else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{_INTERVALS}>"))).cast(KIND)


def render(ids: Column) -> Column:
    """A set as text, servers in order, each interval as lo-hi."""
    entry = lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda x: F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string"))), ":"))
    return F.array_join(F.transform(F.sort_array(F.map_entries(ids)), entry), ",")


def contained_within(a: Column, b: Column) -> Column:
    """If every interval of a lies in one of b's; a server that b lacks says no."""
    own = lambda ids, k: F.coalesce(F.try_element_at(ids, k), F.array().cast(_INTERVALS))
    inside = lambda x, ys: F.exists(ys, lambda y: (x["lo"] >= y["lo"]) & (x["hi"] <= y["hi"]))
    return _let(b, lambda ids: F.forall(F.map_entries(a), lambda e: _let(own(ids, e["key"]), lambda ys: F.forall(e["value"], lambda x: inside(x, ys)))))


def contains(ids: Column, server: Column, n: Column) -> Column:
    """If a set has one transaction."""
    return F.exists(F.coalesce(F.try_element_at(ids, server), F.array().cast(_INTERVALS)), lambda y: (n >= y["lo"]) & (n <= y["hi"]))


def with_(a: Column, b: Column) -> Column:
    """Both sets; of a server in both, b's intervals."""
    return _let(b, lambda ids: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(ids, k)), ids))


def retain(ids: Column, servers: list[str]) -> Column:
    """A set with the named servers alone."""
    return F.map_filter(ids, lambda k, v: k.isin(servers))


def beginning(ids: Column) -> Column:
    """A set whose servers begin where this one's do, one transaction each."""
    return F.transform_values(ids, lambda k, v: _let(F.array_min(v)["lo"], lambda lo: F.array(F.struct(lo.alias("lo"), lo.alias("hi")))))


def start_set(saved: Column, server: Column, include: list[str] | None = None) -> Column:
    """Where a reader starts: the server's set, saved servers' sets in place of its own, of included servers alone."""
    both = with_(server, saved)
    return retain(both, include) if include else both


def subtract_intervals(a: Column, b: Column) -> Column:
    """What intervals a have beyond intervals b: each interval of b cuts what is left."""

    def cut(left: Column, y: Column) -> Column:
        below = lambda x: F.struct(x["lo"].alias("lo"), F.least(x["hi"], y["lo"] - 1).alias("hi"))
        above = lambda x: F.struct(F.greatest(x["lo"], y["hi"] + 1).alias("lo"), x["hi"].alias("hi"))
        return F.filter(F.flatten(F.transform(left, lambda x: F.array(below(x), above(x)))), lambda x: x["lo"] <= x["hi"])

    return F.array_distinct(F.array_sort(F.aggregate(b, a, cut)))


def subtract(a: Column, b: Column) -> Column:
    """A set less another; servers of which nothing is left go."""
    left = _let(b, lambda ids: F.transform_values(a, lambda k, v: subtract_intervals(v, F.coalesce(F.try_element_at(ids, k), F.array().cast(_INTERVALS)))))
    return F.map_filter(left, lambda k, v: F.size(v) > 0)


def intervals_of_points(rows: DataFrame, server: str, n: str) -> DataFrame:
    """(server, lo, hi): runs of consecutive transaction numbers; repeated numbers count once."""
    points = previous(rows.select(server, n).distinct(), [server], n, F.col(n), "_before")
    begins = F.when(F.col("_before") + 1 == F.col(n), 0).otherwise(1)
    runs = running_sum(points, [server], n, begins, "_run")
    return runs.groupBy(server, "_run").agg(F.min(n).alias("lo"), F.max(n).alias("hi")).drop("_run")
