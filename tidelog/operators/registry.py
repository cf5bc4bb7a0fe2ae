"""Versions of table schemas from the history of schema statements."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ddl import Catalogue, Table

_VERSION = "position long, db string, table string, kind string, columns int, definition string"


#: Statements of a part of a server's history, and the positions that are counted as one when parts are cut.
PART, SPAN = 1 << 15, 1 << 12
#: Characters of definitions that are returned at once.
WIDE = 1 << 22
_STATEMENT = "_part long, position long, sql string, db string"
_ID = r"(?P<{0}>`[^`]++`(?!`)|[A-Za-z_$][\w$]*+)"
_AT = rf"{_ID.format('a')}(?:\s*\.\s*{_ID.format('b')})?(?!\s*\.)"
_DROPS = re.compile(rf"\s*drop\s+table\s+(?:if\s+exists\s+)?{_AT}\s*;?\s*", re.IGNORECASE)
_TOUCHES = re.compile(rf"\s*(?:alter\s+table\s+{_AT}(?=\s)|create\s+table\s+(?:if\s+not\s+exists\s+)?{_AT.replace('<a>', '<c>').replace('<b>', '<d>')}\s*\((?!\s*like\b))", re.IGNORECASE)
#: What makes a statement more than one table's: a further statement, a comment that may hide a word, another name.
_MORE = re.compile(r";|--|\#|/\*|\brename\b", re.IGNORECASE)


def replay(history: DataFrame, server: Sequence[str], position: str, sql: str, db: str, definitions: bool = True, part: int = PART) -> DataFrame:
    """(server, position, db, table, kind, columns, definition): what each statement did, with the table as it is after it.

    Statements of one server depend on each other. A server's history is cut into parts of about ``part``
    statements; each part finds which of its statements still matter at its end, these few are applied in order
    over a server, which gives the catalogue that each part begins with, and the parts are replayed by themselves.
    A task holds a batch of rows and a catalogue, not a history. Statements at one position go by database
    and text. Statements that cannot be read are kept as ``unparsed``.
    Without definitions that column is null, which spares writing wide tables out after each statement.
    """
    server = list(server)
    rows = history.select(*server, F.col(position).cast("long").alias("position"), F.col(sql).alias("sql"), F.col(db).alias("db"))
    fields = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in server)
    rows = _parts(rows, server, part).select(*server, "_part", "position", "sql", "db")
    ordered = [*server, "_part", F.col("position").asc_nulls_last(), "db", "sql"]
    n = len(server)
    mattering = rows.repartition(*server, "_part").sortWithinPartitions(*ordered).mapInArrow(lambda batches: _mattering(batches, n), fields + _STATEMENT)
    begins = mattering.repartition(*server).sortWithinPartitions(*ordered).mapInArrow(lambda batches: _begins(batches, n), f"{fields}{_STATEMENT}, _state binary")
    both = rows.withColumn("_state", F.lit(None).cast("binary")).unionByName(begins)
    ordered.insert(n + 1, F.col("_state").isNull())
    return both.repartition(*server, "_part").sortWithinPartitions(*ordered).mapInArrow(lambda batches: _replayed(batches, n, definitions), fields + _VERSION)


def _parts(rows: DataFrame, server: list[str], part: int) -> DataFrame:
    """The rows with the number of their part: spans of positions, as many as make up a part."""
    rows = rows.withColumn("_span", F.floor(F.col("position") / SPAN).cast("long"))
    over = Window.partitionBy(*server).orderBy(F.col("_span").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(over), F.lit(0))
    cut = rows.groupBy(*server, "_span").agg(F.count(F.lit(1)).alias("_n")).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*server, "_span"])), F.floor(before / part).alias("_part"))
    same = F.lit(True)
    for i, c in enumerate([*server, "_span"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(cut, same)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(values of the first columns, rows) of each run of rows with the same values, batch by batch."""
    for batch in batches:
        at = 0
        for key, own in groupby(zip(*(batch.column(i).to_pylist() for i in range(keys)))) if keys else [((), range(batch.num_rows))]:
            size = sum(1 for _ in own)
            yield key, batch.slice(at, size)
            at += size


def touched(sql: str, db: str | None) -> tuple[tuple[str, str] | None, bool]:
    """The one table that a statement depends on and changes, and if it is gone afterwards whatever it was.

    None where that isn't plain from the beginning of the text: other tables, databases, names, variables.
    """
    if db is None or (m := (gone := _DROPS.fullmatch(sql)) or _TOUCHES.match(sql)) is None or _MORE.search(sql.rstrip("; \t\r\n")):
        return None, False
    names = [x.strip("`") for x in m.groups() if x]
    return (names[0], names[1]) if len(names) == 2 else (db, names[0]), gone is not None


def _mattering(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of each part the statements that give its end: those before a table is dropped are left out.

    A statement that may look at any table keeps all before it, and one without a database keeps the one before it, whose database it takes.
    """
    live: dict[int, tuple] = {}
    own: dict[tuple[str, str], list[int]] = {}
    now, schema, number = None, None, 0

    def kept() -> pa.RecordBatch:
        columns = [[x] * len(live) for x in now] + [list(x) for x in zip(*live.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for key, rows in _runs(batches, n + 1):
        if key != now:
            if live:
                yield kept()
            live, own, now, schema = {}, {}, key, rows.schema
        for statement in zip(*(rows.column(i).to_pylist() for i in range(n + 1, n + 4))):
            at, gone = touched(*statement[1:])
            if at is None:
                own.clear()
            elif gone:
                for i in own.pop(at, ()):
                    del live[i]
            live[number] = statement
            if at is not None:
                own.setdefault(at, []).append(number)
            number += 1
    if live:
        yield kept()


def _begins(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The catalogue that each part begins with, but for a server's first."""
    catalogue, now = Catalogue(), None
    for key, rows in _runs(batches, n + 1):
        if now is None or key[:n] != now[:n]:
            catalogue = Catalogue()
        elif key != now:
            columns = [pa.array([x], f.type) for x, f in zip((*key, None, None, None), rows.schema)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(catalogue)], pa.binary())], names=[*rows.schema.names, "_state"])
        now = key
        for sql, db in zip(rows.column(n + 2).to_pylist(), rows.column(n + 3).to_pylist()):
            catalogue.apply(sql, db)


def _replayed(batches: Iterator[pa.RecordBatch], n: int, definitions: bool) -> Iterator[pa.RecordBatch]:
    """What the statements of each part did; its catalogue comes before them."""
    catalogue, now = Catalogue(), None
    for key, rows in _runs(batches, n + 1):
        if key != now:
            catalogue, now = Catalogue(), key
        out: list[tuple] = []
        at: list[int] = []
        size = 0

        def made(rows=rows) -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))]
            taken = pa.array(at, pa.int64())
            names = [*rows.schema.names[:n], "position", "db", "table", "kind", "columns", "definition"]
            return pa.RecordBatch.from_arrays([*(rows.column(i).take(taken) for i in range(n)), rows.column(n + 1).take(taken), *columns], names=names)

        for i, (sql, db, state) in enumerate(zip(*(rows.column(k).to_pylist() for k in range(n + 2, n + 5)))):
            if state is not None:
                catalogue = pickle.loads(state)
                continue
            for e in catalogue.apply(sql, db):
                table = catalogue.tables.get((e.db, e.table))
                definition = table.as_json() if table and definitions else None
                out.append((e.db, e.table, e.kind, len(table.columns) if table else 0, definition))
                at.append(i)
                size += len(definition or "")
            if size > WIDE:
                yield made()
                out, at, size = [], [], 0
        if out:
            yield made()


def recover(history: DataFrame, upto: Column) -> DataFrame:
    """History rows at or before a stop point, to be replayed on restart."""
    return history.where(upto)


def schema_of(definition: str) -> dict[str, str]:
    """Spark types of a table's columns."""
    plain = {
        "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint", "REAL": "float", "FLOAT": "double", "DOUBLE": "double", "BOOLEAN": "boolean",
        "DATE": "date", "TIME": "bigint", "TIMESTAMP": "bigint", "BINARY": "binary", "VARBINARY": "binary", "BLOB": "binary",
    }
    wider = {"smallint unsigned": "int", "int2 unsigned": "int", "int unsigned": "bigint", "integer unsigned": "bigint", "bigint unsigned": "decimal(20,0)"}

    def kind(c) -> str:
        if c.type in wider:
            return wider[c.type]
        if c.jdbc in ("DECIMAL", "NUMERIC"):
            return f"decimal({min(c.length or 10, 38)},{c.scale or 0})"
        if c.jdbc == "BIT":
            return "boolean" if (c.length or 1) == 1 else "binary"
        return plain.get(c.jdbc, "string")

    return {c.name: kind(c) for c in Table.from_json(definition).columns}


def outcomes(rows: DataFrame, sql: str, db: str, table: str) -> DataFrame:
    """The rows with what a table is after each one's script: columns as ``name:type`` (``*``: it has a default), and its key.

    A script begins with an empty catalogue and is read once, however many rows have it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for script in pdf["sql"]:
                catalogue = Catalogue()
                catalogue.apply(script, db)
                made = catalogue.tables.get((db, table))
                columns = " ".join(f"{c.name}:{c.type}{'*' * (c.default is not None)}" for c in made.columns) if made else None
                out.append((script, columns, ",".join(made.key) if made else None))
            yield pd.DataFrame(out, columns=["sql", "columns", "key"])

    read = rows.select(F.col(sql).alias("sql")).where("sql is not null").distinct().mapInPandas(run, "sql string, columns string, key string")
    return rows.join(read.withColumnRenamed("sql", sql), sql, "left")
