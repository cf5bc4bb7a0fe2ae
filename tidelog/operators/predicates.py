"""Selection of databases, tables, columns, operations and statements."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# System databases.
BUILTIN_DATABASES = ("mysql", "performance_schema", "sys", "information_schema")
# Statements that are no changes of schema, and those that are let pass.
IGNORED_STATEMENTS = ("BEGIN", "END", "FLUSH PRIVILEGES")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def split_list(text: str) -> list[str]:
    r"""Items of a comma list, trimmed; ``\,`` is a comma within an item."""
    return [x for x in (part.strip().replace("\\,", ",") for part in re.split(r"(?<!\\),", text or "")) if x]


def matches_any(c: Column, patterns: str | Iterable[str]) -> Column:
    """If a value fully matches one of the patterns, in either case; null matches none."""
    items = split_list(patterns) if isinstance(patterns, str) else list(patterns)
    if not items:
        return F.lit(False)
    return F.coalesce(c.rlike(r"(?i)\A(?:" + "|".join(f"(?:{p})" for p in items) + r")\z"), F.lit(False))


def equals_any(c: Column, items: Iterable[str]) -> Column:
    """If a value is one of the items, in either case."""
    return F.coalesce(F.lower(c).isin([x.lower() for x in items]), F.lit(False))


def selected(c: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """The include list decides where there is one, else the exclude list."""
    if include:
        return matches_any(c, include)
    return ~matches_any(c, exclude) if exclude else F.lit(True)


def selected_table(
    db: Column, table: Column, db_include: str | None = None, db_exclude: str | None = None, include: str | None = None, exclude: str | None = None, builtin: bool = False
) -> Column:
    """Both levels must hold: the database by its name, the table by ``db.table``; system databases go unless builtin."""
    level = selected(db, db_include, db_exclude) & selected(F.concat_ws(".", db, table), include, exclude)
    return level if builtin else level & ~equals_any(db, BUILTIN_DATABASES)


def selected_uuids(c: Column, items: Iterable[str]) -> Column:
    """Items that are UUIDs match by equality, others as patterns."""
    items = list(items)
    literal = [x for x in items if _UUID.fullmatch(x)]
    return equals_any(c, literal) | matches_any(c, [x for x in items if x not in literal])


def in_whitelist(rows: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose table is in a list; the list is a table, read anew with each batch."""
    return rows.join(allowed.select(*on).distinct(), on, "left_semi")


def whitelist_changes(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """Tables that were added or removed between two lists."""
    old, new = before.select(*on).distinct(), after.select(*on).distinct()
    added = new.join(old, on, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new, on, "left_anti").withColumn("change", F.lit("removed")))


def without_columns(rows: DataFrame, exclude: str, table: str = "") -> DataFrame:
    """Columns less those whose name, or ``table.name``, matches a pattern; keys are not asked."""
    named = re.compile("|".join(f"(?:{p})" for p in split_list(exclude)) or r"(?!)", re.IGNORECASE)
    kept = [c for c in rows.columns if not (named.fullmatch(c) or table and named.fullmatch(f"{table}.{c}"))]
    return rows.select(*kept)


def keep_operations(rows: DataFrame, op: str = "op", skipped: Iterable[str] = ()) -> DataFrame:
    """Rows with an operation, less the skipped ones."""
    kept = F.col(op).isNotNull()
    return rows.where(kept & ~F.col(op).isin(list(skipped)) if list(skipped) else kept)


def operation_codes(names: str) -> list[int]:
    """Codes of a comma list of INSERT, DELETE and UPDATE."""
    codes: Mapping[str, int] = {"INSERT": 1, "DELETE": 2, "UPDATE": 3}
    out = []
    for name in split_list(names):
        if name.upper() not in codes:
            raise ValueError(f"{name} is no operation")
        out.append(codes[name.upper()])
    return out


def statement_class(sql: Column) -> Column:
    """BEGIN, COMMIT, ROLLBACK, XA, DML or DDL."""
    text = F.upper(F.ltrim(sql))
    return (
        F.when(text.rlike(r"^BEGIN\b"), "BEGIN")
        .when(text.rlike(r"^COMMIT\b"), "COMMIT")
        .when(text.rlike(r"^ROLLBACK\b"), "ROLLBACK")
        .when(text.rlike(r"^XA\b"), "XA")
        .when(text.rlike(r"^(INSERT|UPDATE|DELETE|REPLACE)\b"), "DML")
        .otherwise("DDL")
    )


def relevant_ddl(sql: Column, filters: str = "") -> Column:
    """If a statement is to be parsed: not ignored, and matching none of the filters."""
    return ~sql.isin(list(IGNORED_STATEMENTS)) & ~matches_any(sql, filters)
