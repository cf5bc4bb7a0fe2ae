"""Masking and truncation of columns; keys are left as they are."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import split_list

Mapper = Callable[[Column], Column]


def truncate(length: int) -> Mapper:
    """The first length characters."""
    return lambda c: F.substring(c, 1, length)


def mask(length: int) -> Mapper:
    """As many asterisks, for any value and for null."""
    return lambda c: F.lit("*" * length)


def hashed(salt: str, bits: int = 256) -> Mapper:
    """The hex digest of salt and value; null stays null."""
    return lambda c: F.sha2(F.concat(F.lit(salt), c), bits)


def chain(*mappers: Mapper) -> Mapper:
    """Mappers one after the other."""

    def run(c: Column) -> Column:
        for m in mappers:
            c = m(c)
        return c

    return run


def apply(rows: DataFrame, rules: Sequence[tuple[str, Mapper]], keys: Sequence[str] = (), table: str = "") -> DataFrame:
    """Text columns mapped by the first rule whose patterns match their name or ``table.name``."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType) and f.name not in keys:
            for patterns, mapper in rules:
                named = re.compile("|".join(f"(?:{p})" for p in split_list(patterns)), re.IGNORECASE)
                if named.fullmatch(f.name) or table and named.fullmatch(f"{table}.{f.name}"):
                    c = mapper(c).alias(f.name)
                    break
        out.append(c)
    return rows.select(*out)


def with_source_types(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns with their source type as metadata."""
    return rows.select(*(F.col(c).alias(c, metadata=rows.schema[c].metadata | {"source_type": types[c]}) if c in types else F.col(c) for c in rows.columns))
