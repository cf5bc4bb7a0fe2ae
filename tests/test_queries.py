"""Every registered query of the engine against its DuckDB SQL."""

import math

import duckdb
import pytest

from tidelog.plans import catalogue
from tidelog.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(float(v) if isinstance(v, int) else v for v in (plain(r[i]) for i in order))) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    assert sql, f"{name} has no SQL"
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(found.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12


def test_llm_is_optional():
    """Nothing outside the subpackage and the entry imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for path in [*root.glob("tidelog/**/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "tidelog.llm" not in path.read_text() and "from .llm" not in path.read_text() and "from ..llm" not in path.read_text(), path
