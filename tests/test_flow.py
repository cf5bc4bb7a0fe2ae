"""History files, counters, failure modes and retries."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import convert
from tidelog.operators import materialize, registry
from tidelog.sources import history
from tidelog.streaming import assembler, flow


def test_history_round_trip(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [("s", 1, "d", "CREATE TABLE t (id INT PRIMARY KEY)"), ("s", 5, "d", "ALTER TABLE t ADD COLUMN v TEXT"), ("s", 9, "d", "DROP TABLE t"), ("o", 2, "d", "nonsense (")]
    history.append_history(spark.createDataFrame(rows[:2], history.HISTORY), path)
    history.append_history(spark.createDataFrame(rows[2:], history.HISTORY), path)
    (tmp_path / "history" / "bad.json").write_text("not json\n")
    assert history.read_history(spark, path).count() == 4
    got = registry.replay(history.read_history(spark, path, "s", 5), ["server"], "position", "sql", "db").orderBy("position").collect()
    assert [(r.position, r.kind, r.columns) for r in got] == [(1, "create_table", 1), (5, "alter_table", 2)]
    messages = history.schema_change_messages(spark.createDataFrame(got)).collect()
    assert messages[0].key == "d" and '"kind":"create_table"' in messages[0].value
    assert history.key_columns("d.T", ["id"], {r"d\.t": ["a", "b"]}) == ["a", "b"]


def test_retries():
    calls, slept = [], []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "done"

    assert flow.retried(action, flow.delays(100, 2.0, 150), slept.append) == "done" and slept == [0.1, 0.15]
    with pytest.raises(OSError):
        flow.retried(lambda: (_ for _ in ()).throw(OSError()), flow.delays(tries=1), slept.append)
    assert flow.clamp(10, 100, 20) == 30 and flow.clamp(10, 15, 20) == 15


def test_failure_modes(spark):
    rows = spark.createDataFrame([("1",), ("x",)], "v string")
    made = F.col("v").try_cast("int")
    bad = made.isNull()
    assert [(r.n, r._error is None) for r in flow.on_failure(rows, made, "n", bad, "warn").collect()] == [(1, True), (None, False)]
    assert flow.on_failure(rows, made, "n", bad, "skip").count() == 1
    assert flow.on_failure(rows, made, "n", bad, "ignore").count() == 2
    with pytest.raises(Exception, match="cannot be converted"):
        flow.on_failure(rows, made, "n", bad, "fail").collect()


def test_counters(spark):
    changes = spark.createDataFrame([(1, "c"), (2, "u"), (3, "u"), (4, "d")], "position long, op string")
    df, seen = flow.counted(changes)
    df.collect()
    assert seen.get == {"rows": 4, "op_r": 0, "op_c": 1, "op_u": 2, "op_d": 1, "last_position": 4}


def test_packed_time(spark):
    df = spark.createDataFrame([(0x800000 + (1 << 12) + (2 << 6) + 3,), (0x800000 - ((1 << 12) + (2 << 6) + 3),)], "v long")
    assert [r[0] for r in df.select(convert.packed_time(F.col("v"))).collect()] == [3_723_000_000, -3_723_000_000]


def test_stream_of_changes_into_state(spark, tmp_path):
    """Batches in files, a restart between them, and the same state as all at once."""
    rows = [(i, i % 7, "d" if i % 11 == 0 else "u", i * 10) for i in range(1, 60)]
    kind = "position long, k int, op string, v int"
    source, out = str(tmp_path / "in"), str(tmp_path / "state")
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        assembler.materialize_batches(stream, out, str(tmp_path / "cp"), ["k"], "position", ["v"]).awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir() if p.name.startswith("version="))
    state = sorted(map(tuple, spark.read.parquet(f"{out}/version={last}").collect()))
    assert state == sorted(map(tuple, materialize.latest_state(spark.createDataFrame(rows, kind), ["k"], "position", "op", ["v"]).collect()))


def _histories(seed=5):
    """Statements of two servers: tables made, changed, copied, renamed and dropped in two databases, some rows without a database."""
    import random

    r, rows = random.Random(seed), []
    for server in ("s", "t"):
        for at in range(400):
            t, u = r.choice("tuv"), r.choice("tuv")
            kinds = [
                f"CREATE TABLE {t} (a INT, b INT)", f"ALTER TABLE `{t}` ADD COLUMN c{at} INT COMMENT 'x, (y)'", f"ALTER TABLE {t} ADD d{at} INT, DROP COLUMN b", f"ALTER TABLE d.{t} ADD e{at} INT", f"DROP TABLE IF EXISTS {t}", f"drop table d . `{t}`;",
                f"CREATE TABLE {t} LIKE {u}", f"CREATE TABLE {t} ( LIKE {u})", f"ALTER TABLE {t} RENAME TO {u}x", f"RENAME TABLE {t} TO {u}", f"DROP TABLE {t}, {u}", f"DROP TABLE {t}; CREATE TABLE {u} (z INT)", "USE e", "DROP DATABASE e", f"TRUNCATE TABLE {t}",
                f"DROP TABLE /* {u} */ {t}", f"ALTER TABLE {t} ADD", "CREATE DATABASE e CHARSET latin1", f"CREATE TABLE {t} (g CHAR(3))",
            ]
            # mostly statements that touch one table
            rows.append((server, at * 9, r.choice(kinds[:6] if r.random() < 0.9 else kinds), r.choice(["d"] * 20 + ["e", None])))
    return rows


def test_replay_in_parts_equals_order(spark):
    from tidelog.functions.ddl import Catalogue

    rows, expected = _histories(), []
    for server in ("s", "t"):
        catalogue = Catalogue()
        for _, at, sql, db in (r for r in rows if r[0] == server):
            for e in catalogue.apply(sql, db):
                table = catalogue.tables.get((e.db, e.table))
                expected.append((server, at, e.db, e.table, e.kind, len(table.columns) if table else 0, table.as_json() if table else None))
    history = spark.createDataFrame(rows, "server string, position long, sql string, db string").repartition(3)
    span, registry.SPAN = registry.SPAN, 64
    try:
        out = registry.replay(history, ["server"], "position", "sql", "db", part=20)
    finally:
        registry.SPAN = span
    got = [tuple(r) for r in out.collect()]
    key = lambda r: repr(r)
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_replay_holds_a_batch_and_no_history(spark):
    """One server's rows are cut into parts, come batch by batch, and leave before the next batch is read."""
    import pyarrow as pa

    history = spark.range(40_000).selectExpr("0 as server", "id as position", "concat('ALTER TABLE t ADD c', id, ' INT') as sql", "'d' as db")
    parts = registry._parts(history, ["server"], 10_000).groupBy("_part").count().collect()
    assert len(parts) > 3 and max(r["count"] for r in parts) < 20_000
    names = ["server", "_part", "position", "sql", "db", "_state"]
    read = []

    def batches():
        for i in range(3):
            read.append(i)
            yield pa.RecordBatch.from_pylist([{"server": 0, "_part": 0, "position": i, "sql": f"DROP TABLE t{i}", "db": "d", "_state": None}], pa.schema(list(zip(names, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())))))

    first = next(registry._replayed(batches(), 1, False))
    assert read == [0] and first.to_pylist() == [{"server": 0, "position": 0, "db": "d", "table": "t0", "kind": "drop_table", "columns": 0, "definition": None}]
    dropped = registry._mattering((b.select(names[:-1]) for b in batches()), 1)
    assert [b.num_rows for b in dropped] == [3]
