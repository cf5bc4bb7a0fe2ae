"""Golden values and properties of the operators."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import convert, ddl, mysql, redo
from tidelog.operators import changelog, gtid, mappers, materialize, positions, predicates, registry, transactions
from tidelog.sources.changelog_source import ChangeLogSource
from tidelog.sources.config import Options, interpolate
from tidelog.sources.jdbc import chunk_query, scn_predicates, table_predicate


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_conversions(spark):
    lit = F.lit
    got = one(
        spark, u8=convert.unsigned(lit(-1), "tinyint"), u16=convert.unsigned(lit(-1), "smallint"), u24=convert.unsigned(lit(-1), "mediumint"), u32=convert.unsigned(lit(-1), "int"),
        u64=convert.unsigned(lit(-1), "bigint").cast("string"), y0=convert.year(lit(0)), y69=convert.year(lit(69)), y70=convert.year(lit(70)), y99=convert.year(lit(99)), y2024=convert.year(lit(2024)),
        e0=convert.enum(lit(0), ["a", "b"]), e2=convert.enum(lit(2), ["a", "b"]), s5=convert.enum_set(lit(5), ["a", "b", "c"]), s8=convert.enum_set(lit(8), ["a", "b", "c"]), s9=convert.enum_set(lit(9), ["a", "b", "c"]),
        t=convert.time_micros(lit("01:02:03.5")), tn=convert.time_micros(lit("-01:02:03")), th=convert.time_micros(lit("-00:30:00")), d0=convert.date(lit("2020-00-10")), d1=convert.date(lit("0000-01-01")), d2=convert.date(lit("2020-02-29")).cast("string"),
        b=F.hex(convert.padded_binary(F.unhex(lit("0102")), 4)), h=convert.binary(F.unhex(lit("AB")), "hex"), bit=convert.bits(lit(1), 1), bits=F.hex(convert.bits(lit(258), 12)),
        dt=convert.packed_datetime(lit((((2020 * 13 + 5) << 5 | 17) << 17) | (13 << 12) | (14 << 6) | 15)).cast("string"),
    )
    assert (got["u8"], got["u16"], got["u24"], got["u32"], got["u64"]) == (255, 65535, 16777215, 4294967295, "18446744073709551615")
    assert (got["y0"], got["y69"], got["y70"], got["y99"], got["y2024"]) == (2000, 2069, 1970, 1999, 2024)
    assert (got["e0"], got["e2"], got["s5"], got["s8"], got["s9"]) == ("", "b", "a,c", "", "a,")
    assert (got["t"], got["tn"], got["th"]) == (3_723_500_000, -3_723_000_000, -1_800_000_000)
    assert got["d0"] is None and got["d1"] is None and got["d2"] == "2020-02-29"
    assert (got["b"], got["h"], got["bit"], got["bits"]) == ("01020000", "ab", True, "0201")
    assert got["dt"] == "2020-05-17 13:14:15"


def test_point(spark):
    import struct

    raw = struct.pack("<I", 4326) + struct.pack("<BIdd", 1, 1, -1.5, 2.25)
    df = spark.createDataFrame([(bytearray(raw),), (bytearray(raw[:-1]),), (None,)], "raw binary")
    rows = [r[0] for r in df.select(convert.point(F.col("raw"))).collect()]
    assert rows[0].asDict() == {"srid": 4326, "x": -1.5, "y": 2.25} and rows[1] is None and rows[2] is None


def test_precise_decimals_refuse_nan(spark):
    with pytest.raises(Exception, match="no decimal"):
        spark.range(1).select(convert.decimal(F.lit(float("nan")), "precise", 10, 2)).collect()


def test_predicates(spark):
    rows = spark.createDataFrame([("DB.T1",), ("xdb.t1",), ("a,b",), (None,)], "c string")
    assert [r[0] for r in rows.select(predicates.matches_any(F.col("c"), r"db\.t.*")).collect()] == [True, False, False, False]
    assert [r[0] for r in rows.select(predicates.matches_any(F.col("c"), r"a\,b")).collect()] == [False, False, True, False]
    both = rows.select(predicates.selected(F.col("c"), r"db\..*", r".*")).collect()
    assert both[0][0] is True
    assert predicates.operation_codes("update, INSERT") == [3, 1]
    with pytest.raises(ValueError):
        predicates.operation_codes("MERGE")


def test_masking(spark):
    rows = spark.createDataFrame([(1, "abcdef"), (2, None)], "k int, v string")
    assert [r.v for r in mappers.apply(rows, [("v", mappers.mask(4))]).collect()] == ["****", "****"]
    assert [r.v for r in mappers.apply(rows, [("v", mappers.truncate(3))]).collect()] == ["abc", None]
    assert mappers.with_source_types(rows, {"v": "VARCHAR"}).schema["v"].metadata == {"source_type": "VARCHAR"}


def test_key_change_records(spark):
    rows = spark.createDataFrame([(1, None, 5, None, "a"), (2, 5, 5, "a", "b"), (3, 5, 6, "b", "c"), (4, 6, None, "c", None)], "p int, old int, new int, b string, a string")
    got = [(r.p, r.ordinal, r.key, r.op, r.before, r.after) for r in changelog.expand_key_changes(rows, "old", "new", "b", "a").orderBy("p", "ordinal").collect()]
    assert got == [(1, 0, 5, "c", None, "a"), (2, 0, 5, "u", "a", "b"), (3, 0, 5, "d", "b", None), (3, 1, 5, "t", None, None), (3, 2, 6, "c", None, "c"), (4, 0, 6, "d", "c", None), (4, 1, 6, "t", None, None)]


sets = st.dictionaries(st.sampled_from("uvw"), st.sets(st.integers(1, 30), min_size=1), max_size=3)


def text_of(d):
    return ",".join(f"{k}:" + ":".join(f"{x}-{x}" if x % 2 else str(x) for x in v) for k, v in sorted(d.items()))


def points(text):
    out = set()
    for part in filter(None, (text or "").split(",")):
        k, *spans = part.split(":")
        for s in spans:
            lo, _, hi = s.partition("-")
            out |= {(k, n) for n in range(int(lo), int(hi or lo) + 1)}
    return out


def test_gtid_algebra_equals_sets(spark):
    pairs = []

    @settings(max_examples=60, deadline=None, database=None)
    @given(sets, sets)
    def draw(a, b):
        pairs.append((text_of(a), text_of(b)))

    draw()
    a, b = gtid.parse(F.col("a")), gtid.parse(F.col("b"))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", gtid.render(a).alias("n"), gtid.render(gtid.subtract(a, b)).alias("s"), gtid.contained_within(a, b).alias("c"), gtid.render(gtid.with_(a, b)).alias("w"))
    for r in rows.collect():
        pa_, pb = points(r.a), points(r.b)
        assert points(r.n) == pa_ and points(r.s) == pa_ - pb and r.c == (pa_ <= pb)
        assert points(r.w) == {x for x in pa_ if x[0] not in {y[0] for y in pb}} | pb


def test_gtid_fixed_sets_equal_parsed_ones(spark):
    texts = ["", "u:1-3", "u:5:1-3:4, v:7\t", "u:9-12:2-3:1:14", "u:1,v:2,u:3-4", "u", "w:1-9:3-5:20-30:11", "a:1,,b:2-2"]
    for t in texts:
        got = one(spark, a=gtid.fixed(t), b=gtid.parse(F.lit(t)), c=gtid.render(gtid.fixed(t)), d=gtid.render(gtid.parse(F.lit(t))))
        assert got["a"] == got["b"] and got["c"] == got["d"], t
        assert list(got["a"]) == list(got["b"])
    assert one(spark, a=gtid.parse(F.lit(None).cast("string")))["a"] is None
    assert one(spark, a=gtid.with_(gtid.fixed("u:1"), gtid.parse(F.lit(None).cast("string"))))["a"] is None


def test_gtid_algebra_reads_a_text_once(spark):
    """However often an expression names a set, and in whatever lambda, its text is split once a row; constants are not split."""
    row = spark.createDataFrame([("u:1-3", "u:2,v:4")], "a string, b string")
    a, b = gtid.parse(F.col("a")), gtid.parse(F.col("b"))
    splits = lambda *made: row.select(*(x.alias(f"c{i}") for i, x in enumerate(made)))._jdf.queryExecution().analyzed().toString().count("split(")
    each = splits(a)
    assert each
    assert splits(gtid.with_(a, b)) == splits(gtid.contained_within(a, b)) == splits(gtid.subtract(a, b)) == 2 * each
    assert splits(gtid.with_(gtid.fixed("u:1"), b)) == each == splits(gtid.beginning(a))
    from tidelog.plans import catalogue

    made = catalogue.queries()["gtid_algebra"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == each


def test_gtid_goldens(spark):
    p, r = gtid.parse, gtid.render
    got = one(spark, a=r(p(F.lit("u:1-3:4-6"))), b=r(p(F.lit("u:5"))), c=r(gtid.subtract(p(F.lit("u:1-10")), p(F.lit("u:3-4")))), d=r(gtid.beginning(p(F.lit("u:4-9:12")))), e=r(gtid.retain(p(F.lit("u:1,v:2")), ["v"])))
    assert got == {"a": "u:1-6", "b": "u:5-5", "c": "u:1-2:5-10", "d": "u:4-4", "e": "v:2-2"}


def test_positions(spark):
    z = F.lit(0)
    at = lambda f, p: positions.ordering(F.lit(f), F.lit(p), z, z)
    big = 1 << 40
    got = one(spark, a=positions.at_or_before(at("b1", big), at("B1", big + 1)), b=positions.at_or_before(at("b2", 1), at("b1", 9)), c=positions.at_or_before(at("b1", 1), at("b1", 1)), d=positions.at_or_before(at("b9", 1), at("b1", 1), F.lit("u:1-3"), F.lit("u:1-5")), e=positions.at_or_before(at("b1", 1), at("b2", 1), F.lit("u:1"), F.lit(None).cast("string")))
    assert got == {"a": True, "b": False, "c": True, "d": True, "e": False}


def test_stitch_and_savepoints(spark):
    rows = spark.createDataFrame([(0, 1, True, "a"), (0, 2, True, "b"), (0, 3, False, "c"), (0, 4, False, "d")], "t int, o int, csf boolean, s string")
    assert [r.text for r in transactions.stitch(rows, ["t"], "o", "csf", "s").orderBy("start").collect()] == ["abc", "d"]
    log = spark.createDataFrame([("x", 1, "INSERT", False), ("x", 2, "UPDATE", False), ("x", 3, "UPDATE", True), ("x", 4, "INSERT", False), ("x", 5, "DELETE", True)], "k string, scn int, op string, undo boolean")
    assert sorted(r.scn for r in transactions.cancel_savepoints(log, ["k"], "scn", "op", "undo").collect()) == [1]


def test_large_objects_join_their_row(spark):
    changes = spark.createDataFrame([("x", {"id": "1", "note": None}), ("y", {"id": "2"}), ("z", None)], "k string, after map<string,string>")
    lobs = spark.createDataFrame([("x", "note", "long"), ("x", "body", "b"), ("z", "note", "n")], "k string, c string, t string")
    got = {r.k: r.after for r in transactions.merge_lobs(changes, lobs, ["k"], "c", "t").collect()}
    assert got == {"x": {"id": "1", "note": "long", "body": "b"}, "y": {"id": "2"}, "z": {"note": "n"}}


def test_merge_twice_changes_nothing(spark):
    changes = spark.createDataFrame([(1, 1, "c", 10), (2, 1, "u", 11), (3, 2, "c", 5), (4, 2, "d", None)], "p int, k int, op string, v int")
    state = materialize.latest_state(changes, ["k"], "p", "op", ["v"])
    again = materialize.merge_changes(state, changes, ["k"], "p", "op", ["v"])
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, again.collect())) == [(1, 2, 11)]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.text("abC\"' ,()", min_size=1, max_size=6), st.one_of(st.none(), st.text(max_size=12)), min_size=1, max_size=4))
def test_redo_render_and_parse(row):
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    name = lambda n: '"' + n.replace('"', '""') + '"'
    sql = f'insert into "S"."T"({",".join(map(name, row))}) values ({",".join(map(quote, row.values()))});'
    assert redo.parse(sql)["after"] == row
    where = " and ".join(f"{name(k)} IS NULL" if v is None else f"{name(k)} = {quote(v)}" for k, v in row.items())
    assert redo.parse(f'delete from "S"."T" where {where}')["before"] == row


def test_redo_oddities():
    assert redo.parse("update T set A = TIMESTAMP '2020-01-01 00:00:00', B = HEXTORAW('0A') where C = 1")["after"] == {"A": "2020-01-01 00:00:00", "B": "HEXTORAW('0A')", "C": "1"}
    assert redo.try_parse("select 1") == {} and redo.try_parse(None) == {}


DDL = [
    ("CREATE TABLE `a``b`.t (id SERIAL, n VARCHAR(20) CHARACTER SET latin1 NOT NULL DEFAULT 'x,''y', e ENUM('a','b,c'), d DECIMAL, UNIQUE KEY u (n)) DEFAULT CHARSET=utf8mb4", ["id", "n", "e", "d"]),
    ("ALTER TABLE `a``b`.t ADD COLUMN x INT UNSIGNED FIRST, ADD (y INT, z TEXT), DROP COLUMN d", ["x", "id", "n", "e", "y", "z"]),
    ("ALTER TABLE `a``b`.t CHANGE COLUMN e f SET('p','q') AFTER x, MODIFY y BIGINT FIRST", ["y", "x", "f", "id", "n", "z"]),
    ("/* c */ ALTER TABLE `a``b`.t RENAME COLUMN z TO w, ALTER COLUMN y SET DEFAULT 5 -- end", ["y", "x", "f", "id", "n", "w"]),
]


def test_ddl():
    c = ddl.Catalogue()
    for sql, columns in DDL:
        assert c.apply(sql, "a`b")[0].kind in ("create_table", "alter_table"), sql
        t = c.tables["a`b", "t"]
        assert [x.name for x in t.columns] == columns
    by_name = {x.name: x for x in t.columns}
    assert t.key == ("id",) or t.key == ("n",)
    assert by_name["f"].options == ("p", "q") and by_name["n"].default == "x,'y" and by_name["n"].charset == "latin1" and by_name["y"].default == "5"
    assert by_name["id"].type == "bigint unsigned" and by_name["id"].auto and not by_name["id"].optional
    assert ddl.Table.from_json(t.as_json()) == t
    assert registry.schema_of(t.as_json())["x"] == "bigint"
    assert c.apply("CREATE TABLE u LIKE t", "a`b")[0].kind == "create_table" and len(c.tables["a`b", "u"].columns) == 6
    assert [e.kind for e in c.apply("RENAME TABLE u TO v, t TO s; DROP TABLE IF EXISTS v, s")] == ["rename_table", "rename_table", "drop_table", "drop_table"]
    assert not c.tables
    assert c.apply("CREATE TABLE broken (id NOTATYPE)")[0].kind == "unparsed"
    c.apply("SET GLOBAL Charset_X = 5, NAMES utf8")
    assert c.variable("CHARSET_X") == "5"
    assert [e.kind for e in c.apply("CREATE OR REPLACE VIEW w AS SELECT 1; TRUNCATE t; USE other")] == ["create_view", "truncate_table", "use_database"] and c.db == "other"


def test_options():
    o = Options.from_properties({"log.server.name": "${n:x}", "log.max.batch.size": "10", "log.ignore.builtin": "false"}, "log.")
    assert (o.server_name, o.max_batch_size, o.ignore_builtin) == ("x", 10, False)
    for bad in ({"server.name": ""}, {"server.name": "a", "max.queue.size": "1"}, {"server.name": "a", "gtid.include": "x", "gtid.exclude": "y"}, {"server.name": "a", "odd": "1"}, {"server.name": "a", "binary.mode": "z"}):
        with pytest.raises(ValueError):
            Options.from_properties(bad)
    assert interpolate("${a}-${b:1}-${c}", {"a": "x"}) == "x-1-${c}"


def test_jdbc_texts():
    assert scn_predicates(0, 25_000)[-1] == "SCN >= 20000 AND SCN < 25000"
    assert table_predicate(["S.T", "p.S.*"]) == "(SEG_OWNER = 'S' AND TABLE_NAME = 'T') OR (SRC_CON_NAME = 'p' AND SEG_OWNER = 'S')"
    with pytest.raises(ValueError):
        table_predicate(["*.T"])
    assert chunk_query("t", ["a"], "k", 5, 10) == "SELECT a FROM t WHERE k > '5' ORDER BY k LIMIT 10"


def test_changelog_source(spark, tmp_path):
    from tidelog.streaming.assembler import run_available

    spark.dataSource.register(ChangeLogSource)
    for i in range(3):
        (tmp_path / f"f{i}.jsonl").write_text("".join(json.dumps({"file": f"f{i}", "pos": j, "op": "c", "after": {"v": j}}) + "\n" for j in range(4)))
    rows = spark.read.format("changelog").load(str(tmp_path))
    assert rows.count() == 12 and rows.where("pos = 2").first().after == '{"v": 2}'
    stream = spark.readStream.format("changelog").option("maxFilesPerTrigger", "2").load(str(tmp_path))
    run_available(stream.select("file", "pos"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    (tmp_path / "f3.jsonl").write_text('{"file": "f3", "pos": 0}\nnot json\n')
    with pytest.raises(Exception, match="no JSON object"):
        spark.read.format("changelog").load(str(tmp_path)).collect()
    assert spark.read.format("changelog").option("failOnError", "false").load(str(tmp_path)).count() == 13


def test_mysql_functions(spark):
    lit = F.lit
    got = one(spark, a=mysql.insert(lit("Quadratic"), 3, 4, "What"), b=mysql.strcmp(lit("a"), lit("b")), c=mysql.period_diff(lit(202103), lit(202012)), d=mysql.sec_to_time(lit(-3661)), e=mysql.time_to_sec(lit("-01:01:01")), f=mysql.quote(lit("it's")), g=mysql.oct_(lit(8)), h=mysql.inet_aton(lit("1.2.3")), i=mysql.avro_name(lit("9a-b")), j=mysql.from_days(lit(719529)).cast("string"), k=mysql.as_number(lit("x")))
    assert got == {"a": "QuWhattic", "b": -1, "c": 3, "d": "-01:01:01", "e": -3661, "f": "'it\\'s'", "g": "10", "h": None, "i": "_9a_b", "j": "1970-01-02", "k": None}


def test_view_columns():
    c = ddl.Catalogue()
    c.apply("CREATE TABLE a (x INT, y INT); CREATE TABLE b (y INT, z INT)", "d")
    assert c.view_columns("CREATE VIEW v AS SELECT * FROM a") == [("x", "a", "x"), ("y", "a", "y")]
    assert c.view_columns("CREATE VIEW v AS SELECT p.x AS k, q.*, z, count(q.z) n FROM a p LEFT JOIN b AS q ON p.y = q.y WHERE 1") == [("k", "a", "x"), ("y", "b", "y"), ("z", "b", "z"), ("z", "b", "z"), ("n", None, None)]


def test_start_sets_and_preflight(spark):
    p = gtid.parse
    got = one(spark, a=gtid.render(gtid.start_set(p(F.lit("u:1-3")), p(F.lit("u:1-9,v:1-2,w:5")), ["u", "v"])), b=positions.context(F.lit("f"), F.lit(4)))
    assert got == {"a": "u:1-3,v:1-2", "b": "file=f,pos=4"}
    from tidelog.sources.config import preflight

    preflight({"binlog_format": "row"})
    for bad in ({}, {"binlog_format": "ROW", "binlog_row_image": "minimal"}):
        with pytest.raises(ValueError):
            preflight(bad)


def test_tracked_ids(spark):
    rows = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, 2), (0, 5, 3)], "s int, o int, n int")
    got = positions.tracked_ids(rows, ["s"], "o", "n").orderBy("o").collect()
    assert [(r.seen, r.restart_seen) for r in got] == [(1, None), (1, None), (2, 1), (2, 1), (3, 2)]


def test_aes_and_points(spark):
    point = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    got = one(spark, back=mysql.aes_decrypt(mysql.aes_encrypt(F.lit("text"), b"a key that is longer than 16"), b"a key that is longer than 16").cast("string"), text=mysql.st_as_text(point), d=mysql.st_distance(point, F.struct(F.lit(4.0).alias("x"), F.lit(6.0).alias("y"))))
    assert got == {"back": "text", "text": "POINT(1.0 2.0)", "d": 5.0}
    assert mysql.aes_key(b"0123456789abcdef0") == bytes([0]) + b"123456789abcdef"


def test_changelog_offsets_are_names(spark, tmp_path):
    from tidelog.sources.changelog_source import SCHEMA, ChangeLogStreamReader
    from pyspark.sql.types import _parse_datatype_string

    for n in ("b", "d", "f"):
        (tmp_path / f"{n}.jsonl").write_text("{}\n")
    reader = ChangeLogStreamReader(_parse_datatype_string(SCHEMA), {"path": str(tmp_path), "maxFilesPerTrigger": "1"})
    first = reader.latestOffset()
    assert [p.path.rsplit("/", 1)[-1] for p in reader.partitions(reader.initialOffset(), first)] == ["b.jsonl", "d.jsonl", "f.jsonl"]
    for n in ("a", "g", "h"):
        (tmp_path / f"{n}.jsonl").write_text("{}\n")
    second = reader.latestOffset()
    third = reader.latestOffset()
    assert [[p.path.rsplit("/", 1)[-1] for p in reader.partitions(*x)] for x in ((first, second), (second, third))] == [["g.jsonl"], ["h.jsonl"]]


def test_character_types():
    c = ddl.Catalogue()
    c.apply("CREATE TABLE t (a CHARACTER(3), b CHARACTER VARYING(20), c NATIONAL CHARACTER VARYING(5), d CHAR VARYING(7), e VARCHAR(9), f DOUBLE PRECISION)", "d")
    (table,) = c.tables.values()
    assert [(x.name, x.type, x.length) for x in table.columns] == [("a", "char", 3), ("b", "varchar", 20), ("c", "varchar", 5), ("d", "varchar", 7), ("e", "varchar", 9), ("f", "double", None)]


def test_predicates_are_quoted_and_bounded():
    from tidelog.sources import jdbc

    assert jdbc.table_predicate(["O'X.T'; DROP"]) == "(SEG_OWNER = 'O''X' AND TABLE_NAME = 'T''; DROP')"
    windows = jdbc.scn_predicates(0, 10**12)
    assert len(windows) <= jdbc.MAX_PARTITIONS and windows[0].startswith("SCN >= 0 ") and windows[-1].endswith(f"SCN < {10**12}")
    assert jdbc.scn_predicates(5, 25, 10) == ["SCN >= 5 AND SCN < 15", "SCN >= 15 AND SCN < 25"]


def test_a_missing_version_is_an_error(spark, tmp_path):
    import shutil

    from tidelog.streaming.assembler import materialize_batches

    def batch(n, rows):
        spark.createDataFrame(rows, "op string, k long, pos long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("op string, k long, pos long, v string").parquet(f"{tmp_path}/in")
        materialize_batches(stream, f"{tmp_path}/state", f"{tmp_path}/cp", ["k"], "pos", ["v"]).awaitTermination()

    for n in range(3):
        batch(n, [("c", n, n, f"v{n}")])
    assert spark.read.parquet(f"{tmp_path}/state/version=2").count() == 3
    assert not (tmp_path / "state" / "version=0").exists()
    shutil.rmtree(tmp_path / "state" / "version=2")
    with pytest.raises(Exception, match="the state before batch"):
        batch(3, [("c", 9, 9, "x")])


@pytest.mark.parametrize("chunk", [3, 1 << 18])
def test_chunks_equal_windows(spark, chunk):
    from pyspark.sql import Window
    from tidelog.operators import chunks

    rows = spark.createDataFrame([(None if i % 5 == 0 else "hot" if i % 3 else "k", i * i % 101, i % 4 if i % 7 else None) for i in range(101) if i * i % 101 == i * i % 101][:51], "k string, p long, v long").dropDuplicates(["k", "p"])
    line = Window.partitionBy("k").orderBy("p")
    expected = {(r.k, r.p): (r.a, r.b) for r in rows.select("k", "p", F.lag("v").over(line).alias("a"), F.coalesce(F.sum("v").over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("b")).collect()}
    one = chunks.previous(rows, ["k"], "p", F.col("v"), "a", chunk).collect()
    two = chunks.running_sum(rows, ["k"], "p", F.col("v"), "b", chunk).collect()
    assert {(r.k, r.p): r.a for r in one} == {x: y[0] for x, y in expected.items()}
    assert {(r.k, r.p): r.b for r in two} == {x: y[1] for x, y in expected.items()}


def test_binlog_values():
    from tidelog.functions import binlog as b

    def value(raw, kind, meta=b""):
        cursor = b._Bytes(raw)
        got = b._value(cursor, kind, meta)
        assert cursor.at == len(raw)
        return got

    assert value(b"\xff\xff\xff", b.INT24) == -1 and value(b"\xfe", b.TINY) == -2
    assert value(bytes.fromhex("810dfb38d204d2"), b.NEWDECIMAL, bytes((14, 4))) == "1234567890.1234"
    assert value(bytes.fromhex("7ef204c72dfb2d"), b.NEWDECIMAL, bytes((14, 4))) == "-1234567890.1234"
    assert value((2024 << 9 | 2 << 5 | 30).to_bytes(3, "little"), b.DATE) == "2024-02-30" and value(b"\x7c", b.YEAR) == 2024 and value(b"\0", b.YEAR) == 0
    assert value((0x800000 | 12 << 12 | 34 << 6 | 56).to_bytes(3, "big"), b.TIME2, b"\0") == "12:34:56"
    assert value(((0x800000 << 16) - ((1 << 12 | 1 << 6 | 1) << 16 | 5000)).to_bytes(5, "big"), b.TIME2, b"\4") == "-01:01:01.5000"
    assert value(b"\5\0hello", b.VARCHAR, (300).to_bytes(2, "little")) == "hello" and value(b"\3abc", b.STRING, bytes((254, 10))) == "abc"
    assert value(b"\2", b.STRING, bytes((b.ENUM, 1))) == 2 and value(b"\2\0\xab\xcd", b.BLOB, b"\2") == "ABCD" and value(b"\1\3", b.BIT, bytes((1, 1))) == 259
    assert value((20240131123456).to_bytes(8, "little"), b.DATETIME) == "2024-01-31 12:34:56"
    with pytest.raises(ValueError, match="ends within a value"):
        value(b"\1", b.LONG)


def test_binlog_columns_read_as_values():
    """What reads a table's columns gives the values and places that reading value by value gives, and stops where an event ends."""
    import random

    from tidelog.functions import binlog as b

    r = random.Random(3)
    number = lambda digits: r.randrange(10**digits).to_bytes(b._REST[digits] if digits < 9 else 4, "big")
    for _ in range(300):
        whole = bytearray(number(3) + number(9) + number(9) + number(1))
        whole[0] ^= 0x80
        whole = bytes(x ^ 0xFF for x in whole) if r.random() < 0.5 else bytes(whole)
        cells = [
            (b.TINY, b"", r.randbytes(1)), (b.SHORT, b"", r.randbytes(2)), (b.INT24, b"", r.randbytes(3)), (b.LONG, b"", r.randbytes(4)), (b.LONGLONG, b"", r.randbytes(8)), (b.VARCHAR, b"\x50\0", b"\3a\xc3\xa9"),
            (b.VARCHAR, b"\x2c\1", b"\2\0xy"), (b.STRING, bytes((b.ENUM, 2)), r.randbytes(2)), (b.SET, b"\0\3", r.randbytes(3)), (b.DATETIME2, b"\0", r.randbytes(5)), (b.DATETIME2, b"\5", b"\x99" + r.randbytes(7)),
            (b.NEWDECIMAL, bytes((22, 10)), whole), (b.DATE, b"", r.randbytes(3)), (b.BLOB, b"\1", b"\2\1\2"), (b.DOUBLE, b"\10", b"\0" * 6 + b"\xf8\x3f"),
        ]
        r.shuffle(cells)
        raw = b"".join(c[2] for c in cells)
        readers = b._readers(bytes(c[0] for c in cells), tuple(c[1] for c in cells))
        at, slow = 0, b._Bytes(raw)
        for (kind, meta, _), read in zip(cells, readers):
            got, at = read(raw, at)
            assert got == b._value(slow, kind, meta) and at == slow.at
        with pytest.raises(ValueError, match="ends within a value"):
            b._image(bytes(2) + raw[:-1], 0, list(enumerate(readers)), len(cells))


def test_binlog_rows_leave_in_batches(tmp_path, monkeypatch):
    """Rows go to Spark as columns, a bounded number at once."""
    import json

    import pandas as pd
    import pyarrow as pa

    from tidelog.plans.logs import log_file
    from tidelog.sources import binlog_source

    n = 200
    rows = pd.DataFrame({"event_id": range(n), "user_id": 1, "event_type": "x", "value": [None if i % 7 == 0 else i / 3 for i in range(n)], "ts": pd.Timestamp("2024-02-29 23:59:58.000123"), "cents": [-i * 7 for i in range(n)], "kind": [i % 3 + 1 for i in range(n)]})
    (tmp_path / "bin.000001").write_bytes(log_file(rows))
    monkeypatch.setattr(binlog_source, "AT_ONCE", 4000, raising=False)
    found = list(binlog_source._Logs({"path": str(tmp_path)}).rows(str(tmp_path / "bin.000001")))
    assert all(isinstance(x, pa.RecordBatch) for x in found) and len(found) > 5 and max(x.num_rows for x in found) < 60
    made = [json.loads(r["after"]) for x in found for r in x.to_pylist() if r["op"] == "c"]
    assert made == [[i, 1, "x", None if i % 7 == 0 else i / 3, "2024-02-29 23:59:58.000123", f"{'-' * (i > 0)}{i * 7 / 1e4:.4f}", i % 3 + 1] for i in range(n)]


def test_binlog_source_stream_and_broken_files(spark, tmp_path):
    import datetime

    import pandas as pd
    from tidelog.plans.logs import log_file
    from tidelog.sources.binlog_source import BinlogSource
    from tidelog.streaming.assembler import run_available

    spark.dataSource.register(BinlogSource)
    rows = pd.DataFrame({"event_id": range(20), "user_id": 1, "event_type": "x", "value": 1.5, "ts": pd.Timestamp(datetime.datetime(2024, 1, 1)), "cents": -15, "kind": 1})
    raw = log_file(rows)
    for n in (1, 2, 3):
        (tmp_path / f"bin.{n:06d}").write_bytes(raw if n < 3 else raw[:-10])
    (tmp_path / "bin.index").write_text("bin.000001\n")
    everything = spark.read.format("binlog").load(str(tmp_path))
    assert everything.where("op = 'c'").count() == 60 and everything.where("op = 'k'").count() == 5
    assert everything.where("op = 'c'").first().after == '[0, 1, "x", 1.5, "2024-01-01 00:00:00.000000", "-0.0015", 1]'
    assert spark.read.format("binlog").option("db", "other").load(str(tmp_path)).where("op = 'c'").count() == 0
    stream = spark.readStream.format("binlog").load(str(tmp_path))
    run_available(stream.where("op = 'c'").select("file", "row"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    (tmp_path / "bin.000004").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no binary log"):
        spark.read.format("binlog").load(str(tmp_path)).collect()


def test_redo_session_block():
    from tidelog.sources.jdbc import session_block

    block = session_block(["/a/redo1", "/a/o'x"], 5, 9, "CDB$ROOT")
    assert "DBMS_LOGMNR.ADD_LOGFILE('/a/redo1', DBMS_LOGMNR.NEW);" in block and "ADD_LOGFILE('/a/o''x', DBMS_LOGMNR.ADDFILE);" in block
    assert 'SET CONTAINER = "CDB$ROOT"' in block and "STARTSCN => 5, ENDSCN => 9" in block and block.startswith("BEGIN ") and block.endswith("END;")
    with pytest.raises(ValueError):
        session_block([], 5, 9)
