"""Snapshots and redo rows over JDBC, cut into partitions by predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.predicates import operation_codes


#: Partitions of a scan at most: windows grow beyond that.
MAX_PARTITIONS = 4096


def text_literal(value: object) -> str:
    """A value as a text literal of SQL."""
    return "'" + str(value).replace("'", "''") + "'"


def scn_predicates(start: int, end: int, window: int = 10_000) -> list[str]:
    """Half-open windows of change numbers, one for each partition, at most MAX_PARTITIONS."""
    window = max(window, -(-(end - start) // MAX_PARTITIONS))
    return [f"SCN >= {a} AND SCN < {min(a + window, end)}" for a in range(start, end, window)]


def table_predicate(tables: list[str]) -> str:
    """Tables as ``schema.table``, ``schema.*`` or ``pdb.schema.table``; a schema of ``*`` is refused."""
    parts = []
    for name in tables:
        *pdb, owner, table = name.split(".")
        if owner == "*":
            raise ValueError(f"{name}: a schema must be named")
        own = [f"SRC_CON_NAME = {text_literal(pdb[0])}"] if pdb else []
        own += [f"SEG_OWNER = {text_literal(owner)}"] + ([f"TABLE_NAME = {text_literal(table)}"] if table != "*" else [])
        parts.append("(" + " AND ".join(own) + ")")
    return " OR ".join(parts) or "SEG_OWNER != 'SYS'"


#: Formats that a session of redo rows is read under, so that literals in redo text parse.
SESSION_FORMATS = {
    "NLS_DATE_FORMAT": "YYYY-MM-DD HH24:MI:SS", "NLS_TIMESTAMP_FORMAT": "YYYY-MM-DD HH24:MI:SS.FF9",
    "NLS_TIMESTAMP_TZ_FORMAT": "YYYY-MM-DD HH24:MI:SS.FF9 TZH:TZM", "NLS_NUMERIC_CHARACTERS": ".,",
}


def session_block(files: list[str], start: int, end: int, container: str | None = None, options: list[str] | None = None) -> str:
    """A block that makes a session read redo rows: formats, the root container, the log files of a window, and the start.

    files come from ``positions.log_files``: those that cover [start, end). Spark runs
    the block on each connection before it reads (``sessionInitStatement``).
    """
    if not files:
        raise ValueError("no log files cover the window")
    chosen = options or ["SKIP_CORRUPTION", "NO_SQL_DELIMITER", "NO_ROWID_IN_STMT", "DICT_FROM_ONLINE_CATALOG"]
    run = [f"ALTER SESSION SET {k} = {text_literal(v)}" for k, v in SESSION_FORMATS.items()]
    if container:
        run.append(f'ALTER SESSION SET CONTAINER = "{container}"')
    lines = [f"EXECUTE IMMEDIATE {text_literal(x)};" for x in run]
    lines += [f"DBMS_LOGMNR.ADD_LOGFILE({text_literal(f)}, DBMS_LOGMNR.{'ADDFILE' if i else 'NEW'});" for i, f in enumerate(files)]
    flags = " + ".join(f"DBMS_LOGMNR.{o}" for o in chosen)
    return "BEGIN " + " ".join(lines) + f" DBMS_LOGMNR.START_LOGMNR(STARTSCN => {int(start)}, ENDSCN => {int(end)}, OPTIONS => {flags}); END;"


def read_redo(spark: SparkSession, url: str, start: int, end: int, tables: list[str], operations: str = "INSERT,UPDATE,DELETE", window: int = 10_000, **properties: str) -> DataFrame:
    """Redo rows of tables between change numbers, with commits and rollbacks.

    Pass ``sessionInitStatement=session_block(...)`` where the session does not have its log files yet.
    """
    codes = ", ".join(map(str, operation_codes(operations)))
    rows = f"(OPERATION_CODE IN ({codes}) AND ({table_predicate(tables)})) OR OPERATION_CODE IN (7, 36)"
    return spark.read.jdbc(url, "V$LOGMNR_CONTENTS", predicates=[f"{p} AND ({rows})" for p in scn_predicates(start, end, window)], properties=properties)


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, partitions: int = 1, **properties: str) -> DataFrame:
    """A snapshot of a table, cut by ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
    return reader.load()


def chunk_query(table: str, columns: list[str], key: str, after: object | None, size: int) -> str:
    """The next rows of a table in order of a key."""
    where = "" if after is None else f" WHERE {key} > {text_literal(after)}"
    return f"SELECT {', '.join(columns) or '*'} FROM {table}{where} ORDER BY {key} LIMIT {size}"
