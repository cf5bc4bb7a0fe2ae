"""A data source of binary logs: ``format("binlog")`` over a directory of log files, batch and stream.

Files are read in order of their names, one task each, event by event. As with
the ``changelog`` source, a stream's offset is the name of the last file taken: a file counts once
it is complete, so ``skipLast`` (true by default in a stream) leaves the last file, which
the server is still writing, to a later batch. ``table`` and ``db`` are patterns of the row changes to keep.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import binlog

SCHEMA = (
    "file string, pos long, ts_sec long, server_id long, gtid string, row long, db string, table string, op string, before string, after string, query string"
)
ARROW = pa.schema([(c, {"string": pa.string(), "long": pa.int64()}[t]) for c, t in (f.split() for f in SCHEMA.split(", "))])
#: About how many characters of rows are returned at once.
AT_ONCE = 1 << 22


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _open(uri: str):
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Logs:
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.uri = low.get("path") or ""
        if not self.uri:
            raise ValueError("path is required")
        self.first = low.get("startingfile", "")
        self.most = int(low.get("maxfilespertrigger", "1000"))
        self.skip_last = low.get("skiplast", "true").lower() != "false"
        self.db, self.table = (re.compile(low.get(k, ".*"), re.IGNORECASE) for k in ("db", "table"))

    def files(self) -> list[tuple[str, str]]:
        """(name, path) of the log files from startingFile on, in order."""
        from pyarrow import fs as pafs

        fs, base = _open(self.uri)
        found = [f for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.is_file and re.search(r"\.\d+$", f.base_name)]
        return sorted((f.base_name, f.path) for f in found if f.base_name >= self.first)

    def rows(self, path: str) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.uri)
        name = path.rsplit("/", 1)[-1]
        kept: dict[tuple, bool] = {(None, None): True}
        out: list[tuple] = []
        size = 0
        with fs.open_input_stream(path, buffer_size=1 << 20, compression=None) as stream:
            for c in binlog.changes(stream):
                of = (c.db, c.table) if c.table is not None else (None, None)
                if of not in kept:
                    kept[of] = bool(self.db.fullmatch(c.db) and self.table.fullmatch(c.table))
                if kept[of]:
                    before, after = None if c.before is None else json.dumps(c.before), None if c.after is None else json.dumps(c.after)
                    out.append((c.pos, c.ts_sec, c.server_id, c.gtid, c.row, c.db, c.table, c.op, before, after, c.query))
                    size += 100 + len(before or "") + len(after or "") + len(c.query or "")
                    if size > AT_ONCE:
                        yield _batch(name, out)
                        out, size = [], 0
        if out:
            yield _batch(name, out)


def _batch(name: str, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(((name,) * len(rows), *zip(*rows)), ARROW.types)], schema=ARROW)


class BinlogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.logs = _Logs(options)

    def partitions(self):
        return [_File(path) for _, path in self.logs.files()]

    def read(self, partition: _File):
        yield from self.logs.rows(partition.path)


class BinlogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.logs, self.reached = _Logs(options), None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        names = [n for n, _ in self.logs.files()]
        names = names[:-1] if self.logs.skip_last else names
        later = [n for n in names if self.reached is None or n > self.reached]
        if later:
            self.reached = later[-1] if self.reached is None else later[: self.logs.most][-1]
        return {"after": self.reached or ""}

    def partitions(self, start: dict, end: dict):
        return [_File(path) for n, path in self.logs.files() if start["after"] < n <= end["after"]]

    def read(self, partition: _File):
        yield from self.logs.rows(partition.path)

    def commit(self, end: dict) -> None:
        pass


class BinlogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BinlogReader:
        return BinlogReader(self.options)

    def streamReader(self, schema) -> BinlogStreamReader:  # noqa: N802
        return BinlogStreamReader(self.options)
