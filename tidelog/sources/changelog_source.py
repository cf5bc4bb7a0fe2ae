"""A data source of change-log directories: JSON lines in files that only grow in number.

``spark.dataSource.register(ChangeLogSource)`` makes ``spark.read`` and
``spark.readStream`` understand ``format("changelog")``. Files are read in order
of their names; a stream's offset is the name of the last file it has taken, so a file
that comes late under an earlier name moves no other and is not read. The first batch of a run takes all
files there are: Spark neither tells the reader where a run stands nor asks again under
``availableNow``. From then on at most ``maxFilesPerTrigger`` are taken a batch. Lines that are no JSON objects raise an error,
or are skipped with ``failOnError=false``. ``startingFile`` names the first file of a new stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, pos long, xid long, db string, table string, op string, key string, before string, after string, ts_ms long"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(uri: str) -> list[str]:
    from pyarrow import fs as pafs

    fs, base = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.is_file and f.base_name.endswith(".jsonl"))


def _rows(uri: str, path: str, names: list[str], strict: bool) -> Iterator[tuple]:
    from pyarrow import fs as pafs

    fs, _ = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    with fs.open_input_stream(path) as stream:
        rest = b""
        while chunk := stream.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            yield from _parsed(lines, names, strict)
        yield from _parsed([rest], names, strict)


def _parsed(lines: list[bytes], names: list[str], strict: bool) -> Iterator[tuple]:
    for line in lines:
        if not line.strip():
            continue
        try:
            row = json.loads(line)
            yield tuple(json.dumps(v, sort_keys=True) if isinstance(v := row.get(n), (dict, list)) else v for n in names)
        except (ValueError, AttributeError):
            if strict:
                raise ValueError(f"no JSON object: {line[:80]!r}") from None


class _Options:
    def __init__(self, schema, options: dict):
        self.names = schema.fieldNames()
        self.uri = options.get("path") or ""
        if not self.uri:
            raise ValueError("path is required")
        self.strict = options.get("failonerror", options.get("failOnError", "true")).lower() != "false"
        self.first = options.get("startingfile", options.get("startingFile", ""))
        self.most = int(options.get("maxfilespertrigger", options.get("maxFilesPerTrigger", "1000")))


class ChangeLogReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.o = _Options(schema, options)

    def partitions(self):
        return [_File(f) for f in _files(self.o.uri)]

    def read(self, partition: _File):
        yield from _rows(self.o.uri, partition.path, self.o.names, self.o.strict)


class ChangeLogStreamReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict):
        self.o = _Options(schema, options)

        self.reached = None

    def _named(self) -> list[tuple[str, str]]:
        """(name, path) of the files from startingFile on, in order."""
        return [(n, f) for f in _files(self.o.uri) if (n := f.rsplit("/", 1)[-1]) >= self.o.first]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        later = [n for n, _ in self._named() if self.reached is None or n > self.reached]
        if later:
            self.reached = later[-1] if self.reached is None else later[: self.o.most][-1]
        return {"after": self.reached or ""}

    def partitions(self, start: dict, end: dict):
        return [_File(f) for n, f in self._named() if start["after"] < n <= end["after"]]

    def read(self, partition: _File):
        yield from _rows(self.o.uri, partition.path, self.o.names, self.o.strict)

    def commit(self, end: dict) -> None:
        pass


class ChangeLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChangeLogReader:
        return ChangeLogReader(schema, self.options)

    def streamReader(self, schema) -> ChangeLogStreamReader:  # noqa: N802
        return ChangeLogStreamReader(schema, self.options)
