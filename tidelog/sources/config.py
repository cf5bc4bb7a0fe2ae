"""Options of a change-log reader."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


def interpolate(text: str, values: Mapping[str, str]) -> str:
    """``${name}`` and ``${name:default}`` replaced; without either the text stays."""
    out, at = [], 0
    while (a := text.find("${", at)) >= 0 and (z := text.find("}", a)) >= 0:
        name, _, default = text[a + 2 : z].partition(":")
        whole = text[a : z + 1]
        out += [text[at:a], values.get(name, default if ":" in whole else whole)]
        at = z + 1
    return "".join(out) + text[at:]


def preflight(variables: Mapping[str, str]) -> None:
    """Refuses a server whose log lacks whole row images; an absent row image setting means full ones."""
    if variables.get("binlog_format", "").upper() != "ROW":
        raise ValueError("binlog_format must be ROW")
    if variables.get("binlog_row_image", "FULL").upper() != "FULL":
        raise ValueError("binlog_row_image must be FULL")


@dataclass(frozen=True)
class Options:
    """Defaults are those of the change-log reader that this replaces."""

    server_name: str
    hostname: str = ""
    port: int = 3306
    table_include: str = ""
    table_exclude: str = ""
    column_exclude: str = ""
    database_include: str = ""
    database_exclude: str = ""
    gtid_include: str = ""
    gtid_exclude: str = ""
    ignore_builtin: bool = True
    decimal_mode: str = "precise"
    time_precision: str = "adaptive_time_microseconds"
    bigint_unsigned_mode: str = "long"
    binary_mode: str = "bytes"
    tombstones_on_delete: bool = True
    skipped_operations: str = ""
    max_queue_size: int = 8192
    max_batch_size: int = 2048
    poll_interval_ms: int = 500
    failure_mode: str = "fail"

    def __post_init__(self):
        if not self.server_name:
            raise ValueError("server_name is required: it is the partition of positions and history")
        if self.max_queue_size <= self.max_batch_size:
            raise ValueError("max_queue_size must be above max_batch_size")
        if self.gtid_include and self.gtid_exclude:
            raise ValueError("gtid_include and gtid_exclude exclude each other")
        for name, allowed in (
            ("decimal_mode", ("precise", "double", "string")), ("bigint_unsigned_mode", ("long", "precise")), ("binary_mode", ("bytes", "base64", "hex")), ("failure_mode", ("fail", "warn", "skip", "ignore")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")

    @staticmethod
    def from_properties(properties: Mapping[str, str], prefix: str = "") -> Options:
        """Options from dotted properties below a prefix; unknown ones are an error."""
        known = {f.name: f.type for f in fields(Options)}
        values: dict[str, object] = {}
        for key, text in properties.items():
            if not key.startswith(prefix):
                continue
            name = key[len(prefix) :].replace(".", "_")
            if name not in known:
                raise ValueError(f"{key} is no option")
            text = interpolate(text, properties)
            values[name] = text.lower() == "true" if known[name] == "bool" else int(text) if known[name] == "int" else text
        return Options(**values)
