"""Secret scan: assignment-aware lexing beside fixed patterns, as spans of the text.

Fixed patterns give three kinds of spans (``assign``, ``access``, ``hex``). The
lexer adds a fourth, ``pair``: it reads source and configuration syntax into
name-literal pairs:

- assignments ``name = value``, ``name: value``, ``name: type = value``, ``"name" => value``, ``name["key"] = value``,
  ``name := value``; calls ``f("name", "value")``; elements ``<name>value</name>`` and
  attributes, ``<add key="name" value="..."/>`` among them;
- literals in quotes with escapes, in triple quotes over lines, bare, in YAML block
  scalars, joined with ``+`` or ``.`` or side by side, and in parentheses over lines.

A comment is no part of the code around it: it binds no names and takes no
constants; but what it assigns is read, since a secret in a comment is disclosed
all the same. The same holds for the body of a string, one level deep.

Constants are followed by names set before in the same text. A name is bound to a
node of a graph, whose children are literals and the nodes of the names used; a
node knows the sums of its children's lengths, characters and flags, and scores
run from nodes to children once, so the work is linear in the text however names
are joined. A literal is scored by its target's name (the most sensitive word in
it) and by the shape of the whole value (length, entropy, kinds of characters; random
strings of letters and digits count in full whatever their kinds; placeholders
and references score nothing). Under a name that can only mean a secret, plain
words and passphrases count too. Scores lie between 0 and 1. Literals from
THRESHOLD on are reported, at the place of the literal itself, also where another
name led to it.

Offsets are code points, ends exclusive. Spans are ordered by start, then kind
as listed, then end.

Edge cases: a null or empty text has no spans; very long texts and names are read
whole; a literal reached by several names has the best score, ties going to the
name read first; repeated rows are scanned each by itself; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, small_batches

KINDS = ("assign", "access", "hex", "pair")
#: How sensitive a word in a target's name is.
NAMES = {
    b"password": 1.0, b"passwd": 1.0, b"passphrase": 1.0, b"pwd": 1.0, b"secret": 1.0, b"token": 0.95,
    b"api_key": 0.95, b"apikey": 0.95, b"api-key": 0.95, b"access_key": 0.95, b"accesskey": 0.95, b"private_key": 1.0,
    b"privatekey": 1.0, b"credential": 0.9, b"auth_key": 0.9, b"authkey": 0.9, b"encryption_key": 0.9, b"client_key": 0.8,
    b"bearer": 0.8, b"signature": 0.6, b"auth": 0.6, b"session": 0.5, b"salt": 0.5, b"key": 0.5,
    b"_key": 0.6, b"-key": 0.6,
}
#: Literals that stand where a secret would.
PLACEHOLDERS = frozenset(
    b"changeme change_me password passwd secret token example sample test none null nil true false undefined todo xxx placeholder your_password redacted default".split()
)
#: Words of phrases that ask for a secret.
ASKING = frozenset(b"password passwd passphrase your".split())
THRESHOLD = 0.45
MIN_LENGTH = 6
#: From this weight on a name can only mean a secret; what a literal that is no placeholder scores there at least.
SENSITIVE = 1.0
PLAIN_SCORE = 0.5
#: Length and entropy of random strings, with digits and of letters alone.
RANDOM_LENGTH = 16
RANDOM_ENTROPY = 3.0
LETTERS_ENTROPY = 3.75

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # runs are maximal: the same spans as runs of any length, the short ones dropped
_RANDOM = re.compile(rb"[A-Za-z0-9+/_-]+={0,6}\Z")
_RANDOM_BODY = re.compile(rb"[A-Za-z0-9+/_-]*\Z")
_IDENTIFIER = re.compile(rb"[A-Za-z_$\x80-\xff][A-Za-z0-9_.$\x80-\xff]*\Z")
_OPERATOR = rb"(?::=|=>|(?:\+|\?|\|\|)?=(?![=~])|:(?![:=]))"
_STRING = (
    rb"\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}|\"(?:[^\"\\\n]|\\(?s:.))*+\"|(?<![A-Za-z0-9_\x80-\xff])'(?:[^'\\\n]|\\(?s:.))*+'|`(?:[^`\\\n]|\\(?s:.))*+`"
)
#: What the lexer stops at: comments, strings, a name with an operator after it, the beginning of a tag.
_NEXT = re.compile(
    rb"(?P<line>(?<!\S)(?:\#|//|--(?=\s))|(?m:^);)|(?P<block>/\*|<!--)|(?P<open>[(\[]\s*+)?+(?P<string>" + _STRING + rb")"
    rb"|(?<![A-Za-z0-9_$.\x80-\xff-])(?P<name>[A-Za-z0-9_$\x80-\xff-][A-Za-z0-9_.$\x80-\xff-]*+)(?:\[\])?[\"'`\]]{0,2}[ \t]*+(?P<op>" + _OPERATOR + rb")|(?P<tag><(?=[A-Za-z_]))"
)
_AFTER_STRING = re.compile(rb"\]?[ \t]*+(" + _OPERATOR + rb")")
_AFTER_KEY = re.compile(rb"\s*+,\s*+")
_BLANK, _SPACE = re.compile(rb"[ \t]*+"), re.compile(rb"(?:\s|\#[^\n]*|//[^\n]*)*+")
_PREFIXED = re.compile(rb"[rRbBfFuU@]{0,2}(" + _STRING + rb"|`(?:[^`\\]|\\(?s:.))*+`)")
_BARE = re.compile(rb"[^\s,;()\[\]{}\"'`<>]+")
_JOIN = re.compile(rb"[ \t]*+[+.][ \t]*+(?=[\"'`A-Za-z_$(])")
_TYPE = re.compile(rb"[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+(?:\[[A-Za-z0-9_., \[\]|]*+\])?[?]?[ \t]*+=(?![=>])")
_SCALAR = re.compile(rb"[ \t]*+[|>][+-]?[0-9]?[ \t]*+(?:\#[^\n]*)?\n")
_ELEMENT = re.compile(rb"<([A-Za-z_][A-Za-z0-9_:.-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*+>")
_TAG = re.compile(rb"<[A-Za-z_][A-Za-z0-9_:.-]*+(?:\s++[A-Za-z_:][A-Za-z0-9_:.-]*+\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'))++")
_ATTRIBUTE = re.compile(rb"([A-Za-z_:][A-Za-z0-9_:.-]*+)\s*+=\s*+(?:\"([^\"<>]*+)\"|'([^'<>]*+)')")
_KEY_ATTRIBUTES, _VALUE_ATTRIBUTES = (b"key", b"name", b"id", b"property"), (b"value", b"content", b"val")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    name: str
    score: float


def name_score(name: bytes) -> float:
    """The most sensitive word of a target's name."""
    low = name.lower()
    return max((v for k, v in NAMES.items() if k in low), default=0.0)


def _starts_elsewhere(low: bytes) -> bool:
    """Whether a value refers to where a secret is, rather than being one."""
    return low.startswith((b"${", b"$(", b"%(", b"{{", b"<", b"os.", b"env", b"http://", b"https://"))


class _Node:
    """A literal, or a value joined from others; what its score needs, summed up from its children."""

    __slots__ = ("asks", "best", "body", "children", "counts", "elsewhere", "end", "length", "name", "random", "start", "value")

    def __init__(self, children: tuple[_Node, ...] = (), value: bytes | None = None, start: int = 0, end: int = 0):
        self.children, self.value, self.start, self.end = children, value, start, end
        self.best, self.name = -1.0, b""
        if value is not None:
            low = value.lower()
            self.length, self.body, self.elsewhere, self.asks = float(len(value)), value, _starts_elsewhere(low), bool(ASKING & set(low.split()))
            self.counts: dict[int, float] = {}
            for c in value:
                self.counts[c] = self.counts.get(c, 0.0) + 1.0
            self.random = (bool(_RANDOM_BODY.match(value)), bool(_RANDOM.match(value)))
        else:
            self.length = sum(c.length for c in children)
            # short values are known whole, for the comparison with placeholders
            self.body = b"".join(c.body for c in children) if self.length <= 64 and all(c.body is not None for c in children) else None
            self.elsewhere, self.asks = children[0].elsewhere, any(c.asks for c in children)
            self.counts = {}
            for c in children:
                for k, v in c.counts.items():
                    self.counts[k] = self.counts.get(k, 0.0) + v
            self.random = (all(c.random[0] for c in children), all(c.random[0] for c in children[:-1]) and children[-1].random[1])
            if self.length > 1e100:  # doubled over and over: only shares of characters count from here on
                self.counts = {k: v * 1e-50 for k, v in self.counts.items()}
                self.length *= 1e-50

    def score(self, sensitive: bool) -> float:
        """How much the value looks like a secret, 0 to 1; sensitive: its name can only mean one."""
        low = self.body.lower() if self.body is not None else None
        if self.length < MIN_LENGTH or low in PLACEHOLDERS or self.elsewhere:
            return 0.0
        entropy = -sum(c / self.length * math.log2(c / self.length) for c in self.counts.values() if c)
        seen = [False] * 5
        for c in self.counts:
            seen[0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 if c in b" \t\n\r\f\v" else 3] = True
        kinds, digits, letters = sum(seen[:4]), seen[2], seen[0] or seen[1]
        if self.length >= RANDOM_LENGTH and self.random[1] and letters and entropy >= (RANDOM_ENTROPY if digits else LETTERS_ENTROPY):
            return 1.0
        least = PLAIN_SCORE if sensitive and len(self.counts) > 1 and not self.asks else 0.0
        if 32 in self.counts and kinds < 3:
            return least
        return min(1.0, max(least, min(1.0, entropy / 4) * (0.55 + 0.15 * kinds if kinds > 1 else 0.45)))


def literal_score(value: bytes, sensitive: bool = False) -> float:
    """How much a literal looks like a secret, 0 to 1; sensitive: its name can only mean one."""
    return _Node(value=value).score(sensitive)


class _Lexer:
    """Reads a text into nodes of literals, with the scores of the names that lead to them."""

    def __init__(self, text: bytes):
        self.text, self.nodes, self.constants = text, [], {}
        self.inner = False

    def literal(self, start: int, end: int) -> _Node:
        node = _Node(value=self.text[start:end], start=start, end=end)
        self.nodes.append(node)
        return node

    def string(self, start: int, end: int) -> tuple[int, int]:
        """Where the body of a string token begins and ends."""
        k = 3 if self.text[start : start + 3] in (b'"' * 3, b"'" * 3) and end - start >= 6 else 1
        return start + k, end - k

    def operand(self, at: int, stop: int, alone: bool) -> tuple[list[_Node], bool, int]:
        """The values joined from a place on, whether all are quoted or constants, and where they end."""
        text, parts, quoted, depth = self.text, [], True, 0
        while True:
            at = (_SPACE if depth else _BLANK).match(text, at, stop).end()
            if at < stop and text[at] == 40 and not parts:
                depth += 1
                at += 1
                continue
            if q := _PREFIXED.match(text, at, stop):
                parts.append(self.literal(*self.string(q.start(1), q.end(1))))
                self.inside(parts[-1])
                at = q.end()
            elif parts and not joined:  # noqa: F821
                break
            elif b := _BARE.match(text, at, stop):
                raw = b[0].rstrip(b".:")
                if not raw:
                    break
                end = at + len(raw)
                known = None if alone else self.constants.get(raw)
                if known is not None:
                    parts.append(known)
                elif _IDENTIFIER.match(raw) and (parts or _JOIN.match(text, end, stop) or depth):
                    quoted = False
                    break
                else:
                    parts.append(self.literal(at, end))
                    quoted = False
                at = end
            else:
                break
            more = _JOIN.match(text, (_SPACE if depth else _BLANK).match(text, at, stop).end(), stop)
            joined = bool(more)  # noqa: F841
            if more:
                at = more.end()
            elif not quoted:
                break
        return parts, quoted, at

    def bind(self, name: bytes, parts: list[_Node], quoted: bool, alone: bool, added: bool = False) -> None:
        """A name with the values joined under it."""
        if not parts:
            return
        key = name.rsplit(b".", 1)[-1]
        if added and not alone and name in self.constants:
            parts = [self.constants[name], *parts]
        if len(parts) == 1:
            node = parts[0]
        else:
            node = _Node(tuple(parts))
            self.nodes.append(node)
        if not alone and (quoted or node.body is None or not _IDENTIFIER.match(node.body)):
            self.constants[key] = self.constants[name] = node
        if weight := name_score(name):
            score = min(1.0, round(weight * node.score(weight >= SENSITIVE), 4))
            if score > node.best:
                node.best, node.name = score, name

    def scalar(self, name_at: int, at: int, stop: int) -> list[_Node]:
        """Lines of a YAML block scalar that begins at a place: those indented more than the name's line."""
        text = self.text
        line = text.rfind(b"\n", 0, name_at) + 1
        least, parts = _BLANK.match(text, line).end() - line, []
        while at < stop:
            end = text.find(b"\n", at, stop)
            end = stop if end < 0 else end
            first = _BLANK.match(text, at, end).end()
            if first < end:
                if first - at <= least:
                    break
                parts.append(self.literal(first, first + len(text[first:end].rstrip())))
            at = end + 1
        return parts

    def assigned(self, name: bytes, name_at: int, op: bytes, at: int, stop: int, alone: bool) -> int:
        """Reads what follows an operator; returns where to go on."""
        if op == b":":
            if block := _SCALAR.match(self.text, at, stop):
                self.bind(name, self.scalar(name_at, block.end(), stop), True, alone)
                return block.end()
            if kind := _TYPE.match(self.text, at, stop):
                at = kind.end()
        parts, quoted, end = self.operand(at, stop, alone)
        self.bind(name, parts, quoted, alone, op == b"+=")
        return at if not parts else end

    def tag(self, at: int, stop: int) -> None:
        if element := _ELEMENT.match(self.text, at, stop):
            body = element[2]
            start = element.start(2) + len(body) - len(body.lstrip())
            if body.strip():
                self.bind(element[1], [self.literal(start, start + len(body.strip()))], True, True)
        if tag := _TAG.match(self.text, at, stop):
            named, values = None, None
            for m in _ATTRIBUTE.finditer(self.text, at, tag.end()):
                k = m.lastindex
                if m[1].lower() in _KEY_ATTRIBUTES:
                    named = named or m[k]
                elif m[1].lower() in _VALUE_ATTRIBUTES:
                    values = values or m.span(k)
            if named and values:
                self.bind(named, [self.literal(*values)], True, True)

    def inside(self, node: _Node) -> None:
        """Pairs in the body of a string, whose own quotes are no strings."""
        if not self.inner and (b"=" in node.value or b":" in node.value):
            self.inner = True
            self.read(node.start, node.end)
            self.inner = False

    def read(self, at: int, stop: int) -> None:
        """All pairs between two places."""
        text, comment, inner = self.text, 0, self.inner
        while m := _NEXT.search(text, at, stop):
            kind = "name" if m["name"] is not None else m.lastgroup
            alone = inner or m.start() < comment
            at = m.end()
            if kind in ("line", "block"):
                if not alone:
                    mark = {b"/*": b"*/", b"<!--": b"-->"}.get(m[0], b"\n")
                    end = text.find(mark, at, stop)
                    comment = stop if end < 0 else end
            elif kind == "tag":
                self.tag(m.start(), stop)
            elif kind == "name":
                at = self.assigned(m["name"], m.start(), m["op"], at, comment if alone and not inner else stop, alone)
            elif inner:
                at = m.start() + 1
            else:
                start, end = self.string(m.start("string"), m.end())
                body = self.literal(start, end)
                self.inside(body)
                name = body.value.strip()
                if after := _AFTER_STRING.match(text, at, stop):
                    at = self.assigned(name, m.start(), after[1], after.end(), stop, alone)
                elif (comma := _AFTER_KEY.match(text, at, stop)) and m["open"]:
                    parts, quoted, end = self.operand(comma.end(), stop, alone)
                    if quoted:
                        self.bind(name, parts, quoted, True)

    def pairs(self) -> list[tuple[bytes, bytes, int, int, float]]:
        """Each literal under a name: (name, value, start, end, score), byte offsets."""
        # values come after what they are joined from, so one pass from the last to the first reaches all
        for node in reversed(self.nodes):
            for child in node.children:
                if node.best > child.best:
                    child.best, child.name = node.best, node.name
        return [(n.name, n.value, n.start, n.end, n.best) for n in self.nodes if n.value is not None and n.best >= 0]


def pairs(text: bytes) -> list[tuple[bytes, bytes, int, int, float]]:
    """Name-literal pairs as (name, value, start, end, score), byte offsets, scores of any height."""
    if b"=" not in text and b":" not in text and b"<" not in text and b'"' not in text and b"'" not in text:
        return []
    lexer = _Lexer(text)
    lexer.read(0, len(text))
    return lexer.pairs()


def scan(text: bytes | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text, base and lexed, as code points."""
    if not text:
        return []
    raw = [Span(m.start(), 0, m.end(), "", 1.0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    raw += [Span(m.start(), 1, m.end(), "", 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    raw += [Span(m.start(), 2, m.end(), "", 1.0) for m in _HEX.finditer(text)]
    lexed: dict[tuple[int, int], Span] = {}
    for name, _, start, end, score in pairs(text):
        if score >= threshold and end > start:
            old = lexed.get((start, end))
            if old is None or score > old.score:
                lexed[start, end] = Span(start, 3, end, name.decode("utf-8", "replace"), score)
    raw += lexed.values()
    raw.sort()
    if text.isascii():
        return raw
    out, at, points = [], 0, {}
    chars = 0
    for b in sorted({x for s in raw for x in (s.start, s.end)}):
        chars += len(text[at:b].decode("utf-8", "replace"))
        at, points[b] = b, chars
    for s in raw:
        out.append(s._replace(start=points[s.start], end=points[s.end]))
    return out


def joined(spans: list[Span]) -> str:
    """Spans as kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every stretch of spans replaced by one mark."""
    out, at, reach = [], 0, -1
    for s in sorted(spans):
        if s.start > reach:
            if reach >= 0:
                at = reach
            out += [text[at : s.start], mark]
            reach = s.end
        else:
            reach = max(reach, s.end)
    out.append(text[reach if reach >= 0 else 0 :])
    return "".join(out)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts, digest and spans of every text."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, all_spans = [], []
            for body in as_bytes(batch.column("text")):
                spans = scan(body, threshold)
                base = [s for s in spans if s.kind < 3]
                for k in range(3):
                    counts[k].append(sum(s.kind == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                all_spans.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return small_batches(narrow).mapInArrow(run, schema).withColumnRenamed("key", key)


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns kept, with secrets replaced by a mark and their lengths counted anew; a null text stays null."""
    at, columns = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = as_bytes(batch.column(at))
            spans = [scan(b, threshold) for b in bodies]
            arrays = list(batch.columns)
            if any(spans):
                new = [redacted(b.decode(), s) if s else b for b, s in zip(bodies, spans, strict=True)]
                arrays[at] = pa.array([x.encode() if isinstance(x, str) else x for x in new], pa.binary()).cast(batch.column(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    out = small_batches(docs).mapInArrow(run, docs.schema)
    if n_chars in columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.char_length(text)).cast(docs.schema[n_chars].dataType))
    return out.select(*columns)


def op10_assignment_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_secrets(docs)
