"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut by the vocabulary's pattern into pieces, and each piece is encoded
by itself. A piece's bytes are mapped to characters one to one (printable bytes
to themselves, the others to characters from U+0100 on), so that the library's
BPE model works on characters while the tokens stay sequences of bytes. The
ranks file lists tokens in order of merging; the model gets every pair of tokens
whose bytes join to a token, at the joined token's rank.

Distinct pieces are encoded in batches and remembered, up to CACHE pieces a
worker, since most pieces of a corpus are words that come again and again.
Decoding takes ids alone: it joins the tokens' characters and maps each back to its byte
by the reversed table. A character may be split over tokens: a token that begins inside
one is counted as split; the character is whole again in the joined bytes, and
bytes that make no whole character decode to U+FFFD.

Offsets of tokens are code points of the text: a token begins at the character
that holds its first byte and ends after the one that holds its last, so tokens
that share a split character overlap in it.

Edge cases: a null text is encoded as an empty one, with no tokens; very long texts are
encoded whole; repeated rows
are encoded each by itself; an empty table gives an empty result; further
columns are ignored, whatever their names; ids outside the vocabulary raise a
ValueError when decoded.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from ._common import slices, small_batches

# tasks are the unit of parallelism here, not the library's threads
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker remembers, and the longest it does.
CACHE = 150_000
CACHED_CHARS = 64


def byte_characters() -> list[str]:
    """A character for each byte: printable ones stand for themselves, the rest follow from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class ByteBPE:
    """A vocabulary of ranks and its pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        to_char = byte_characters()
        self.table = "".join(to_char)
        self.bytes_of = {ord(c): b for b, c in enumerate(to_char)}
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        spelled = {token: self.spell(token) for token in ranks}
        self.spelled = [None if t is None else spelled[t] for t in self.tokens]
        self.sizes = np.array([0 if t is None else len(t) for t in self.tokens], np.int64)
        self.continues = np.array([t is not None and t[0] & 0xC0 == 0x80 for t in self.tokens], bool)
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            merges += [
                (spelled[token[:k]], spelled[token[k:]])
                for k in range(1, len(token))
                if token[:k] in spelled and token[k:] in spelled
            ]
        vocab = {s: ranks[token] for token, s in spelled.items()}
        self.model = Tokenizer(BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self.known: dict[str, bytes] = {}

    def spell(self, raw: bytes) -> str:
        """Bytes as characters, one for each byte."""
        return raw.decode("latin-1").translate(self.table)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces, known = self.pattern.findall(text), self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        new = [p for p in set(pieces) if p not in known]
        got = self.model.encode_batch([self.spell(p.encode()) for p in new], add_special_tokens=False)
        fresh = {p: np.array(x.ids, "<u4").tobytes() for p, x in zip(new, got, strict=True)}
        packed = b"".join([fresh[p] if p in fresh else known[p] for p in pieces])
        if len(known) + len(fresh) > CACHE:
            known.clear()
        known.update((p, x) for p, x in fresh.items() if len(p) <= CACHED_CHARS)
        return packed

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and where each token begins and ends in the text, in code points."""
        ids: list[int] = []
        offsets: list[tuple[int, int]] = []
        for m in self.pattern.finditer(text):
            raw = m[0].encode()
            lead = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
            char = np.cumsum(lead) - 1 + m.start()
            got = self.model.encode(self.spell(raw), add_special_tokens=False)
            ids += got.ids
            offsets += [(int(char[a]), int(char[b - 1]) + 1) for a, b in got.offsets]
        return ids, offsets

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token of an encoded text begins and ends, in code points.

        Tokens lie end to end in the text's bytes where the pattern leaves none out; else pieces are looked at one by one.
        """
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(self.sizes[ids])
        if len(raw) != (ends[-1] if len(ends) else 0):
            pairs = np.array(self.encode_with_offsets(text)[1], np.int64).reshape(-1, 2)
            return pairs[:, 0], pairs[:, 1]
        starts = ends - self.sizes[ids]
        if len(raw) == len(text):
            return starts, ends
        char = np.cumsum(raw & 0xC0 != 0x80) - 1
        return char[starts], char[ends - 1] + 1

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes of a sequence of ids: their tokens' characters, each mapped back to its byte."""
        spelled = self.spelled
        try:
            return "".join([spelled[i] for i in ids]).translate(self.bytes_of).encode("latin-1")
        except (IndexError, TypeError):
            raise ValueError("an id is outside the vocabulary") from None

    def split_tokens(self, ids: np.ndarray) -> int:
        """How many tokens begin inside a character that an earlier one began."""
        return int(self.continues[ids].sum())

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str, pattern: str) -> ByteBPE:
    """One for each Python worker."""
    return ByteBPE(ranks_path, pattern)


def _published() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def with_tokens(
    docs: DataFrame, text: str = "text", ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = True, with_offsets: bool = False
) -> DataFrame:
    """The documents, all columns kept, with n_tokens, digests of ids and of the decoded bytes, and the ids as 32-bit integers.

    with_offsets: starts and ends of tokens too, in code points, if ids are asked for; else their digest, as little-endian
    unsigned 32-bit integers, all starts and then all ends, and the number of tokens that begin inside a character.
    """
    names = docs.columns
    at = names.index(text)
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    made = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "array<int>")] * with_ids
    if with_offsets:
        made += [("starts", "array<int>"), ("ends", "array<int>")] if with_ids else [("offsets_sha256", "string"), ("n_split", "long")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema.fields) + "".join(f", _{n} {t}" for n, t in made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, pat = _published() if ranks_path is None else (ranks_path, pattern)
        bpe = vocabulary(path, pat)
        for batch in slices(batches, f"c{at}", 2 << 20):
            n, ids_sha, decoded_sha, all_ids, places, split = [], [], [], [], [], []
            for body in batch.column(at).to_pylist():
                packed = bpe.encode(body or "")
                ids = np.frombuffer(packed, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode_bytes(ids.tolist())).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                if with_offsets:
                    places.append([x.astype("<i4") for x in bpe.offsets(body or "", ids)])
                    split.append(bpe.split_tokens(ids))
            columns = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            if with_offsets and with_ids:
                columns += [pa.array([x[i] for x in places], pa.list_(pa.int32())) for i in (0, 1)]
            elif with_offsets:
                digests = [hashlib.sha256(a.tobytes() + b.tobytes()).hexdigest() for a, b in places]
                columns += [pa.array(digests, pa.string()), pa.array(split, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f"_{m[0]}" for m in made)])

    taken = {m[0] for m in made}
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in taken]
    return small_batches(inner).mapInArrow(run, schema).select(*kept, *(F.col(f"_{m[0]}").alias(m[0]) for m in made))


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, offsets_sha256, n_split) of every document."""
    return with_tokens(docs.select(key, text), text, ranks_path, pattern, with_ids=False, with_offsets=True).drop(text)


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Texts of sequences of ids; null ids give an empty text."""
    narrow = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, pat = _published() if ranks_path is None else (ranks_path, pattern)
        bpe = vocabulary(path, pat)
        for batch in batches:
            texts = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document and their round trip."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
