"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band, so
neither words that nearly all documents have nor words of a few documents count.
A document's distinct terms of the lexicon are sorted and hashed once whole, and
once for each of several random subsets of the lexicon. A subset keeps a term
with a chance between 1/8 and 1/512, the same for all documents, so long and
short documents each have subsets that hold just a few of their terms: a subset's hash
outlives an edit that touches none of its terms. The fingerprint is all these
hashes; the likeness of two is the share of equal hashes among the subsets in
which either document has a term.

Terms are the text's bytes, A-Z lower-cased, cut at ASCII white space. Document
frequencies are counted over all documents with partial sums. The lexicon's
size does not grow with the corpus: at a least document frequency of f of all
documents it holds at most (mean distinct terms of a document) / f terms.

Edge cases: a null text is an empty one; without terms of the lexicon all hashes are zero, and
such documents are alike; very long texts are read whole; equal texts have equal fingerprints; rows are put in
order of key, null first, then of a hash of the text, so repeated keys and rows follow
each other, and ties beyond that are equal texts; the last row's next is the first, which in a table of one row is
itself; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_bytes, slices, small_batches, written

#: The band: document frequency as a share of all documents, so idf from ln 5 to ln 1000.
LEAST_SHARE, MOST_SHARE = 0.001, 0.2
#: Terms of the band that a document must have for the band to hold: none, it holds for all.
LEAST = 0
#: How many random subsets keep a term with a chance of 2 ** -exponent, by exponent.
SUBSETS = {3: 2, 4: 2, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}
CHANCES = [2.0**-e for e, n in SUBSETS.items() for _ in range(n)]
SEED = 77
KNOWN_WORDS = 400_000


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, n): documents with a term, a term given by its 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def part() -> pa.RecordBatch:
            terms = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts.values(), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in slices(batches, "text"):
            for body in as_bytes(batch.column("text")):
                if body:
                    counts.update(set(body.lower().split()))
            if len(counts) > KNOWN_WORDS:
                yield part()
        yield part()

    return small_batches(docs.select(F.col(text).alias("text"))).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Hashes of the terms in the band."""
    total = docs.count()
    low, high = max(2, math.ceil(total * least)), max(2, math.floor(total * most))
    band = written(term_counts(docs, text).where(F.col("n").between(low, high)), "lexicon")
    rows = band.select("term").toArrow().column("term").to_numpy()
    return np.sort(rows).view(np.uint64)


class Fingerprints:
    """Fingerprints by one lexicon."""

    def __init__(self, terms: np.ndarray):
        self.lexicon = set(terms.tolist())
        self.seeds = np.random.default_rng(SEED).integers(0, 1 << 63, len(CHANCES), dtype=np.uint64)
        self.limits = np.array([int(c * (1 << 32)) for c in CHANCES], np.uint64)
        self.known: dict[bytes, tuple[int, int] | None] = {}

    def masks(self, terms: np.ndarray) -> np.ndarray:
        """For each term the subsets that keep it, as bits."""
        x = terms[:, None] ^ self.seeds[None, :]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        kept = (x >> np.uint64(32)) < self.limits[None, :]
        return (kept.astype(np.uint64) << np.arange(len(CHANCES), dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the whole and of each subset, 0 for one without terms."""
        out = np.zeros(1 + len(CHANCES), np.uint32)
        words = set(text.lower().split())
        if not words:
            return out
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = list(words)
            hashes = [xxhash.xxh64_intdigest(w) for w in new]
            own = [h for h in hashes if h in self.lexicon]
            mask = dict(zip(own, self.masks(np.array(own, np.uint64)).tolist(), strict=True)) if own else {}
            known.update((w, (h, mask[h]) if h in mask else None) for w, h in zip(new, hashes, strict=True))
        pairs = {p for w in words if (p := known[w])}
        if not pairs:
            return out
        both = np.array(sorted(pairs), np.uint64)
        terms, masks = both[:, 0], both[:, 1]
        out[0] = xxhash.xxh32_intdigest(terms.tobytes()) or 1
        bits = (masks[:, None] >> np.arange(len(CHANCES), dtype=np.uint64)[None, :]) & np.uint64(1)
        for i in np.flatnonzero(bits.any(0)):
            out[1 + i] = xxhash.xxh32_intdigest(terms[bits[:, i] == 1].tobytes()) or 1
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes where either has terms; 1 if neither has any."""
    either = (a != 0) | (b != 0)
    n = int(either.sum())
    return float(((a == b) & either).sum()) / n if n else 1.0


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def as_array(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_MADE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(text: str, own: np.ndarray, following: str, next_: np.ndarray, prints: Fingerprints) -> tuple:
    changed = edited(text, following).encode()
    after = prints.of(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), as_text(own), as_text(after), likeness(own, after), likeness(own, next_)


def fingerprint(docs: DataFrame, terms: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every document by a lexicon."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(sent.value)
        for batch in slices(batches, "text"):
            made = [as_text(prints.of(b)) for b in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.string())], ["key", "fingerprint"])

    return small_batches(narrow).mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, fingerprint string").withColumnRenamed("key", key)


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, its edited text's, and its likeness to that and to the next document's.

    Rows are range-partitioned and sorted; a task judges all of its rows but the
    last, and hands on its first and last. The partitions that have rows are numbered,
    and each one's last text is joined with the next one's first.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lexicon(docs, text))
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = narrow.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie")
    kind = narrow.schema["key"].dataType.simpleString()
    names = ["key", *(x.split()[0] for x in _MADE.split(", "))]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, part = Fingerprints(sent.value), TaskContext.get().partitionId()
        last, key_type = None, None

        def out(keys: list, made: list[tuple], edge: int, texts: list) -> pa.RecordBatch:
            columns = list(map(list, zip(*made, strict=True))) if made else [[]] * 6
            arrays = [pa.array(keys, key_type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            n = len(keys)
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.int32()), pa.array(texts, pa.string())], [*names, "part", "edge", "text"])

        blank = (None,) * 6
        for batch in slices(batches, "text"):
            keys, made = [], []
            key_type = batch.schema.field("key").type
            for k, body in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = prints.of(body.encode())
                if last is None:
                    yield out([k], [blank], 1, [body])
                else:
                    keys.append(last[0])
                    made.append(_judged(last[1], last[2], body, own, prints))
                last = (k, body, own)
            yield out(keys, made, 0, [None] * len(keys))
        if last is not None:
            yield out([last[0]], [blank], 2, [last[1]])

    body = written(small_batches(ordered).mapInArrow(run, f"key {kind}, {_MADE}, part int, edge int, text string"), "judged")
    # one number for each partition that has rows, without its texts: the last text of a partition is followed by the first of the next
    line = Window.orderBy("part")
    firsts = body.where("edge = 1").select(F.col("part").alias("after"), F.col("text").alias("following"))
    numbers = body.where("edge = 1").select("part", F.lead("part").over(line).alias("after"), F.first("part").over(line).alias("foremost"))
    numbers = numbers.select("part", F.coalesce("after", "foremost").alias("after"))
    ends = body.where("edge = 2").select("key", "text", "part").join(numbers, "part").join(firsts, "after").select("key", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(sent.value)
        for batch in batches:
            made = [
                _judged(t, prints.of(t.encode()), f, prints.of(f.encode()), prints)
                for t, f in zip(batch.column("text").to_pylist(), batch.column("following").to_pylist(), strict=True)
            ]
            columns = list(map(list, zip(*made, strict=True))) if made else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    inner = body.where("edge = 0").select(*names)
    return inner.unionByName(ends.mapInArrow(close, f"key {kind}, {_MADE}")).withColumnRenamed("key", key)


def op1_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
