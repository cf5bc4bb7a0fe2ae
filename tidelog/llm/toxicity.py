"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings, all of them. A bounded sample of labelled
documents (MAX_SAMPLE, those with the lowest hashes of their ids) are the
examples. Document frequencies are counted over all documents. A vector has
(1 + ln tf)^2 * ln(1 + documents / df) for each term and length 1; its dimensions
are the terms of the examples, since a term that none of them has adds nothing to
any cosine's numerator and the same to all denominators: it changes no order and,
as votes go by distance relative to the nearest, no vote.

The index holds examples in blocks of like ones. The postings of rarer terms are
short and are summed up at once; the FREQUENT most common terms have a greatest
weight for each block, and their postings (dense, block by block) are read only
where the sum of a block's greatest weights and its best sum of rarer terms can
still reach the K-th best cosine so far. What reaches that is summed up anew, in one order for all,
so the K nearest are exact, ties going to the earlier example.

Each neighbour votes for its label with weight 1 / (EPSILON + 1 - its share of the
nearest one's cosine), beside a vote of PRIOR_WEIGHT for the rate of the sample.
Votes are also counted term by term among the neighbours that have it: the
evidence is the mean of the EVIDENCE largest standard scores of a text's terms
for the toxic label. A logistic fit on each example's own vote and evidence, found among
the other examples, and an isotonic fit on its results turn both into a score.

Edge cases: a null or empty text, and one without a term of the examples, has the
rate of the sample as its score and no neighbour; very long texts count whole; a null doc_id is not learned
from and not held out; of a document labelled twice the higher label counts;
without labels of both kinds all scores are the share of toxic labels (0 without
any); repeated rows are learned from once and scored each by itself; of a document
with several texts the further ones are learned from as far as MAX_SAMPLE has
room; equal cosines: the example with the lower number; empty tables give empty
results; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import slices, small_batches, written
from .language_id import remainder

#: Examples, whole documents with all their terms: each Python worker holds their index.
MAX_SAMPLE = 4_000
BEGINNINGS = (4,)
BLOCK = 512
#: Terms whose postings are kept dense and bounded by block.
FREQUENT = 1024
K = 64
EPSILON = 0.05
PRIOR_WEIGHT = 1.0
#: Standard scores that make up the evidence, and the least weight of the neighbours that have a term.
EVIDENCE = 6
LEAST_WEIGHT = 1.5
#: Calibration cases at which the isotonic fit has half the say, and the pull of the logistic one to no effect.
FIT_CASES = 2000
RIDGE = 1.0
KNOWN_WORDS = 200_000
#: Vectors searched together, and results of vectors that a task remembers.
BATCH = 128
KNOWN_VECTORS = 20_000
#: How far below the K-th best cosine, in single precision, an example is summed up anew in double, by itself.
MARGIN = 1e-5

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same in a lower-cased text of ASCII alone.
_ASCII_WORD = re.compile(r"[a-z]+")


def terms_of(word: str) -> list[str]:
    """A word's terms: itself, and its beginnings as ``abcd*``."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def words_of(text: str | None) -> Counter:
    """A text's words with their counts."""
    if not text:
        return Counter()
    low = text.lower()
    return Counter((_ASCII_WORD if low.isascii() else _WORD).findall(low))


def term_weight(tfs: np.ndarray) -> np.ndarray:
    return (1 + np.log(tfs)) ** 2


class Vocabulary(dict):
    """Words by the numbers of their terms, each plus 1 (0: none of the examples'), BITS for each in one number."""

    BITS = 63 // (1 + len(BEGINNINGS))

    def __init__(self, terms: list[str]):
        super().__init__()
        self.index = {t: i for i, t in enumerate(terms)}
        if len(terms) >> min(self.BITS, 31):
            raise ValueError(f"{len(terms)} terms are more than {min(self.BITS, 31)} bits can number")

    def __reduce__(self):
        return Vocabulary, (list(self.index),)

    def __missing__(self, word: str) -> int:
        got = 0
        for k, t in enumerate(terms_of(word)):
            got |= (self.index.get(t, -1) + 1) << k * self.BITS
        self[word] = got
        return got

    def numbers(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text, ascending, and how often they occur."""
        if len(self) > KNOWN_WORDS:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, counts), np.int64, len(counts))
        tfs = np.fromiter(counts.values(), np.int64, len(counts))
        # a term's number and its count in one number, so that one sort does for both
        cells = np.concatenate([(numbers >> k * self.BITS & (1 << self.BITS) - 1) << 32 | tfs for k in range(1 + len(BEGINNINGS))])
        cells = np.sort(cells[cells >> 32 > 0])
        if not len(cells):
            return np.empty(0, np.int32), np.empty(0, np.int32)
        ids = cells >> 32
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        return (ids[first] - 1).astype(np.int32), np.add.reduceat(cells & (1 << 32) - 1, first).astype(np.int32)


class BlockMaxIndex:
    """Examples with their labels, in blocks, and the K nearest of a query."""

    def __init__(self, idf: np.ndarray, examples: list[tuple], labels: list[int], block: int = BLOCK, frequent: int = FREQUENT):
        self.idf, self.labels, self.block = np.asarray(idf, np.float64), np.array(labels, np.float64), block
        self.n, n_terms = len(examples), len(idf)
        self.n_blocks = -(-self.n // block)
        self.width = self.n_blocks * block
        sizes = np.array([len(e[0]) for e in examples], np.int64)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        terms = np.concatenate([np.asarray(e[0], np.int64) for e in examples]) if self.n else np.empty(0, np.int64)
        tfs = np.concatenate([np.asarray(e[1], np.float64) for e in examples]) if self.n else np.empty(0)
        weight = term_weight(tfs) * self.idf[terms]
        length = np.sqrt(np.bincount(owner, weight * weight, self.n))
        weight = weight / np.where(length > 0, length, 1.0)[owner]
        # dense postings of the most common terms, with the greatest weight of each block
        df = np.bincount(terms, minlength=n_terms)
        common = np.sort(np.argsort(-df, kind="stable")[:frequent])
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        column = self.column[terms]
        inside = column >= 0
        self.common = len(common), owner[inside], column[inside], weight[inside]
        self._lay_out()
        # postings of the others by term
        order = np.argsort(terms[~inside], kind="stable")
        self.post, self.post_weight = owner[~inside][order], weight[~inside][order]
        self.edges = np.searchsorted(terms[~inside][order], np.arange(n_terms + 1))

    def _lay_out(self) -> None:
        columns, owner, column, weight = self.common
        self.dense = np.zeros((self.width, columns))
        self.dense[owner, column] = weight
        self.single = self.dense.astype(np.float32)
        self.most = self.single.reshape(self.n_blocks, self.block, columns).max(1).T if self.n else np.zeros((columns, 0), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("dense", "single", "most")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._lay_out()

    def weigh(self, ids, tfs) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a vector of length 1."""
        at = np.asarray(ids, np.int64)
        w = term_weight(np.asarray(tfs, np.float64)) * self.idf[at]
        length = np.sqrt((w * w).sum())
        return at, w / length if length else w

    def search(self, queries: list[tuple], k: int = K, but: list[int] | None = None) -> Iterator[tuple]:
        """For each query (ids, tfs): its k nearest with a cosine above 0, best first, ties by example; their cosines; and
        a function that sums a weight of each neighbour over the neighbours that have a term, for every term of the query.

        but: an example for each query that is passed over.
        """
        n = len(queries)
        weighed = [self.weigh(*q) for q in queries]
        rare, heavy = np.zeros((n, self.width)), np.zeros((n, self.dense.shape[1]), np.float32)
        read = []
        for i, (at, w) in enumerate(weighed):
            column = self.column[at]
            inside = np.flatnonzero(column >= 0)
            heavy[i, column[inside]] = w[inside]
            outside = np.flatnonzero(column < 0)
            left = self.edges[at[outside]]
            counts = self.edges[at[outside] + 1] - left
            total = int(counts.sum())
            cells = np.repeat(left - np.cumsum(counts) + counts, counts) + np.arange(total)
            place = np.repeat(outside, counts)
            owner = self.post[cells]
            if total:
                rare[i] = np.bincount(owner, np.repeat(w[outside], counts) * self.post_weight[cells], self.width)
            read.append((owner, place, inside, column[inside]))
        bounds = heavy @ self.most + rare.reshape(n, self.n_blocks, self.block).max(2)
        order = np.argsort(-bounds, axis=1, kind="stable")
        wide = k + (but is not None)
        floor = np.full(n, 2 * MARGIN)
        held: list[tuple] = []
        for turn in range(self.n_blocks):
            bound = bounds[np.arange(n), order[:, turn]]
            active = np.flatnonzero(bound >= floor - MARGIN)
            if not len(active):
                break
            blocks = order[active, turn]
            for b in np.unique(blocks):
                own = active[blocks == b]
                cut = slice(b * self.block, (b + 1) * self.block)
                score = heavy[own] @ self.single[cut].T + rare[own, cut].astype(np.float32)
                if wide <= self.block:
                    # a block's own K-th best is at most the K-th best of all
                    floor[own] = np.maximum(floor[own], np.partition(score, self.block - wide, axis=1)[:, self.block - wide])
                row, at = np.nonzero(score >= floor[own, None] - MARGIN)
                held.append((own[row], at + cut.start, score[row, at]))
        whose, found, near = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 3
        there = near >= floor[whose] - MARGIN
        whose, found, near = whose[there], found[there], near[there]
        line = np.lexsort((found, whose))
        found, near = found[line], near[line]
        ends = np.searchsorted(whose[line], np.arange(n + 1))
        rank = np.full(self.width, -1, np.int32)
        for i, (at, w) in enumerate(weighed):
            owner, place, inside, column = read[i]
            own, close = found[ends[i] : ends[i + 1]], near[ends[i] : ends[i + 1]]
            if len(own) > wide:
                own = own[close >= np.partition(close, len(own) - wide)[len(own) - wide] - MARGIN]
            if but is not None:
                own = own[own != but[i]]
            # by itself, so that the sums do not depend on what else is searched
            dense = self.dense.ravel().take((own * self.dense.shape[1])[:, None] + column[None, :])
            cosine = np.minimum(1.0, np.round((dense * w[inside]).sum(1) + rare[i, own], 9))
            top = np.lexsort((own, -cosine))[:k]
            top = top[cosine[top] > 0]
            own, cosine, dense = own[top], cosine[top], (dense[top] > 0).astype(np.float64)
            rank[own] = np.arange(len(own))
            row = rank[owner]
            rank[own] = -1
            row, place = row[row >= 0], place[row >= 0]

            def having(weight, n=len(at), row=row, place=place, inside=inside, dense=dense):
                out = np.bincount(place, weight[row], n)
                out[inside] = weight @ dense
                return out

            yield own, cosine, having

    def nearest(self, ids, tfs, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest with a cosine above 0, best first, ties by example."""
        if not self.n:
            return np.empty(0, np.int64), np.empty(0)
        return next(self.search([(ids, tfs)], k))[:2]

    def votes(self, queries: list[tuple], prior: float, but: list[int] | None = None) -> list[tuple]:
        """For each query: vote, evidence, nearest example (-1: none), its cosine, and up to three terms that speak most for label 1."""
        none = (prior, 0.0, -1, 0.0, [])
        if not self.n:
            return [none] * len(queries)
        out = []
        for (ids, _), (found, cosine, having) in zip(queries, self.search(queries, K, but), strict=True):
            if not len(found):
                out.append(none)
                continue
            weight = 1 / (EPSILON + 1 - cosine / cosine[0])
            weight /= weight.mean()
            total, label = weight.sum(), self.labels[found]
            for_it = float((weight * label).sum())
            share = (for_it + 2 * prior) / (total + 2)
            mass, toxic = having(weight), having(weight * label)
            spread = np.sqrt(mass * share * (1 - share) * np.maximum(0.0, 1 - mass / (total + 1)) + 0.5)
            z = np.round(np.where(mass > LEAST_WEIGHT, (toxic - mass * share) / spread, 0.0), 9)
            top = np.argsort(-z, kind="stable")[:EVIDENCE]
            out.append(((for_it + PRIOR_WEIGHT * prior) / (total + PRIOR_WEIGHT), float(z[top].mean()), int(found[0]), float(cosine[0]), [int(ids[t]) for t in top[:3] if z[t] > 0]))
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending knots of the monotone least-squares fit, pooled where it must be."""
    values, inverse = np.unique(x, return_inverse=True)
    sums, counts = np.bincount(inverse, y), np.bincount(inverse).astype(float)
    pools: list[list] = []
    for v, s, c in zip(values, sums, counts, strict=True):
        pools.append([s, c, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, c2, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + c2, pools[-1][2], hi]
    knots = [(v, s / c) for s, c, lo, hi in pools for v in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Calibration:
    """From votes and evidence to a probability: a logistic fit, and an isotonic one on its results."""

    def __init__(self, vote: np.ndarray, evidence: np.ndarray, label: np.ndarray):
        x = self._inputs(vote, evidence)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        self.beta, pull = np.zeros(3), np.array([0.0, RIDGE, RIDGE])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(pull + 1e-6), z.T @ (label - p) - pull * self.beta)
            self.beta = self.beta + step
            if np.abs(step).max() < 1e-9:
                break
        self.trust = len(label) / (len(label) + FIT_CASES)
        self.knots = isotonic(self._logistic(vote, evidence), label)

    @staticmethod
    def _inputs(vote, evidence) -> np.ndarray:
        v = np.clip(np.asarray(vote, np.float64), 1e-3, 1 - 1e-3)
        return np.stack([np.log(v / (1 - v)), np.asarray(evidence, np.float64)], axis=1)

    def _logistic(self, vote, evidence) -> np.ndarray:
        z = (self._inputs(vote, evidence) - self.mean) / self.scale
        return np.round(1 / (1 + np.exp(-np.clip(self.beta[0] + z @ self.beta[1:], -30, 30))), 12)

    def score(self, vote, evidence) -> np.ndarray:
        p = self._logistic(vote, evidence)
        return np.clip((1 - self.trust) * p + self.trust * np.interp(p, *self.knots), 0.0, 1.0)


def vectors(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str) -> DataFrame:
    """(key, terms, tfs) of every text: terms of a vocabulary by number, ascending, and how often they occur.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, terms array<int>, tfs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        for batch in slices(batches, "text", 2 << 20):
            got = [terms.numbers(words_of(body)) for body in batch.column("text").to_pylist()]
            arrays = [_lists([g[i] for g in got]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], ["key", "terms", "tfs"])

    return small_batches(narrow).mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0), pa.int32()))


def document_counts(vecs: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """How many documents have each term, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            counts += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
            total += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1], pa.int64()), pa.array(np.r_[counts[at], total], pa.int64())], ["term", "n"])

    rows = vecs.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(n_terms, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def _examples(docs: DataFrame, labelled: DataFrame, key: str, text: str, label: str, max_sample: int) -> DataFrame:
    """(key, th, label, text) of the sample, at most max_sample rows."""
    marks = labelled.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    marks = written(marks.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(max_sample), "marks")
    # marks: at most max_sample rows; every document's first text comes before any document's second
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("th")).join(F.broadcast(marks), "key").distinct()
    nth = F.row_number().over(Window.partitionBy("key").orderBy("th", "text"))
    sample = sample.withColumn("nth", nth).where(F.col("nth") <= max_sample).orderBy("nth", F.xxhash64("key"), "key").limit(max_sample)
    return written(sample.select("key", "th", "label", "text"), "sample")


def _vocabulary(sample: DataFrame) -> Vocabulary:
    """All terms of the sample, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[str] = set()
        for batch in slices(batches, "text", 1 << 20):
            for body in batch.column("text").to_pylist():
                words.update(words_of(body))
        yield pa.RecordBatch.from_arrays([pa.array(list({t for w in words for t in terms_of(w)}), pa.string())], ["term"])

    return Vocabulary(sorted(small_batches(sample.select("text")).mapInArrow(run, "term string").distinct().toArrow().column("term").to_pylist()))


def _index(sample: DataFrame, vocabulary: Vocabulary, idf: np.ndarray) -> tuple[BlockMaxIndex, list[tuple], list]:
    """The index, and the examples' vectors and keys in its order: like ones stand together."""
    marks = sample.select("key", "th", "label", "text").withColumn("row", F.struct("key", "th", "label"))
    rows = vectors(marks, vocabulary, "row", "text").toArrow().to_pylist()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["key"]["key"])), str(r["key"]["key"]), r["key"]["th"] or 0))
    examples = [(np.array(r["terms"], np.int32), np.array(r["tfs"], np.int32)) for r in rows]
    # by the term that weighs most among those that many examples have
    many = np.bincount(np.concatenate([e[0] for e in examples]) if examples else np.empty(0, np.int64), minlength=len(idf)) * 100 >= len(examples)
    heads = []
    for ids, n in examples:
        w = np.where(many[ids], term_weight(n) * idf[ids], 0.0)
        heads.append(int(ids[w.argmax()]) if len(ids) else -1)
    line = np.argsort(np.array(heads, np.int64), kind="stable").tolist()
    examples = [examples[i] for i in line]
    index = BlockMaxIndex(idf, examples, [rows[i]["key"]["label"] for i in line])
    return index, examples, [rows[i]["key"]["key"] for i in line]


def _calibration(spark, index: BlockMaxIndex, examples: list[tuple], sent, prior: float) -> Calibration:
    """Fitted on every example's vote and evidence among the others."""
    vecs = spark.sparkContext.broadcast(examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for a in range(0, len(ids), BATCH):
                own = ids[a : a + BATCH]
                got = sent.value[1].votes([vecs.value[i] for i in own], prior, own)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([g[0] for g in got]), pa.array([g[1] for g in got])], ["id", "vote", "evidence"])

    parts = max(1, min(index.n // BATCH, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = spark.range(0, index.n, 1, parts).mapInArrow(run, "id long, vote double, evidence double").orderBy("id").toArrow()
    return Calibration(rows.column("vote").to_numpy(), rows.column("evidence").to_numpy(), index.labels)


def score_documents(
    docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_sample: int = MAX_SAMPLE
) -> DataFrame:
    """(key, score, nearest, cosine, evidence) of every document; labelled: (key, label) to learn from, label 0 or 1.

    nearest: the nearest example's key; evidence: up to three terms that speak most for label 1.
    """
    spark = docs.sparkSession
    sample = _examples(docs, labelled, key, text, label, max_sample)
    vocabulary = _vocabulary(sample)
    vecs = written(vectors(docs, vocabulary, key, text), "vectors")
    counts, total = document_counts(vecs, len(vocabulary.index))
    index, examples, keys = _index(sample, vocabulary, np.log(1 + total / np.maximum(counts, 1)))
    prior = float(index.labels.mean()) if index.n else 0.0
    sent = spark.sparkContext.broadcast((list(vocabulary.index), index, keys))
    fitted = _calibration(spark, index, examples, sent, prior) if 0 < prior < 1 else None
    kind = vecs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index, keys = sent.value
        seen: dict[bytes, tuple] = {}
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                columns = [batch.column(c) for c in ("terms", "tfs")]
                ends = columns[0].offsets.to_numpy() - columns[0].offsets[0].as_py()
                flat = [c.flatten().to_numpy() for c in columns]
                rows = [tuple(x[y:z] for x in flat) for y, z in zip(ends, ends[1:], strict=False)]
                digests = [xxhash.xxh128_digest(ids.tobytes() + tfs.tobytes()) for ids, tfs in rows]
                if len(seen) > KNOWN_VECTORS:
                    seen.clear()
                new = {d: v for d, v in zip(digests, rows, strict=True) if d not in seen}
                seen.update(zip(new, index.votes(list(new.values()), prior), strict=True))
                got = [seen[d] for d in digests]
                near = np.array([g[2] for g in got])
                score = fitted.score([g[0] for g in got], [g[1] for g in got]) if fitted else np.full(len(got), prior)
                arrays = [
                    batch.column("key"),
                    pa.array(np.where(near < 0, prior, score)),
                    pa.array([keys[i] if i >= 0 else None for i in near], batch.schema.field("key").type),
                    pa.array([g[3] for g in got], pa.float64()),
                    pa.array([[names[t] for t in g[4]] for g in got], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "score", "nearest", "cosine", "evidence"])

    return small_batches(vecs).mapInArrow(run, f"key {kind}, score double, nearest {kind}, cosine double, evidence array<string>").withColumnRenamed("key", key)


def op9_nearest_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three quarters of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score_documents(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "nearest", "cosine", F.array_join("evidence", " ").alias("evidence"))
