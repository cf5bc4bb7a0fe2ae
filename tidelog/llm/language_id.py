"""Language identification: script ranges narrow the candidates, Viterbi labels spans.

A text's words are runs of letters, cut where the script changes and into pieces
of at most PIECE letters (PIECE_UNSPACED in scripts without blanks). Each word has a script (that of its first
letter) and, for every learned language, the log likelihood of its character
n-grams of two to four; languages in which that script is next to absent are no candidates for
the word, unless all are. A Viterbi pass over the words with one penalty for any switch of
language gives every word its label, so a text of several languages falls into
spans. The document's language is the one with the most letters; the
score is its share of the letters times its posterior over the labelled words.

Learning takes a bounded sample of the labelled documents: the MAX_DOCS with the
lowest hashes of their ids, whole. It counts their n-grams and scripts with
partial sums on the executors; what reaches the driver are the counts of that
sample, each n-gram of each language once.

Edge cases: a null text, one without letters, or no learned language give ``und``
with score 0; very long texts are read whole; of languages that tie, for a word or a document, the first by name counts; a null doc_id is not learned from and not held out; repeated rows
are learned from once and predicted each by itself; empty tables give empty results;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import slices, small_batches

#: Labelled documents that are learned from.
MAX_DOCS = 20_000
#: Cost of a switch, and how far below the best a word may put a candidate, in nats; a word
#: of more than FLOOR_LETTERS letters by as much more as it is longer.
SWITCH = 14.0
GRAMS = (2, 3, 4)
FLOOR = 6.0
FLOOR_LETTERS = 8
#: A language's share of letters in a script from which it is a candidate there.
SCRIPT_SHARE = 0.005
#: Letters of a word at most.
PIECE = 64
PIECE_UNSPACED = 16
UNSPACED = frozenset(("han", "kana", "thai", "khmer"))
UNKNOWN = "und"

# First and last code points of scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x323AF),
]

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words whose scores a worker remembers.
KNOWN_WORDS = 150_000
#: Words whose n-grams are looked up at once.
SCORED_AT_ONCE = 10_000


def script_of(letter: str) -> str:
    """A letter's script, ``other`` outside the table."""
    c = ord(letter)
    return next((name for name, a, z in SCRIPTS if a <= c <= z), "other")


@lru_cache(1 << 16)
def _cut(run: str) -> tuple[str, ...]:
    """A run of letters as words of one script each; marks and modifier letters go with what they follow."""
    out, start, script = [], 0, script_of(run[0])
    for i, c in enumerate(run):
        own = script if unicodedata.category(c) in ("Mn", "Mc", "Me", "Lm") else script_of(c)
        if own != script or i - start >= (PIECE_UNSPACED if script in UNSPACED else PIECE):
            out.append(run[start:i])
            start, script = i, own
    return (*out, run[start:])


def words_of(text: str) -> list[str]:
    """A text's words in order."""
    out: list[str] = []
    for w in _WORD.findall(text):
        if len(w) <= PIECE:
            if w.isascii():
                out.append(w)
            else:
                out += _cut(w)
        else:
            out += _cut.__wrapped__(w)
    return out


def grams(word: str) -> list[str]:
    """Character n-grams of a word with its ends marked, of each length in GRAMS."""
    w = f"<{word}>"
    return [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)]


def remainder(key: F.Column, modulus: int) -> F.Column:
    """CRC-32 of a key as text, modulo a number."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def count_features(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, feature, n): n-grams by how often they occur, and ``script:`` features by letters."""
    narrow = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def features() -> pa.RecordBatch:
            total: Counter = Counter()
            for name, words in counts.items():
                for w, n in words.items():
                    for g in grams(w):
                        total[name, g] += n
                    total[name, "script:" + script_of(w[0])] += n * len(w)
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(total.values(), pa.int64())],
                ["lang", "feature", "n"],
            )

        for batch in slices(batches, "text"):
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.setdefault(name, Counter()).update(words_of(body.lower()))
            if sum(map(len, counts.values())) > KNOWN_WORDS:
                yield features()
        if counts:
            yield features()

    return small_batches(narrow).mapInArrow(run, "lang string, feature string, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihoods of n-grams and candidates by script."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {name: i for i, name in enumerate(self.langs)}
        letters: dict[str, np.ndarray] = {}
        counts: dict[str, np.ndarray] = {}
        for name, feature, n in rows:
            into = letters if feature.startswith("script:") else counts
            into.setdefault(feature.removeprefix("script:"), np.zeros(len(at)))[at[name]] += n
        self.index = {g: i for i, g in enumerate(sorted(counts))}
        table = np.array([counts[g] for g in sorted(counts)]).reshape(len(counts), len(at))
        size = max(1, len(counts))
        share = (table + 0.5) / (table.sum(0) + 0.5 * size) if len(at) else table
        unseen = np.log(0.5 / (table.sum(0) + 0.5 * size)) if len(at) else np.zeros(0)
        self.scores = np.vstack([np.log(share), unseen[None, :]]).astype(np.float32) if len(at) else np.zeros((1, 0), np.float32)
        of_all = sum(letters.values()) if letters else np.ones(len(at))
        self.closed = {s: v / np.maximum(of_all, 1) < SCRIPT_SHARE for s, v in letters.items()}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Each word's score for each language, the best at 0; -inf for languages without its script."""
        none = len(self.index)
        ids, lengths = [], []
        for w in words:
            g = [self.index.get(x, none) for x in grams(w)]
            ids += g
            lengths.append(len(g))
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        out = np.add.reduceat(self.scores[ids], starts, axis=0)
        for s, shut in self.closed.items():
            if shut.any() and not shut.all():
                own = [i for i, w in enumerate(words) if script_of(w[0]) == s]
                if own:
                    out[np.ix_(own, np.flatnonzero(shut))] = -np.inf
        out -= out.max(1, keepdims=True)
        floor = -FLOOR * np.maximum(1.0, np.array([len(w) for w in words], np.float32) / FLOOR_LETTERS)
        return np.where(np.isneginf(out), out, np.maximum(out, floor[:, None].astype(np.float32)))


class Scorer(dict):
    """A model with the numbers of words seen before, their scores and lengths."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.new: list[str] = []
        self.rows = np.zeros((0, len(model.langs)), np.float32)
        self.letters = np.zeros(0, np.float64)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number

    def forget(self) -> None:
        """Drops all words once they are many; numbers given before hold no longer."""
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.new, self.rows, self.letters = [], self.rows[:0], self.letters[:0]

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and lengths of words by number."""
        made = [self.model.word_scores(self.new[i : i + SCORED_AT_ONCE]) for i in range(0, len(self.new), SCORED_AT_ONCE)]
        self.rows = np.concatenate([self.rows, *made])
        self.letters = np.concatenate([self.letters, np.fromiter(map(len, self.new), np.float64, len(self.new))])
        self.new = []
        return self.rows[numbers], self.letters[numbers]


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best labels of sequences laid end to end; all sequences go forward together, the longest first."""
    n_labels = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    before = np.empty((len(scores), n_labels), np.int16)
    here = np.arange(n_labels, dtype=np.int16)
    value = np.zeros((len(sizes), n_labels), np.float64)
    for t in range(longest):
        k = active[t]
        at, v = starts[:k] + t, value[:k]
        if t:
            best = v.argmax(1)
            least = v[np.arange(k), best] - switch
            switched = v < least[:, None]
            before[at] = np.where(switched, best[:, None].astype(np.int16), here)
            v = np.where(switched, least[:, None], v)
        value[:k] = v + scores[at]
    labels = np.empty(len(scores), np.int16)
    label = value.argmax(1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = label[:k]
        if t:
            label[:k] = before[at, label[:k]]
    return labels


def _predicted(texts: list[str | None], scorer: Scorer, with_spans: bool) -> tuple[list[str], list[float], list[int], list[list]]:
    langs = scorer.model.langs
    scorer.forget()
    # words as numbers: a slice's words are not held as strings
    listed = [scorer.numbers(words_of(x.lower())) if x else np.empty(0, np.int32) for x in texts] if langs else [np.empty(0, np.int32) for _ in texts]
    lengths = np.array([len(x) for x in listed], np.int64)
    words = np.concatenate(listed) if listed else np.empty(0, np.int32)
    del listed
    pred, share, n_spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
    all_spans: list[list] = [[] for _ in texts]
    if not len(words):
        return pred, share, n_spans, all_spans
    scores, letters = scorer.of(words)
    labels = viterbi(scores, lengths, SWITCH)
    ends = np.cumsum(lengths)
    for i in np.flatnonzero(lengths):
        a, z = ends[i] - lengths[i], ends[i]
        own = labels[a:z]
        mass = np.bincount(own, letters[a:z], len(langs))
        top = int(mass.argmax())
        mean = scores[a:z][own == top].mean(0) * min(20, int((own == top).sum()))
        posterior = 1 / np.exp(mean - mean[top]).sum()
        pred[i], share[i] = langs[top], float(min(1.0, mass[top] / mass.sum() * posterior))
        cuts = np.flatnonzero(np.diff(own)) + 1
        n_spans[i] = len(cuts) + 1
        if with_spans:
            places = []
            for m in _WORD.finditer(texts[i]):
                at = m.start()
                for w in words_of(m[0]):
                    places.append((at, at + len(w)))
                    at += len(w)
            if len(places) == len(own):  # else lower-casing moved a word's edge
                for x, y in zip([0, *cuts], [*cuts, len(own)], strict=True):
                    all_spans[i].append({"lang": langs[own[x]], "start": places[x][0], "end": places[y - 1][1]})
    return pred, share, n_spans, all_spans


def learn(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, max_features: int | None = None
) -> Model:
    """A model of labelled documents, of at most max_docs of them (and those that share the last one's hash).

    max_features: counts that a smaller model keeps, over all languages: each language's first, then each one's second,
    and so on; of equal counts, n-grams of three come first.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    last = usable.select(F.xxhash64(key).alias("x")).distinct().orderBy("x").limit(max_docs).agg(F.max("x")).first()[0]
    sample = usable.where(F.xxhash64(key) <= F.lit(last)).select(key, text, lang).distinct()
    rows = count_features(sample, text, lang)
    if max_features is not None:
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.col("feature").startswith("script:")), F.desc("n"), F.abs(F.length("feature") - 3), "feature"))
        rows = rows.withColumn("nth", nth).where(F.col("nth") <= max_features).orderBy("nth", "lang").limit(max_features)
    rows = rows.select("lang", "feature", "n").toArrow()
    return Model(list(zip(*(rows.column(c).to_pylist() for c in ("lang", "feature", "n")), strict=True)))


def _with_predictions(docs: DataFrame, model: Model, text: str, with_spans: bool) -> DataFrame:
    """The documents with columns c0, c1, .. for their own and _pred, _score, _n_spans, _spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    # cells of words and languages in a step stay bounded
    step = max(1 << 19, (3 << 20) * 4 // max(4, len(model.langs)))
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema.fields)
    schema += ", _pred string, _score double, _n_spans long, _spans array<struct<lang:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches, f"c{at}", step):
            pred, score, n_spans, spans = _predicted(batch.column(at).to_pylist(), scorer, with_spans)
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n_spans, pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_pred", "_score", "_n_spans", "_spans"])

    return small_batches(inner).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, text: str = "text", with_spans: bool = False) -> DataFrame:
    """The documents with lang_pred, score, n_spans (and spans in code points); columns of these names of their own go."""
    made = ["lang_pred", "score", "n_spans"] + ["spans"] * with_spans
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns) if n not in made]
    inner = {"lang_pred": "_pred", "score": "_score", "n_spans": "_n_spans", "spans": "_spans"}
    return _with_predictions(docs, model, text, with_spans).select(*kept, *(F.col(inner[n]).alias(n) for n in made))


def reject_unknown(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.2) -> DataFrame:
    """The documents less those without a language (no letters, or a score below least), all columns kept, lang as predicted."""
    model = learn(docs.where(remainder(F.col(key), 3) != 1), key, text, lang)
    out = _with_predictions(docs, model, text, False).where((F.col("_pred") != UNKNOWN) & (F.col("_score") >= least))
    return out.select(*(F.col("_pred" if c == lang else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op7_language_viterbi(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = learn(docs.where(remainder(F.col("doc_id"), 3) != 1))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")
