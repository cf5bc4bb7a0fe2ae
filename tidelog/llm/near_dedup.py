"""Near-duplicate detection: MinHash with tensored banding, exact verification, connected components.

A document is the set of its distinct word shingles. Documents with equal sets
form one class. Candidates among classes come from tensored banding: some
small collections of ROWS minhashes each give one half key; every pair of half
keys is a table key, so 14 x 3 = 42 minhashes make 91 tables of 6 minhashes. Two
sets of similarity s share a table unless fewer than two of their half keys
agree: with s = 0.85 and 14 collections they are missed with a chance of 4e-5,
with s = 0.8 and 16 collections (120 tables) of 2e-4, and less the more alike they are.

Every class of a table's bucket is a candidate with the bucket's smallest class,
its centre; buckets of one centre form one group, in which all further links are
sought:

1. each (class, centre) pair is verified on the full sets; links so found give
   components;
2. a group whose members all lie in one component is done. In every other group,
   the members outside its largest component are compared with all its members in
   blocks; a block task compares through an inverted list of prefixes (of the shingles,
   the rarest in the block first, as many as two linked sets must share one of), with a bound on lengths, and returns
   links that join components not joined in the cell before: fewer than its members, never pairs.

So no pair that shares a bucket and would join two components goes unverified,
buckets of any size are split over tasks, and no group's pairs are emitted. Keys that
hold more than a HOT-th of a join's rows, fewer than HOT by that, are joined by broadcast or salted.

Shingles are 64-bit hashes; a set is kept whole wherever it is compared.

Edge cases: without words (or text) a set is empty and linked with nothing; with
fewer words than a shingle has, all words are the one shingle; repeated rows are
one class; very long texts are read whole; a null key takes part and gives way to any other in its component; ties go
to the smallest key; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_bytes, broadcast_if_small, give_back, slices, small_batches, written

ROWS = 3
SEED = 20240229
#: Members of a group that are compared at once: sought ones, and those they are held against.
SOUGHT_BLOCK = 256
HELD_BLOCK = 512
#: Classes whose table keys one task makes.
CLASSES = 10_000
#: Places over which the members of one centre are dealt.
SALTS = 16
#: A key with more than a HOT-th of the rows is hot: there are fewer than HOT.
HOT = 500
#: Words whose hashes a worker remembers.
KNOWN_WORDS = 120_000
#: Edges of which a task makes one forest at a time.
FOREST = 250_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    return x ^ (x >> _S33)


class _Words(dict):
    """Hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes | None, words: _Words, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; bytes lower-case A-Z alone and split at ASCII white space."""
    listed = text.lower().split() if text else []
    if not listed:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, listed), np.uint64, len(listed))
    if len(h) < k:
        return np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64)
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = _mix(s * _M2 + h[i : i + n])
    return np.unique(s)


def half_keys(s: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One key for each collection of minhashes; multipliers: odd numbers, collections x ROWS."""
    out = np.zeros(len(multipliers), np.uint64)
    for r in range(multipliers.shape[1]):
        low = [int(((s * m) >> np.uint64(32)).min()) for m in multipliers[:, r]]
        out = _mix(out * _M2 + np.array(low, np.uint64))
    return out


def _multipliers(halves: int) -> np.ndarray:
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (halves, ROWS), dtype=np.uint64)
    return draw * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, key: str, text: str, shingle: int, halves: int) -> DataFrame:
    """(key, th, n, cls, halves) of every document: th a hash of the text, n the set's size, cls the set's digest, null if empty."""
    narrow = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, th long, n long, cls binary, halves array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, multipliers = _Words(), _multipliers(halves)
        for batch in slices(batches, "text", 4 << 20):
            n, cls, keys = [], [], []
            for body in as_bytes(batch.column("text")):
                s = shingle_set(body, words, shingle)
                n.append(len(s))
                cls.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                keys.append(half_keys(s, multipliers).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("th"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["key", "th", "n", "cls", "halves"],
            )

    return small_batches(narrow).mapInArrow(run, schema)


def _sets(docs: DataFrame, key: str, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(cid, n, items) of the wanted classes; wanted: (cid, key, th) of a document of each."""
    wanted = broadcast_if_small(wanted.select("cid", F.col("key").alias("wk"), F.col("th").alias("wth")))
    keyed = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    rows = keyed.join(wanted, F.col("key").eqNullSafe(F.col("wk")) & (F.col("th") == F.col("wth"))).select("cid", "text")
    rows = rows.groupBy("cid").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in slices(batches, "text", 4 << 20):
            sets = [shingle_set(b, words, shingle).view(np.int64) for b in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cid", "n", "items"]
            )

    return small_batches(rows).mapInArrow(run, "cid long, n long, items array<long>")


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """An inner join with right's narrow rows (key, n, ..), one a key, n: its rows on the left, of total; hot keys by broadcast."""
    hot = F.broadcast(right.where(F.col("n") * HOT > total).drop("n"))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col("n") * HOT <= total).drop("n"), key)
    return left.join(hot, key).unionByName(cold)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, vertex) for every vertex of the edges that isn't its component's smallest, which is the root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        # each root hangs on the smallest one next to it: every round at least halves the roots that are still to join
        tops = label[x], label[y]
        for top in tops:
            np.minimum.at(label, top, np.minimum(*tops))
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    below = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[below]], nodes[below]


def _forests(most: int):
    """Edges (v, u) as stars with the same components; each forest is of most edges or the task's rest, and has its own number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, held = TaskContext.get().partitionId() << 32, 0, []

        def out(v, u):
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(np.full(len(v), number), pa.int64())], ["v", "u", "forest"])

        for batch in (whole.slice(at, most) for whole in batches for at in range(0, whole.num_rows, most)):
            held.append((batch.column("v").to_numpy(), batch.column("u").to_numpy()))
            waiting += batch.num_rows
            if waiting >= most:
                v, u = _roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
                waiting, held = len(v), [(v, u)]
                if 2 * waiting >= most:
                    yield out(v, u)
                    number, waiting, held = number + 1, 0, []
        if held:
            yield out(*_roots(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return run


def connected_components(edges: DataFrame, most: int = FOREST) -> DataFrame:
    """(v, label) for every vertex of edges (a, b); label is the smallest vertex of its component.

    Each task first makes stars of its own edges, most of them at a time. Where one forest holds them all, that is
    the result. Otherwise large-star and small-star steps alternate until the edges stay the same;
    each step is written, so that a lost executor costs one step at most.
    """
    spark = edges.sparkSession
    stars, kind = _forests(most), "v long, u long, forest long"
    e = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u > v").mapInArrow(stars, kind)
    e = written(e.select("v", "u").distinct().mapInArrow(stars, kind), "edges")
    sums = F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0)).alias("x")
    state = e.agg(*sums, (F.min("forest") == F.max("forest")).alias("one")).first()
    done, e = state["one"] or not state["n"], e.select("v", "u")
    give_back(spark)
    while not done:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        # large star: neighbours above u hang on the smallest of u's neighbourhood
        large = join_hot(both, low, "u", 2 * state["n"]).where("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u > v").distinct()
        large = written(large, "stars")
        below = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # small star: u and its neighbours below hang on the smallest of them
        small = join_hot(large, below, "u", large.count()).select(F.col("m"), F.explode(F.array("u", "v")).alias("u")).select(F.col("m").alias("v"), "u")
        e = written(small.where("u > v").distinct(), "edges")
        now = e.agg(*sums).first()
        done, state = tuple(now) == tuple(state)[:2], now
        give_back(spark)
    return e.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(e.select("v", F.col("v").alias("label")).distinct())


def _block_links(num: int, den: int):
    """Links within one cell: sought members against held ones, each of which joins two components that none before joins."""

    def run(table: pa.Table) -> pa.Table:
        cid, label, n = (table.column(c).to_numpy() for c in ("cid", "label", "n"))
        sought = np.flatnonzero(table.column("sought").to_numpy(zero_copy_only=False))
        held = np.flatnonzero(~table.column("sought").to_numpy(zero_copy_only=False))
        items = table.column("items").combine_chunks()
        flat, ends = items.flatten().to_numpy(), items.offsets.to_numpy() - items.offsets[0].as_py()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        got: list[tuple[int, int]] = []
        if len(sought) and len(held):
            # shingles by how many sets of the cell have them, rarest first, ties by value
            values, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
            order = np.empty(len(values), np.int64)
            order[np.lexsort((values, seen))] = np.arange(len(values))
            ranked = [np.sort(order[inverse[ends[i] : ends[i + 1]]]) for i in range(len(cid))]
            # of two linked sets, each has a shared shingle among its first n - ceil(n * num / den) + 1
            first = [x[: len(x) - -(-len(x) * num // den) + 1] for x in ranked]
            listed = np.concatenate([first[i] for i in sought])
            owner = np.repeat(np.arange(len(sought)), [len(first[i]) for i in sought])
            by_value = np.argsort(listed, kind="stable")
            listed, owner = listed[by_value], owner[by_value]
            for j in held:
                left = np.searchsorted(listed, first[j], "left")
                counts = np.searchsorted(listed, first[j], "right") - left
                total = int(counts.sum())
                if not total:
                    continue
                near = np.unique(owner[np.repeat(left - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)])
                i = sought[near]
                open_ = (label[i] != label[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
                for i in i[open_]:
                    x, y = root(int(label[i])), root(int(label[j]))
                    if x == y:
                        continue
                    both = len(np.intersect1d(ranked[i], ranked[j], assume_unique=True))
                    if both * den >= (n[i] + n[j] - both) * num:
                        parent[max(x, y)] = min(x, y)
                        got.append((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([p[0] for p in got], pa.int64()), "b": pa.array([p[1] for p in got], pa.int64())})

    return run


def near_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100, halves: int = 16
) -> DataFrame:
    """(key, n_shingles, component_id, kept, th), th a hash of the text: documents linked where den * intersection >= num * union."""
    give_back(docs.sparkSession)
    sigs = written(signatures(docs, key, text, shingle, halves), "signatures")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th")).alias("first")
    classes = sigs.where("cls is not null").groupBy("cls").agg(first, F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    classes = written(
        classes.select(F.monotonically_increasing_id().alias("cid"), "cls", F.col("first.key").alias("key"), F.col("first.th").alias("th"), "rows", "n", "halves"),
        "classes",
    )
    # tables: one key for each two half keys
    h = F.col("halves")
    tables = F.array(*(F.xxhash64(F.lit(i * halves + j), h[i], h[j]) for i in range(halves) for j in range(i + 1, halves)))
    # a task sums up the keys of so many classes as fit in its memory
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // CLASSES))
    keyed = classes.select("cid", "halves").repartition(parts).select("cid", F.explode(tables).alias("bucket"))
    centres = keyed.groupBy("bucket").agg(F.min("cid").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", "centre")
    stars = written(keyed.join(centres, "bucket").where("cid <> centre").select("cid", "centre").distinct(), "stars")
    give_back(docs.sparkSession)
    members = stars.unionByName(stars.select(F.col("centre").alias("cid"), "centre").distinct())
    wanted = written(members.select("cid").distinct().join(classes.select("cid", "key", "th"), "cid"), "wanted")
    sets = written(_sets(docs, key, text, shingle, wanted), "sets")
    # links with the centre, the stars of a hot one dealt over SALTS places
    total = stars.count()
    hot = F.broadcast(written(stars.groupBy("centre").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") * HOT > total).select("centre", F.lit(True).alias("hot")), "hot-centres"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).otherwise(0)
    with_own = stars.join(hot, "centre", "left").withColumn("salt", salt).drop("hot").join(sets, "cid")
    of_centre = sets.select(F.col("cid").alias("centre"), F.col("n").alias("cn"), F.col("items").alias("citems")).join(hot, "centre", "left")
    of_centre = of_centre.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    close = (F.least("n", "cn") * den >= F.greatest("n", "cn") * num)
    both = F.size(F.array_intersect("items", "citems"))
    linked = with_own.join(of_centre, ["centre", "salt"]).where(close).where(both * den >= (F.col("n") + F.col("cn") - both) * num)
    give_back(docs.sparkSession)
    labels = written(connected_components(linked.select(F.col("cid").alias("a"), F.col("centre").alias("b"))), "labels")
    # groups over several components
    label = F.coalesce("label", "cid").alias("label")
    marked = members.join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("cid", "centre", label)
    by_label = marked.groupBy("centre", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = by_label.groupBy("centre").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("labels"))
    largest = largest.where("labels > 1").select(
        "centre",
        F.col("top.label").alias("top"),
        F.ceil((F.col("m") - F.col("top.m")) / SOUGHT_BLOCK).cast("int").alias("sb"),
        F.ceil(F.col("m") / HELD_BLOCK).cast("int").alias("hb"),
    )
    # a hot centre's members meet its one row at SALTS places
    salted = largest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = marked.withColumn("x", F.xxhash64("cid")).withColumn("salt", F.pmod("x", F.lit(SALTS)).cast("int")).join(salted, ["centre", "salt"]).drop("salt")
    held = open_.select("cid", "label", "centre", F.lit(False).alias("sought"), F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("s"), F.pmod("x", "hb").cast("int").alias("t"))
    sought = open_.where("label <> top").select(
        "cid", "label", "centre", F.lit(True).alias("sought"), F.pmod("x", "sb").cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("t")
    )
    cells = held.unionByName(sought).join(sets, "cid")
    found = cells.groupBy("centre", "s", "t").applyInArrow(_block_links(num, den), "a long, b long")
    joined = connected_components(found.distinct())
    # class -> component -> smallest key
    comp = labels.join(joined.select(F.col("v").alias("label"), F.col("label").alias("upper")), "label", "left")
    comp = comp.select(F.col("v").alias("cid"), F.coalesce("upper", "label").alias("comp"))
    single = joined.select(F.col("v").alias("cid"), F.col("label").alias("comp")).join(labels.select(F.col("v").alias("cid")), "cid", "left_anti")
    comp = written(comp.unionByName(single), "components")
    grouped = written(comp.join(classes.select("cid", "key"), "cid"), "grouped")
    least = grouped.groupBy("comp").agg(F.min("key").alias("component"), F.count(F.lit(1)).alias("n"))
    of_class = join_hot(grouped.select("cid", "comp"), least, "comp", grouped.count()).select("cid", "component")
    of_class = classes.select("cid", "cls", "key", F.col("rows").alias("n")).join(of_class, "cid", "left")
    of_class = written(of_class.select("cls", F.coalesce("component", "key").alias("component"), "n"), "of-class")
    give_back(docs.sparkSession)
    # documents without a set are alone; copies of one text may be many
    narrow = sigs.select("key", "th", "n", "cls")
    worded = narrow.where("cls is not null").select("key", "th", F.col("n").alias("size"), "cls")
    worded = join_hot(worded, of_class, "cls", worded.count()).select("key", "th", F.col("size").alias("n"), "cls", "component")
    out = worded.unionByName(narrow.where("cls is null").withColumn("component", F.col("key")))
    component = F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"), "th"
    )


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100, halves: int = 16
) -> DataFrame:
    """The documents less all but one of each component, all columns kept.

    Of rows with one key and one text, which has words, one stays (any of them, where further columns differ);
    rows without words are linked with nothing and stay, repeated or not.
    """
    out = written(near_components(docs, key, text, shingle, num, den, halves), "components")
    gone = broadcast_if_small(out.where(~F.col("kept")).select(F.col(key).alias("_k"), F.col("th").alias("_h")).distinct())
    left = docs.join(gone, docs[key].eqNullSafe(gone["_k"]) & (F.xxhash64(docs[text]) == gone["_h"]), "left_anti")
    again = out.where("kept and n_shingles > 0").groupBy(F.col(key).alias("_k"), F.col("th").alias("_h")).count().where("count > 1").drop("count")
    again = broadcast_if_small(written(again, "repeated"))
    same = docs[key].eqNullSafe(again["_k"]) & (F.xxhash64(docs[text]) == again["_h"])
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([key, text]))


def op4_tensored_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 3-word shingles at 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs, shingle=3, num=85, den=100, halves=14).drop("th")


def oracle() -> str:
    """The same in DuckDB for distinct doc_ids: all pairs that share a shingle, and components by reachability."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({lowered}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM worded, unnest(range(1, 2 + greatest(0, len(w) - 3))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, both_ways.b FROM reached JOIN both_ways ON reached.b = both_ways.a),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN sizes USING (doc_id)
"""
