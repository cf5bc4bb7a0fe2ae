"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

An item's windows are its runs of WINDOW consecutive words (a shorter item is one
window). A window occurs in a document only if all of its shingles of SHINGLE
words do, in place; its tokens are these shingles. Exact containment needs a prefix of one token: the
shingle that is rarest over all documents. The steps:

1. read the documents and keep the places of benchmark shingles, as (document, position, token) without words;
2. count every benchmark shingle over all documents, order each window's shingles
   by that rarity and keep the first, with its place in the window; a window with
   a shingle that is nowhere cannot occur and goes;
3. join the places with these prefixes and drop candidates that would begin before
   the document or end after it;
4. read the documents that still have candidates, cut out the words at their places
   and join them, word for word, with the windows;
5. join the items of the windows that occur, last.

Shingles are hashes of words in lower case of all scripts, which join at least
what must join; the comparison of words lower-cases A-Z alone.

Only benchmark tables and keys of documents with candidates are broadcast, and only up to BROADCAST_ROWS
rows and a measured number of bytes; beyond that Spark shuffles the join. A document's words
stay in its row: what is shuffled are places, and once each document that has candidates.

Edge cases: a null or empty text has no words and no hits; very long texts are read
whole; an item without words
has no windows; repeated items count once; repeated documents are each judged;
documents are told apart by id and text, so a null or repeated doc_id does no
harm; windows that tie in rarity take the earlier shingle; empty tables give an empty result or no hits;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_LOWER, ASCII_UPPER, ascii_lower, broadcast_if_small, written

WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose A-Z are not lower-cased.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The token of the row that stands for a document itself.
DOCUMENT = 0


def cased_words(text: F.Column) -> F.Column:
    """Words of a text as they stand in it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CASED_WORD), F.lit(0))


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows as (wid, window, len): their words joined by blanks, and their number; and (wid, item) of the items that hold them."""
    worded = items.select(F.col(item_id).cast("string").alias("item"), F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(window - 1)))
    each = worded.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), F.lit(window)).alias("w"))
    each = written(each.select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("len")).distinct(), "item-windows")
    windows = written(each.select("window", "len").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return windows, each.join(windows, ["window", "len"]).select("wid", "item")


def _shingle(words: F.Column, at: F.Column, k: int) -> F.Column:
    """A hash of k words from a place on, counted from 0; never DOCUMENT."""
    h = F.xxhash64(*(F.lower(F.get(words, at + i)) for i in range(k)))
    return F.when(h == DOCUMENT, F.lit(1)).otherwise(h)


def _places(docs: DataFrame, key: str, text: str, vocabulary: DataFrame, k: int) -> DataFrame:
    """Places of the vocabulary's shingles: (key, h, n_words, pos, token).

    Each document has a row of token DOCUMENT too, if the vocabulary has it.
    """
    worded = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), cased_words(F.col(text)).alias("words"))
    each = worded.select("*", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    n = F.size("words")
    token = F.when(F.col("pos") <= n - k, _shingle(F.col("words"), F.col("pos"), k)).when(F.col("pos") == n, F.lit(DOCUMENT))
    return each.select("key", "h", n.cast("long").alias("n_words"), "pos", token.cast("long").alias("token")).join(vocabulary, "token")


def _verified(docs: DataFrame, key: str, text: str, spots: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, h, start, len, wid) of the spots (key, h, start, len) at which the words of a window stand."""
    own = written(spots.groupBy("key", "h").agg(F.collect_set(F.struct("start", "len")).alias("spots")), "spots")
    wanted = broadcast_if_small(own.select(F.col("key").alias("wk"), F.col("h").alias("wh")), limit=BROADCAST_ROWS)
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("x"), F.col(text).alias("t"))
    rows = rows.join(wanted, F.col("k").eqNullSafe(F.col("wk")) & (F.col("x") == F.col("wh")), "left_semi")
    rows = rows.join(own, F.col("k").eqNullSafe(F.col("key")) & (F.col("x") == F.col("h")))
    cut = rows.select("key", "h", cased_words(F.col("t")).alias("words"), "spots").select("key", "h", "words", F.explode("spots").alias("s"))
    held = ascii_lower(F.array_join(F.slice("words", F.col("s.start") + 1, F.col("s.len")), " "))
    cut = cut.select("key", "h", "s.start", "s.len", held.alias("window"))
    return cut.join(broadcast_if_small(windows, limit=BROADCAST_ROWS), ["window", "len"]).select("key", "h", "start", "len", "wid")


def window_hits(
    docs: DataFrame, items: DataFrame, key: str, text: str, item_id: str, item_text: str, window: int = WINDOW
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences of windows as (key, h, start, len, wid), all documents as (key, h, n_words), and the windows' items as (wid, item)."""
    spark = docs.sparkSession
    windows, held_by = item_windows(items, item_id, item_text, window)
    sizes = {r["k"]: r["n"] for r in windows.groupBy(F.least("len", F.lit(SHINGLE)).alias("k")).agg(F.sum("len").alias("n")).collect()}
    marker = spark.range(1).select(F.lit(DOCUMENT).cast("long").alias("token"))
    spots, documents = None, None
    for k, rows in sorted(sizes.items(), reverse=True) or [(SHINGLE, 0)]:
        own = windows.where(F.least("len", F.lit(SHINGLE)) == k).withColumn("w", F.split("window", " "))
        tokens = own.select("wid", "len", "w", F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("offset"))
        tokens = tokens.select("wid", "len", "offset", _shingle(F.col("w"), F.col("offset"), k).alias("token"))
        vocabulary = tokens.select("token").distinct()
        vocabulary = vocabulary.unionByName(marker) if documents is None else vocabulary
        # rows of fixed width: their number bounds their bytes
        places = written(_places(docs, key, text, broadcast_if_small(vocabulary, rows, BROADCAST_ROWS), k), "places")
        documents = places.where(F.col("token") == DOCUMENT).select("key", "h", "n_words") if documents is None else documents
        places = places.where(F.col("token") != DOCUMENT)
        counts = places.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        ordered = tokens.join(counts, "token").groupBy("wid", "len")
        ordered = ordered.agg(F.min(F.struct("n", "offset", "token")).alias("p"), F.countDistinct("offset").alias("there"))
        prefixes = written(ordered.where(F.col("there") == F.col("len") - k + 1).select("len", "p.offset", "p.token").distinct(), "prefixes")
        found = places.join(broadcast_if_small(prefixes, rows, BROADCAST_ROWS), "token").withColumn("start", F.col("pos") - F.col("offset"))
        found = found.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))).select("key", "h", "start", "len")
        spots = found if spots is None else spots.unionByName(found)
    return _verified(docs, key, text, spots, windows), documents, held_by


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: its words, the words that windows hit, and the items whose windows occur."""
    hits, documents, held_by = window_hits(docs, items, key, text, item_id, item_text, window)
    hits = written(hits, "hits")
    # one document's windows and items: bounded by its own length and the benchmark
    by_doc = hits.groupBy("key", "h").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"))
    listed = hits.select("key", "h", "wid").distinct().join(held_by, "wid").groupBy("key", "h").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    listed = listed.select(F.col("key").alias("k3"), F.col("h").alias("h3"), "item_ids")
    by_doc = by_doc.join(listed, F.col("key").eqNullSafe(F.col("k3")) & (F.col("h") == F.col("h3")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["reach"], s["start"]))).alias("n"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
    )["n"]
    by_doc = by_doc.select(F.col("key").alias("k2"), F.col("h").alias("h2"), covered.alias("hit"), "item_ids")
    joined = documents.join(by_doc, F.col("key").eqNullSafe(F.col("k2")) & (documents["h"] == F.col("h2")), "left")
    none = F.array().cast("array<string>")
    ids = F.coalesce("item_ids", none)
    return joined.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"),
        ids.alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, all columns kept."""
    hits, _, _ = window_hits(docs, items, key, text, item_id, item_text, window)
    hits = broadcast_if_small(written(hits.select(F.col("key").alias("_k"), F.col("h").alias("_h")).distinct(), "hit"))
    return docs.join(hits, docs[key].eqNullSafe(hits["_k"]) & (F.xxhash64(docs[text]) == hits["_h"]), "left_anti")


def op8_prefix_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).drop("item_ids")


def oracle() -> str:
    """The same in DuckDB: every window of every document, joined as text."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{WORD}')"
    return f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS t, least(len(w), {WINDOW}) AS n
  FROM items, unnest(range(1, 2 + greatest(0, len(w) - {WINDOW}))) AS u(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, row_number() OVER () AS rid, {words} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
cut AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM docs, sizes, unnest(range(1, 2 + len(w) - n)) AS u(i) WHERE len(w) >= n),
hits AS (SELECT rid, i, cut.n, item FROM cut JOIN windows USING (t, n)),
spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN spots USING (rid) LEFT JOIN found USING (rid)
"""
