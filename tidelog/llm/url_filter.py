"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

The vocabulary's terms are strict or soft. A term counts where it stands between
boundaries (the ends of the URL or a character that is neither an ASCII letter
nor a digit), in either case of A-Z, in the URL with its percent escapes decoded once (as it
stands where they are no UTF-8); rules and the host and path returned are of the URL as it stands. The lists
here are a small default; ``read_vocabulary`` loads others from a table. A URL is rejected when the weights of its
*distinct* terms reach the threshold: a strict term weighs the threshold, so one
is enough; soft terms weigh less, so several are needed.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule; a null URL has no terms and is allowed; very long URLs are read whole; rules of equal
length tie by their text, the later one first; repeated rows are judged
each by itself; an empty table gives an empty result; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Iterable, Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_LOWER, ASCII_UPPER

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: One of these rejects a URL.
STRICT = ["porn", "xxx", "hentai", "escort", "casino", "viagra", "warez", "torrent"]
#: Several of these together reject a URL, by their weights against THRESHOLD.
SOFT = {
    "adult": 1.0, "sex": 1.0, "nude": 1.0, "cam": 1.0, "cams": 1.0, "dating": 1.0, "bet": 1.0, "betting": 1.0,
    "poker": 1.0, "slots": 1.0, "bonus": 1.0, "pills": 1.0, "crack": 1.0, "keygen": 1.0, "free": 0.5, "download": 0.5,
    "hot": 0.5, "girls": 0.5, "win": 0.5, "cheap": 0.5,
}
THRESHOLD = 2.0

_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
_URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.DOTALL)
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, its A-Z lower-cased, and path."""
    found = _URL.match(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def matching_rule(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str, str] | None:
    """The longest rule that fits, as (rule, verdict)."""
    fit = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: (len(x[0]), x[0]), default=None)


def decoded(url: str) -> str:
    """The URL with its percent escapes decoded once; as it stands where that gives no UTF-8."""
    if "%" not in url:
        return url
    try:
        return urllib.parse.unquote_to_bytes(url).decode()
    except UnicodeDecodeError:
        return url


#: Terms of a vocabulary at most: each Python worker holds its automaton.
MAX_VOCABULARY = 1_000_000


def read_vocabulary(terms: DataFrame, term: str = "term", weight: str = "weight") -> tuple[list[str], dict[str, float]]:
    """Strict terms (a null weight) and soft ones with their weights, of a table; of a repeated term the strict or heavier one counts.

    Null and empty terms are left out. More than MAX_VOCABULARY terms raise a ValueError.
    """
    rows = terms.select(F.translate(F.trim(F.col(term)), ASCII_UPPER, ASCII_LOWER).alias("t"), F.col(weight).cast("double").alias("w")).where("t <> ''")
    rows = rows.groupBy("t").agg(F.max(F.coalesce("w", F.lit(float("inf")))).alias("w")).limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} terms")
    return sorted(r["t"] for r in rows if r["w"] == float("inf")), {r["t"]: r["w"] for r in rows if r["w"] != float("inf")}


class Vocabulary:
    """Terms with weights in one automaton."""

    def __init__(self, strict: Iterable[str], soft: Mapping[str, float], threshold: float):
        self.weights = {k.translate(_LOWER): float(v) for k, v in soft.items()} | {k.translate(_LOWER): float(threshold) for k in strict}
        self.threshold = threshold
        self.automaton = ahocorasick.Automaton()
        for term in self.weights:
            self.automaton.add_word(term, term)
        if self.weights:
            self.automaton.make_automaton()

    def hits(self, url: str | None) -> list[str]:
        """Distinct terms of a URL that stand between boundaries, sorted."""
        if not url or not self.weights:
            return []
        low = decoded(url).translate(_LOWER)
        found = set()
        for end, term in self.automaton.iter(low):
            start = end + 1 - len(term)
            if (start == 0 or low[start - 1] not in _WORD) and (end + 1 == len(low) or low[end + 1] not in _WORD):
                found.add(term)
        return sorted(found)

    def weight(self, terms: Iterable[str]) -> float:
        return sum(self.weights[t] for t in terms)


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = tuple(RULES),
    strict: Sequence[str] = tuple(STRICT),
    soft: Mapping[str, float] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Host, path, rule, verdict, terms and weight of every URL."""
    soft = dict(SOFT if soft is None else soft)
    narrow = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, host string, path string, rule string, verdict string, terms array<string>, weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(strict, soft, threshold)
        for batch in batches:
            rows = []
            for u in batch.column("url").to_pylist():
                host, path = split_url(u)
                terms = words.hits(u)
                weight = words.weight(terms)
                rule, verdict = matching_rule(host, path, rules) or (None, "block" if weight >= threshold else "allow")
                rows.append((host, path, rule, verdict, terms, weight))
            host, path, rule, verdict, terms, weight = map(list, zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(terms, pa.list_(pa.string())), pa.array(weight, pa.float64())],
                ["key", "host", "path", "rule", "verdict", "terms", "weight"],
            )

    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)


def op6_url_vocabulary(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL, its rule or else its terms."""
    out = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.array_join("terms", ",").alias("terms"), "weight")


def oracle() -> str:
    """The same in DuckDB, its terms found one by one with regular expressions."""
    terms = SOFT | dict.fromkeys(STRICT, THRESHOLD)
    listed = ", ".join(f"('{t}', {w})" for t, w in sorted(terms.items()))
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH vocabulary(term, weight) AS (VALUES {listed}),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
cut AS (SELECT page_id, url, row_number() OVER () AS rid, strpos(url, '://') AS mark FROM pages),
parts AS (
  SELECT page_id, url, rid,
    CASE WHEN mark > 0 THEN translate(regexp_extract(substr(url, mark + 3), '^[^/?#]*'), '{ASCII_UPPER}', '{ASCII_LOWER}') ELSE '' END AS host,
    CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut),
fits AS (
  SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rules.verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid),
found AS (
  SELECT rid, string_agg(term, ',' ORDER BY term) AS terms, sum(weight) AS weight
  FROM parts JOIN vocabulary ON regexp_matches(translate(coalesce(TRY(url_decode(url)), url), '{ASCII_UPPER}', '{ASCII_LOWER}'), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY rid)
SELECT page_id, host, path, fits.rule, coalesce(fits.verdict, CASE WHEN coalesce(weight, 0) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(terms, '') AS terms, coalesce(weight, 0)::DOUBLE AS weight
FROM parts LEFT JOIN fits USING (rid) LEFT JOIN found USING (rid)
"""
