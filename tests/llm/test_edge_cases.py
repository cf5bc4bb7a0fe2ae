"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tidelog.llm import byte_bpe, decontamination, imatch, language_id, near_dedup, secrets, sharding, toxicity, url_filter, warc

LONG = "wörd alpha beta gamma " * 30_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here.", "en", "a", 68),
    (2, "The quick brown fox jumps over the lazy dog and runs away from here.", "en", "a", 68),
    (2, "The quick brown fox jumps over the lazy dog and runs away from here.", "en", "a", 68),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, LONG, "de", "b", len(LONG)),
    (None, "zwei drei vier fünf sechs sieben acht", "de", "c", 10),
    (None, None, None, None, None),
    (7, "123 456 !!", "de", "c", 10),
    (8, 'cfg password = "hunter2secret9X" é end', "en", "c", 10),
    (9, "한글 \U0001f642 emoji \x00 nul", "ko", "c", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    plain = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("key", "h", "th", "cls", "cid", "token", "score", "lang_pred", "ids", "_k", "c0", "label", "shard", "n"):
        plain = plain.withColumn(name, F.lit(f"own {name}"))
    return plain


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_imatch(docs, empty):
    rows = imatch.edited_fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    prints = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[1] == prints[2] and prints[3] == prints[4]
    assert {r.n_chars for r in rows if r.doc_id == 5} == {len(LONG)}
    assert imatch.edited_fingerprints(empty).count() == 0


def test_byte_bpe(docs, empty):
    rows = {(r.doc_id, r.n_tokens) for r in byte_bpe.encode_documents(docs).collect()}
    assert (3, 0) in rows and (4, 0) in rows and (None, 0) in rows
    assert byte_bpe.encode_documents(empty).count() == 0
    kept = byte_bpe.with_tokens(docs)
    assert set(kept.columns) == {*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"}
    r = byte_bpe.with_tokens(docs.where("doc_id = 9"), with_offsets=True).first()
    assert len(r.starts) == len(r.ends) == r.n_tokens and r.starts[0] == 0 and r.ends[-1] == len(ROWS[-1][1])
    texts = byte_bpe.decode_ids(kept.select("doc_id", "ids")).where("doc_id = 9").first().text
    assert texts == ROWS[-1][1]


def test_sharding(docs, empty):
    rows = sharding.shard_records(docs, "doc_id", "text", [1.0] * 8, [1.0] * 9).collect()
    assert len(rows) == len(ROWS)
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {1}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.shard_records(empty, "doc_id", "text", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [1.0, 0.0])


def test_near_components(docs, empty):
    rows = near_dedup.near_components(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r.component_id, r.kept) for r in rows if r.doc_id in (1, 2)} == {(1, True), (1, False)}
    assert all(r.component_id == r.doc_id and r.kept and r.n_shingles == 0 for r in rows if r.doc_id in (3, 4))
    assert near_dedup.near_components(empty).count() == 0
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 0, 1, 3, 4, 5, 7, 8, 9]
    assert near_dedup.drop_near_duplicates(empty).count() == 0
    again = docs.unionByName(docs.where("doc_id = 1"))
    assert near_dedup.drop_near_duplicates(again).where("doc_id = 1").count() == 1


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\n", "x"), (2, None, None), (3, "b", "x"), (3, "b", "x"), (None, "c", "x"), (4, "d", ""), (5, "e", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("digest", F.lit("own"))
    warc.write_warc(pages, f"file://{tmp_path}/w", file_bytes=300)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect())
    assert got == [(0, 1, "revisit", 3), (1, 1, "revisit", 3), (2, 0, "revisit", 4), (3, 1, "response", None), (3, 1, "revisit", 3), (4, 0, "response", None), (5, len(LONG.encode()), "response", None)]
    texts = warc.read_warc(spark, f"file://{tmp_path}/w", with_payload=True).where("page_id = 5").first()
    assert bytes(texts.payload).decode() == LONG
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_notices_a_changed_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 50)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    path = next((tmp_path / "w" / "archives").iterdir())
    bad = warc.record(1, "u", b"x" * 50, None, warc.DATE).replace(b"x" * 50, b"x" * 49 + b"y")
    path.write_bytes(warc._member(bad))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_warc(spark, f"file://{tmp_path}/w").collect()


def test_url_filter(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://Sub.EXAMPLE.net/en/x"), (5, "http://x.net/"), (6, "http://x.net"), (7, "http://a.org/fr/casino"), (8, "http://a.com/casino?x"), (9, "http://a.com/casinos"), (10, "http://a.com/sex/dating"), (11, "http://a.com/sex/sex"), (None, "http://a.com/free-girls?cheap=win")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("own"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("sub.example.net", "/en/x", "example.net/en/", "allow"), 5: ("x.net", "/", "net/", "block"), 6: ("x.net", "", None, "allow"),
        7: ("a.org", "/fr/casino", "org/fr/", "allow"), 8: ("a.com", "/casino", None, "block"), 9: ("a.com", "/casinos", None, "allow"), 10: ("a.com", "/sex/dating", None, "block"), 11: ("a.com", "/sex/sex", None, "allow"),
        None: ("a.com", "/free-girls", None, "block"),
    }
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_language(docs, empty):
    model = language_id.learn(docs)
    out = language_id.predict(docs, model, with_spans=True)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 7)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    none = language_id.predict(docs, language_id.learn(empty)).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    assert language_id.predict(empty, model).count() == 0
    left = language_id.reject_unknown(docs)
    assert left.columns == docs.columns and {r.score for r in left.collect()} == {"own score"}


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "Brown fox JUMPS over the lazy dog and runs away from"), (2, "vier fünf"), (3, None), (4, "!!"), (2, "vier fünf"), (5, "emoji"), (6, "nowhere at all")], "item_id long, text string").withColumn("token", F.lit("own"))
    rows = decontamination.contamination(docs, items).collect()
    assert len(rows) == len(ROWS)
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids)) for r in rows}
    assert (1, 14, 11, 1, "1") in got and (None, 7, 2, 1, "2") in got and (9, 4, 1, 1, "5") in got and (3, 0, 0, 0, "") in got
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(empty, items).count() == 0
    left = decontamination.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 3, 4, 5, 7, 8]


def test_toxicity(spark, docs, empty):
    marks = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (5, None), (9, 0)], "doc_id long, toxic int").withColumn("score", F.lit("own"))
    rows = toxicity.score_documents(docs, marks).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(empty, marks).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, marks.limit(0)).collect()} == {0.0}


def test_secrets(docs, empty):
    rows = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert rows[8].spans == "assign:4:31,pair:16:31" and rows[8].n_assign == 1
    assert rows[3].spans == "" and rows[3].n_hex == 0
    assert secrets.find_secrets(empty).count() == 0
    left = secrets.redact_secrets(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS)
    r = left.where("doc_id = 8").first()
    assert r.text == 'cfg [SECRET]" é end' and r.n_chars == len(r.text)
    assert left.where("text is null and n_chars is null").count() == 2
    assert isinstance(left.schema["n_chars"].dataType, T.LongType)


def test_samples_count_documents(spark):
    """A repeated document with the lowest hash takes one place of a sample, not all."""
    ids = [r.i for r in spark.range(60).select(F.col("id").alias("i")).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, f"ein kleines wort {i}", "de", 0) if n % 2 else (i, f"some vile words here {i}", "en", 1) for n, i in enumerate(ids)]
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    copies = once.unionByName(once.where(f"doc_id = {ids[0]}").crossJoin(spark.range(500).drop("id")))
    few, many = (language_id.learn(d, max_docs=20) for d in (once, copies))
    assert many.langs == few.langs == ["de", "en"] and many.index == few.index and (many.scores == few.scores).all()
    few, many = ({(r.doc_id, r.nearest) for r in toxicity.score_documents(d, once.select("doc_id", "toxic"), max_sample=50).collect()} for d in (once, copies))
    assert many == few and len({near for _, near in many}) > 1


@pytest.fixture
def own_tables(spark, docs, tmp_path):
    """The rows of this module as tables of their own: documents with repeated rows, nulls, a very long text and clashing columns."""
    twice = docs.unionByName(docs.where("doc_id = 5"))
    twice.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, "vier fünf sechs"), (2, None), (3, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_of_odd_rows(spark, own_tables):
    rows = corpus_pipeline.run(spark, own_tables).collect()
    # nulls, the empty text and the one without letters have no language; copies go; one has a benchmark item
    assert sorted(r.doc_id for r in rows) == [1, 5, 8, 9] and {r.token for r in rows} == {"own token"}
    assert {r.n_chars for r in rows if r.doc_id == 5} == {len(LONG)}
    docs = spark.read.parquet(f"{own_tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, own_tables).columns == docs.columns, name
    assert corpus_pipeline.run(spark, f"{own_tables}/none").count() == 0


def test_repeated_rows_without_words_stay(spark):
    """Whatever other rows repeat."""
    rows = [(1, None), (1, None), (2, ""), (2, ""), (3, "a b c d e f"), (4, "one two three four five six")]
    for more in ([], [(3, "a b c d e f")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()) == [1, 1, 2, 2, 3, 4]


def test_url_filter_of_repeated_and_long_urls(spark):
    long = "http://a.com/" + "x/" * 50_000 + "casino"
    pages = spark.createDataFrame([(1, "http://a.com/casino"), (1, "http://a.com/casino"), (2, long)], "page_id long, url string")
    got = sorted((r.page_id, len(r.path), r.verdict) for r in url_filter.judge_urls(pages).collect())
    assert got == [(1, 7, "block"), (1, 7, "block"), (2, len(long) - len("http://a.com"), "block")]


def test_url_filter_decodes_and_loads(spark, tmp_path):
    import duckdb

    from tidelog.llm import url_filter

    urls = ["http://a.com/%63asino", "http://a.com/%2563asino", "http://a.com/%zz/casino", "http://a.com/%FF/casino", "http://a.com/x%2Fcasino%2Fy", "http://%63asino.com/", "http://a.com/%C3%A9casino", "http://a.com/casino%C3%A9", "%", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = {r[0]: r[1:] for r in con.execute(f"SELECT page_id, host, path, rule, verdict, terms, weight FROM ({url_filter.oracle()})").fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.terms, r.weight) for r in url_filter.op6_url_vocabulary(spark, str(tmp_path)).collect()}
    assert got == expected and [got[i][3] for i in range(6)] == ["block", "allow", "block", "block", "block", "block"]
    terms = spark.createDataFrame([("Bad", None), ("meh", 1.0), ("MEH", 0.5), ("so", 1.0), ("so", None), (None, 1.0), (" ", 1.0)], "term string, weight double")
    strict, soft = url_filter.read_vocabulary(terms)
    assert (strict, soft) == (["bad", "so"], {"meh": 1.0})
    out = url_filter.judge_urls(pages.limit(1), strict=["a"], soft={})
    assert out.first().verdict == "block"
