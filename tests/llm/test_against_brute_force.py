"""Operators against plain versions of the same rules."""

import base64
import collections
import functools
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.test_queries import canonical
from tidelog.llm import _common, byte_bpe, decontamination, imatch, language_id, near_dedup, registry, secrets, sharding, toxicity, warc
from tidelog.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(found.fetchall(), columns)


def test_imatch(spark, texts):
    rows = {r.doc_id: r for r in rows_of(spark, "op1_imatch")}
    ids = sorted(texts)
    counts = collections.Counter(w for t in texts.values() for w in set(t.encode().lower().split()))
    import xxhash

    high = max(2, int(len(texts) * imatch.MOST_SHARE))
    band = {w for w, n in counts.items() if 2 <= n <= high}
    masks = imatch.Fingerprints(np.empty(0, np.uint64)).masks

    def plain(text):
        words = set(text.encode().lower().split())
        own = words & band if len(words & band) >= imatch.LEAST else words
        terms = sorted(xxhash.xxh64_intdigest(w) for w in own)
        kept = {t: int(masks(np.array([t], np.uint64))[0]) for t in terms}
        groups = [terms] + [[t for t in terms if kept[t] >> i & 1] for i in range(len(imatch.CHANCES))]
        return "".join(f"{(xxhash.xxh32_intdigest(np.array(g, np.uint64).tobytes()) or 1) if g else 0:08x}" for g in groups)

    def alike(a, b):
        pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
        pairs = [p for p in pairs if p != ("0" * 8, "0" * 8)]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0

    for i, d in enumerate(ids):
        t, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        k = len(t) // 4
        changed = t[: len(t) - k] + after[:k]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain(t), plain(changed))
        assert abs(r.near_edited - alike(plain(t), plain(changed))) < 1e-9 and abs(r.near_next - alike(plain(t), plain(after))) < 1e-9


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.vocabulary(*byte_bpe._published())


@pytest.fixture(scope="module")
def reference_bpe():
    path, pattern = byte_bpe._published()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, texts, reference_bpe):
    for r in rows_of(spark, "op2_byte_bpe"):
        ids = reference_bpe.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_byte_bpe_on_odd_texts(bpe, reference_bpe):
    rng = random.Random(5)
    alphabet = "aaab  !!--##..==\n\n\t\r01'sé中한🙂👍🏽‍\x00"
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) * rng.randint(1, 12) for _ in range(rng.randint(1, 8)))
        ids = np.frombuffer(bpe.encode(s), "<u4").tolist()
        assert ids == reference_bpe.encode_ordinary(s) and bpe.decode(ids) == s
        offset_ids, offsets = bpe.encode_with_offsets(s)
        assert offset_ids == ids
        at = 0
        for i, (a, z) in zip(ids, offsets, strict=True):
            raw = bpe.decode_bytes([i])
            assert s.encode()[at : at + len(raw)] == raw and len(s.encode()[:at].decode("utf-8", "ignore")) == a
            at += len(raw)
            assert z == len(s.encode()[:at].decode("utf-8", "ignore")) + (s.encode()[:at].decode("utf-8", "ignore").encode() != s.encode()[:at])
    with pytest.raises(ValueError):
        bpe.decode([10**7])


def test_byte_bpe_forgets_and_goes_on(monkeypatch, reference_bpe):
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    small = byte_bpe.ByteBPE(*byte_bpe._published())
    for s in ("a b c d e f a b", "x y a b", "q" * 100 + " a"):
        assert np.frombuffer(small.encode(s), "<u4").tolist() == reference_bpe.encode_ordinary(s)


def test_sharding(spark, texts):
    rows = rows_of(spark, "op3_rendezvous_sharding")
    assert len(rows) == len(texts)

    def score(d, s):
        return int(hashlib.md5(f"{d}:{s}".encode()).hexdigest()[:13], 16)

    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.shard == max(range(8), key=lambda s: (score(r.doc_id, s), -s))
        assert r.grown_shard == max(range(9), key=lambda s: (score(r.doc_id, s), -s))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_weighted_shards_follow_their_weights(spark):
    keys = spark.range(20_000)
    got = dict(keys.groupBy(sharding.rendezvous(F.col("id"), [1.0, 1.0, 2.0]).alias("s")).count().collect())
    assert abs(got[2] - 10_000) < 400 and abs(got[0] - 5_000) < 400


def components(sets, num, den):
    """Smallest member of each one's component, by an inverted list of all items."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in inverted[x] if j < i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def test_near_duplicates(spark, texts):
    sets = {d: shingles(t, 3) for d, t in texts.items()}
    expected = components(sets, 85, 100)
    for r in rows_of(spark, "op4_tensored_minhash"):
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_near_duplicates_in_a_hot_group(spark, monkeypatch):
    """Many edits of one text, in chains, with blocks of a few members so that groups are cut."""
    monkeypatch.setattr(near_dedup, "SOUGHT_BLOCK", 4)
    monkeypatch.setattr(near_dedup, "HELD_BLOCK", 8)
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows, now = [], list(base)
    for i in range(160):
        if i % 40 == 0:
            now = list(base)
            for _ in range(4):
                now[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        now[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(now)))
    expected = components({i: shingles(t, 3) for i, t in rows}, 85, 100)
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, num=85, den=100, halves=14).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert len(set(expected.values())) < 160


def test_without_broadcasts(spark, texts, monkeypatch):
    """Sides that are too large to broadcast are shuffled, with the same results."""
    monkeypatch.setattr(_common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = components({d: shingles(t, 5) for d, t in texts.items()}, 80, 100)
    left = near_dedup.drop_near_duplicates(docs)
    assert {r.doc_id for r in left.select("doc_id").collect()} == {d for d in texts if expected[d] == d}
    hit = {r.doc_id for r in decontamination.contamination(docs, items).where("contaminated").collect()}
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, items).select("doc_id").collect()} == set(texts) - hit


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.v: r.label for r in near_dedup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_components_in_few_steps(spark, monkeypatch):
    """Edges that one task's forest holds need no steps between tasks, of which each costs the driver plans; others take them."""
    tags = []
    monkeypatch.setattr(near_dedup, "written", lambda df, tag, write=near_dedup.written: (tags.append(tag), write(df, tag))[1])
    path = spark.createDataFrame([(i, i + 1) for i in range(0, 90, 2)] + [(i, i + 1) for i in range(1, 90, 2)], "a long, b long").repartition(4)
    assert {tuple(r) for r in near_dedup.connected_components(path).collect()} == {(i, 0) for i in range(91)}
    assert tags == ["edges"]
    assert {tuple(r) for r in near_dedup.connected_components(path, most=7).collect()} == {(i, 0) for i in range(91)}
    assert "stars" in tags
    assert near_dedup.connected_components(path.limit(0)).count() == 0


def test_warc(spark, duck):
    pages = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    rows = rows_of(spark, "op5_warc")
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    last = {}
    for p in sorted(pages):
        last[pages[p]] = p
    for r in rows:
        raw, to = pages[r.page_id].encode(), last[pages[r.page_id]]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if to == r.page_id else ("revisit", to))


def test_warc_is_deterministic(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    made = []
    for i, n in enumerate((2, 5)):
        uri = f"file://{tmp_path}/{i}"
        warc.write_warc(pages.repartition(n), uri, file_bytes=20_000, range_bytes=50_000)
        made.append({p.name: p.read_bytes() for p in (tmp_path / str(i) / "archives").iterdir()})
        assert not (tmp_path / str(i) / "temporary").exists()
    assert made[0] == made[1] and len(made[0]) > 3


def test_language_holds_out(spark, duck):
    spark_rows = language_id.op7_language_viterbi(spark, "/root/testdata/sf0.01").collect()
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    out = [r for r in spark_rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in spark_rows)
    assert sum(lang[r.doc_id] == r.lang_pred for r in out) / len(out) > 0.97


def test_viterbi_equals_one_by_one():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 7, 3, 0, 12])
    scores = rng.normal(size=(lengths.sum(), 3))

    def single(s):
        best, back = s[0], []
        for row in s[1:]:
            step = np.where(np.eye(3, dtype=bool), best[:, None], best[:, None] - 1.0)
            back.append(step.argmax(0))
            best = step.max(0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    ends = np.cumsum(lengths)
    expected = [x for n, e in zip(lengths, ends, strict=True) if n for x in single(scores[e - n : e])]
    assert language_id.viterbi(scores, lengths, 1.0).tolist() == expected


def test_mixed_text_falls_into_spans(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the house is big and the dog runs with water", "en"), ("das haus ist gross und der hund läuft mit wasser", "de"), ("дом большой и собака бежит", "ru")] * 4)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = "the dog and the house is big with water, дом большой и собака бежит. das haus und der hund ist gross mit wasser"
    r = language_id.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, with_spans=True).first()
    assert [s.lang for s in r.spans] == ["en", "ru", "de"]
    assert mixed[r.spans[1].start : r.spans[1].end] == "дом большой и собака бежит"


def test_decontamination_at_window_edges(spark):
    item = " ".join(f"t{i}" for i in range(14))
    docs = [(0, item), (1, "x " + " ".join(f"T{i}" for i in range(2, 12)) + " y"), (2, " ".join(f"t{i}" for i in range(5, 14))), (3, "a " + item + " b " + item)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: (14, 14, True), 1: (12, 10, True), 2: (9, 0, False), 3: (30, 28, True)}


def test_lower_casing_of_other_scripts_does_not_hit(spark):
    item = " ".join(["étude"] * 2 + [f"ß{i}" for i in range(9)])
    # windows of ten words hold an "étude" each; É is another letter than é, E is the same as e
    docs = [(0, item), (1, item.replace("étude", "Étude")), (2, item.replace("étude", "éTUDE"))]
    got = {r.doc_id: r.contaminated for r in decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    idf = rng.uniform(0.5, 3, 40)
    draw = lambda: (sorted(rng.choice(40, rng.integers(1, 8), replace=False).tolist()),)
    examples = [(ids := draw()[0], rng.integers(1, 5, len(ids)).tolist()) for _ in range(500)]
    index = toxicity.BlockMaxIndex(idf, examples, [0] * 500, block=16)
    dense = np.zeros((500, 40))
    for i, (ids, tfs) in enumerate(examples):
        at, w = index.weigh(ids, tfs)
        dense[i, at] = w
    for _ in range(100):
        ids = draw()[0]
        tfs = rng.integers(1, 5, len(ids)).tolist()
        at, w = index.weigh(ids, tfs)
        cosine = np.minimum(1.0, np.round(dense[:, at] @ w, 9))
        expected = [i for i in sorted(range(500), key=lambda i: (-cosine[i], i)) if cosine[i] > 0][:10]
        found, cosines = index.nearest(ids, tfs, 10)
        assert np.allclose(cosines, cosine[expected], atol=1e-8) and found.tolist() == expected


def language_model():
    rows = [(lang, f, 50) for lang, text in (("en", "the house is here"), ("zh", "天地玄黄宇宙洪荒")) for w in text.split() for f in language_id.grams(w)]
    return language_id.Model([*rows, ("en", "script:latin", 9000), ("zh", "script:han", 9000), ("zh", "script:latin", 10)])


def test_language_scripts_exclude():
    scorer = language_id.Scorer(language_model())
    for n in (1, 4):
        text = "the house is here " * 5 + "天地玄黄 " * n + "the house is here " * 5
        (spans,) = language_id._predicted([text], scorer, True)[3]
        assert [x["lang"] for x in spans] == ["en", "zh", "en"]
    text = ("the house is here " + ("天地玄黄宇宙洪荒天地玄黄宇宙洪" * 2 + " ") * 2) * 20
    pred, _, n_spans, _ = language_id._predicted([text], scorer, False)
    assert pred == ["zh"] and n_spans == [40]
    # a script that no language has leaves all of them
    assert np.isfinite(language_model().word_scores(["αβγ"])).all()
    # long words carry weight
    assert language_model().word_scores(["宇宙洪荒" * 8, "the"])[0].min() == -np.inf


def test_language_reads_whole_runs():
    scorer = language_id.Scorer(language_model())
    text = "house" + "天地玄黄宇宙洪荒" * 50 + "house" * 40
    (spans,) = language_id._predicted([text], scorer, True)[3]
    assert [(x["lang"], x["start"], x["end"]) for x in spans] == [("en", 0, 5), ("zh", 5, 405), ("en", 405, 605)]
    words = language_id.words_of(text)
    assert "".join(words) == text and max(map(len, words)) == language_id.PIECE
    assert language_id.words_of("naïve e\u0301te\u0301 Москва") == ["naïve", "e\u0301te\u0301", "Москва"]


def test_language_keeps_features_of_rare_languages(spark):
    rows = [(i, f"common words {i:03d} of many kinds are here again", "en") for i in range(300)] + [(1000, "xyzzy plugh", "xx")]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_features=24)
    assert model.langs == ["en", "xx"] and "xyz" in model.index


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert np.all(np.diff(y) >= 0) and np.interp(0.25, x, y) == 0.5 and y[-1] == 1.0


def test_toxicity_holds_out(spark):
    rows = toxicity.op9_nearest_toxicity(spark, "/root/testdata/sf0.1").collect()
    label = dict(duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    out = [r for r in rows if r.held_out and r.doc_id in label]
    hit = sum(r.predicted and label[r.doc_id] for r in out)
    assert hit / sum(label[r.doc_id] for r in out) > 0.85 and hit / sum(r.predicted for r in out) > 0.8


@pytest.mark.parametrize("toxic", [40, 60])
def test_toxicity_where_many_labels_are_toxic(spark, toxic):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=30) + ["vile", "scum"] * (i % 100 < toxic)), int(i % 100 < toxic)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs.drop("toxic"), docs.where("doc_id < 500").drop("text")).collect()}
    assert all((scores[i] >= 0.3) == bool(label) for i, _, label in rows if i >= 500)


_KINDS = {
    "assign": (r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, lambda m: len(m[1]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
}


def test_secrets(spark, texts):
    order = list(_KINDS)
    for r in rows_of(spark, "op10_assignment_secrets"):
        base = [(m.start(), order.index(k), m.end()) for k, (p, flags, ok) in _KINDS.items() for m in re.finditer(p, texts[r.doc_id], flags) if ok(m)]
        joined = ",".join(f"{order[k]}:{a}:{z}" for a, k, z in sorted(base))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[1] == i for b in base) for i in range(3)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_secrets_follow_constants():
    text = 'K = "Zx9!kdkJ3mm2pQ"\npart = "q8Z#"\ndb.password = K\nsecret_key: part + "77xYpP"\nnote = "Zx9!other22AB"\npassword = "changeme"\n'
    spans = secrets.scan(text.encode())
    found = {text[s.start : s.end]: s.name for s in spans if s.kind == 3}
    assert found["Zx9!kdkJ3mm2pQ"] == "db.password" and found["q8Z#"] == "secret_key" and found["77xYpP"] == "secret_key"
    assert "Zx9!other22AB" not in found and "changeme" not in found


@pytest.mark.parametrize(
    "line, secret",
    [
        ('SIGNING_KEY = "9F86D081884C7D659A2FEAA0C55AD015"', "9F86D081884C7D659A2FEAA0C55AD015"),
        ('SORTKEY = "9F86D081884C7D659A2FEAA0C55AD015"', "9F86D081884C7D659A2FEAA0C55AD015"),
        ('session: "ABCDEFGH2IJKLMNOPQ34RSTU"', "ABCDEFGH2IJKLMNOPQ34RSTU"),
        ('pwd = "zebraumbrella"', "zebraumbrella"),
        ('passphrase = "correct horse battery staple"', "correct horse battery staple"),
        ('pwd = "changeme"', None),
        ('passphrase = "enter your passphrase"', None),
        ('cache_key = "user_profile"', None),
        ('key = "chapter seven"', None),
        ('pwd = "xxxxxxxx"', None),
    ],
)
def test_secrets_of_any_kind(line, secret):
    found = [line[s.start : s.end] for s in secrets.scan(line.encode()) if s.kind == 3]
    assert found == ([secret] if secret else [])


def test_pipeline(spark, texts, duck):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "tokens"]
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    docs = dict(rows)
    languages = plain_languages(duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet'").fetchall())
    docs = {d: t for d, t in docs.items() if languages[d][0] != "und" and languages[d][1] >= 0.2}
    expected = components({d: shingles(t, 5) for d, t in docs.items()}, 80, 100)
    docs = {d: t for d, t in docs.items() if expected[d] == d}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    windows = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall():
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    assert all(len(w) == 10 for w in windows)
    docs = {d: t for d, t in docs.items() if not any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))}

    def redacted(t):
        """Every character inside a span goes; a stretch of them is one mark."""
        inside = [False] * (len(t) + 1)
        for k, (p, flags, ok) in _KINDS.items():
            for m in re.finditer(p, t, flags):
                if ok(m):
                    inside[m.start() : m.end()] = [True] * (m.end() - m.start())
        for span in secrets.scan(t.encode()):
            if span.kind == 3:
                inside[span.start : span.end] = [True] * (span.end - span.start)
        out, was = [], False
        for c, hidden in zip(t, inside, strict=False):
            if hidden and not was:
                out.append("[SECRET]")
            if not hidden:
                out.append(c)
            was = hidden
        return "".join(out)

    docs = {d: redacted(t) for d, t in docs.items()}
    got = {r.doc_id: (r.n_chars, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_chars", "decoded_sha256").collect()}
    assert got == {d: (len(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs.items()}


def test_warc_rolls_files_at_the_default_sizes(spark, tmp_path):
    """Random pages of one range's default size: several files, each closed at its size, in order of keys."""
    rng = random.Random(4)
    size = warc.RANGE_BYTES // 2000
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz <>", k=size // 2)) * 2) for i in range(2000)]
    uri = f"file://{tmp_path}/w"
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), uri).orderBy("name").collect()
    ranges = {m.name[:12] for m in manifest}
    assert len(ranges) < len(manifest) / 2 and sum(m.records for m in manifest) == 2000
    last = {m.name[:12]: m.name for m in manifest}
    assert all(warc.FILE_BYTES <= m.bytes < 2 * warc.FILE_BYTES for m in manifest if m.name != last[m.name[:12]])
    assert {(r.page_id, r.payload_bytes) for r in warc.read_warc(spark, uri).collect()} == {(i, len(t)) for i, _, t in rows}


def test_warc_splits_a_hot_key(spark, tmp_path):
    """Of many rows with one key or none, ranges take their share."""
    rows = [(7 if i % 3 else None, f"http://h/{i}", f"page {i} " * 20) for i in range(900)]
    uri = f"file://{tmp_path}/w"
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), uri, range_bytes=10_000, file_bytes=10**6).collect()
    assert len(manifest) > 5 and max(m.records for m in manifest) < 300
    got = warc.read_warc(spark, uri).collect()
    assert len(got) == 900 and all(r.record_type == "response" for r in got)


def test_warc_reads_many_small_records_in_linear_time():
    import io
    import time

    body = b"".join(warc._member(warc.record(i, "u", b"x", None, warc.DATE)) for i in range(4000))
    began = time.time()
    assert sum(1 for _ in warc.records_of(io.BytesIO(body))) == 4000 and time.time() - began < 3


@pytest.mark.parametrize("limit", [-1, 200_000])
def test_decontamination_of_a_very_long_document(spark, monkeypatch, limit):
    """100,000 words with a passage in the middle, beside a copy without its key, with and without broadcasts."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    item = " ".join(f"t{i}" for i in range(12))
    long = " ".join(f"w{i % 977}" for i in range(50_000)) + " " + item + " " + " ".join(f"t{i % 7}" for i in range(50_000))
    docs = spark.createDataFrame([(1, long), (None, long), (2, item + " t3"), (2, item + " t3"), (3, "t0 t1 t2")], "doc_id long, text string")
    items = spark.createDataFrame([("a", item), ("b", " ".join(f"t{i}" for i in range(1, 13))), ("c", "t0 t1 t2")], "item_id string, text string")
    held = {"a": item.split(), "b": [f"t{i}" for i in range(1, 13)], "c": ["t0", "t1", "t2"]}
    windows = [(i, w[a : a + 10]) for i, w in held.items() for a in range(max(1, len(w) - 9))]

    def plain(text):
        words, hit, own = text.split(), set(), set()
        for i, w in windows:
            for at in range(len(words) - len(w) + 1):
                if words[at] == w[0] and words[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    own.add(i)
        return len(words), len(hit), ",".join(sorted(own))

    got = {(r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in decontamination.contamination(docs, items).collect()}
    assert got == {(r.doc_id, *plain(r.text)) for r in docs.collect()} and ("a,b,c" in {g[3] for g in got})


def plain_languages(rows):
    """(language, score) of every document, by plain loops; rows: (doc_id, text, lang)."""
    import math

    import regex

    word = regex.compile(r"\p{L}[\p{L}\p{M}]*")

    def pieces(text):
        return [x for run in word.findall(text.lower()) for x in language_id._cut(run)]

    def ngrams(w):
        return [f"<{w}>"[i : i + n] for n in (2, 3, 4) for i in range(len(w) + 3 - n)]

    counts, letters = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for d, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            for w in pieces(text):
                counts[lang].update(ngrams(w))
                letters[language_id.script_of(w[0])][lang] += len(w)
    langs = sorted(counts)
    size = len({g for c in counts.values() for g in c})
    below = {x: sum(counts[x].values()) + 0.5 * size for x in langs}

    @functools.cache
    def word_score(w):
        raw = [sum(math.log((counts[x][g] + 0.5) / below[x]) for g in ngrams(w)) for x in langs]
        own = letters.get(language_id.script_of(w[0]))
        shut = [own[x] / max(1, sum(own.values())) < language_id.SCRIPT_SHARE for x in langs] if own else [False] * len(langs)
        if any(shut) and not all(shut):
            raw = [-math.inf if s else v for s, v in zip(shut, raw, strict=True)]
        best, floor = max(raw), -language_id.FLOOR * max(1.0, len(w) / language_id.FLOOR_LETTERS)
        return [v if v == -math.inf else max(v - best, floor) for v in raw]

    def plain(text):
        words = pieces(text or "")
        if not words:
            return "und", 0.0
        scores = [word_score(w) for w in words]
        value, back = scores[0], []
        for s in scores[1:]:
            top = max(range(len(langs)), key=lambda i: (value[i], -i))
            step = [top if value[i] < value[top] - language_id.SWITCH else i for i in range(len(langs))]
            back.append(step)
            value = [(value[top] - language_id.SWITCH if step[i] == top and i != top else value[i]) + s[i] for i in range(len(langs))]
        path = [max(range(len(langs)), key=lambda i: (value[i], -i))]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        mass = [sum(len(w) for w, x in zip(words, path, strict=True) if x == i) for i in range(len(langs))]
        top = max(range(len(langs)), key=lambda i: (mass[i], -i))
        own = [s for s, x in zip(scores, path, strict=True) if x == top]
        mean = [sum(s[i] for s in own) / len(own) * min(20, len(own)) for i in range(len(langs))]
        return langs[top], mass[top] / sum(mass) / sum(math.exp(m - mean[top]) for m in mean)

    return {d: plain(t) for d, t, _ in rows}


def test_language_query_equals_a_plain_version(spark):
    """Counts, word scores, Viterbi and document scores over every document of the fixture."""
    expected = plain_languages(duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall())
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows_of(spark, "op7_language_viterbi")}
    assert got.keys() == expected.keys()
    assert all(got[d][0] == x[0] and abs(got[d][1] - x[1]) < 1e-3 for d, x in expected.items())


def test_toxicity_numbers_equal_plain_counts(monkeypatch):
    """Terms and counts as they are stored, 32 bits each, also where a worker forgets its words on the way."""
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 40)
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    terms = sorted({t for w in words[:60] for t in toxicity.terms_of(w)})
    vocabulary = toxicity.Vocabulary(terms)
    for size in (0, 1, 5, 90):
        counts = collections.Counter(rng.choices(words, k=size))
        want = collections.Counter(t for w, n in counts.items() for t in toxicity.terms_of(w) for _ in range(n))
        ids, tfs = vocabulary.numbers(counts)
        assert ids.dtype == tfs.dtype == np.int32
        assert list(zip(ids.tolist(), tfs.tolist(), strict=True)) == [(i, want[t]) for i, t in enumerate(terms) if want[t]]
    assert vocabulary.numbers(collections.Counter(["zzz"]))[0].tolist() == []


def test_toxicity_query_equals_a_plain_version(spark):
    """Vectors, neighbours, votes, evidence, both fits and scores by dense arithmetic over every document of the fixture."""
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    marks = {d: t for d, t in duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall() if zlib.crc32(str(d).encode()) % 4 != 2 and d in texts}
    rows = {r.doc_id: r for r in rows_of(spark, "op9_nearest_toxicity")}
    counts = {d: collections.Counter(t for w, n in toxicity.words_of(x).items() for t in [w, w[:4] + "*"][: 1 + (len(w) >= 4)] for _ in range(n)) for d, x in texts.items()}
    terms = sorted({t for d in marks for t in counts[d]})
    at = {t: i for i, t in enumerate(terms)}
    df = collections.Counter(t for c in counts.values() for t in c)
    dense = {}
    for d, c in counts.items():
        v = np.zeros(len(terms))
        for t, n in c.items():
            if t in at:
                v[at[t]] = (1 + np.log(n)) ** 2 * np.log(1 + len(texts) / df[t])
        dense[d] = v / (np.linalg.norm(v) or 1)
    keys = sorted(marks)
    matrix, label = np.array([dense[d] for d in keys]), np.array([marks[d] for d in keys], float)
    prior = label.mean()

    def votes(d, but=None):
        cosine = np.round(matrix @ dense[d], 9)
        near = [i for i in np.argsort(-cosine, kind="stable") if cosine[i] > 0 and keys[i] != but][: toxicity.K]
        if not near:
            return prior, 0.0, None
        c = cosine[near]
        w = 1 / (0.05 + 1 - c / c[0])
        w /= w.mean()
        y = label[near]
        share = (w @ y + 2 * prior) / (w.sum() + 2)
        z = []
        for t in np.flatnonzero(dense[d]):
            has = matrix[near, t] > 0
            mass = w[has].sum()
            z.append((w * y)[has].sum() - mass * share if mass > 1.5 else 0.0)
            z[-1] /= np.sqrt(mass * share * (1 - share) * max(0.0, 1 - mass / (w.sum() + 1)) + 0.5)
        return (w @ y + prior) / (w.sum() + 1), float(np.mean(sorted(z)[-6:])), c[0]

    own = [votes(d, d) for d in keys]
    fit = toxicity.Calibration(np.array([x[0] for x in own]), np.array([x[1] for x in own]), label)
    # the fit is a minimum of the penalised log loss, and the isotonic part keeps the order
    x = np.stack([np.log([v[0] / (1 - v[0]) for v in own]), [v[1] for v in own]], axis=1)
    z = np.c_[np.ones(len(x)), (x - x.mean(0)) / (x.std(0) + 1e-9)]
    p = 1 / (1 + np.exp(-z @ fit.beta))
    assert np.allclose(z.T @ (label - p), np.r_[0, fit.beta[1:]], atol=1e-5)
    assert sum(r.nearest is not None for r in rows.values()) > 0.95 * len(texts)
    gaps = []
    for d in texts:
        vote, evidence, nearest = votes(d)
        r = rows[d]
        assert (r.nearest is None) == (nearest is None)
        if nearest is not None:
            assert abs(r.cosine - nearest) < 1e-8 and abs(matrix[keys.index(r.nearest)] @ dense[d] - nearest) < 1e-8
            gaps.append(abs(r.score - fit.score([vote], [evidence])[0]))
        else:
            assert abs(r.score - prior) < 1e-9
    # neighbours that tie at the K-th place are taken in another order here
    assert np.median(gaps) < 1e-3 and max(gaps) < 0.02, sorted(gaps)[-5:]


def test_votes_and_evidence_equal_dense_arithmetic():
    """On vectors without ties, every example among the others."""
    rng = np.random.default_rng(0)
    idf = rng.uniform(0.5, 3, 300)
    examples = []
    for _ in range(700):
        ids = np.sort(rng.choice(300, rng.integers(5, 40), replace=False))
        examples.append((ids, rng.integers(1, 5, len(ids))))
    label = rng.integers(0, 2, 700)
    index = toxicity.BlockMaxIndex(idf, examples, label, block=64, frequent=50)
    dense = np.zeros((700, 300))
    for i, e in enumerate(examples):
        at, w = index.weigh(*e)
        dense[i, at] = w
    for i in range(0, 700, 7):
        vote, evidence, *_ = index.votes([examples[i]], 0.3, [i])[0]
        cosine = np.minimum(1, np.round(dense @ dense[i], 9))
        near = [j for j in np.argsort(-cosine, kind="stable") if cosine[j] > 0 and j != i][: toxicity.K]
        w = 1 / (0.05 + 1 - cosine[near] / cosine[near[0]])
        w /= w.mean()
        y = label[near]
        share, z = (w @ y + 0.6) / (w.sum() + 2), []
        for t in np.flatnonzero(dense[i]):
            has = dense[near, t] > 0
            mass = w[has].sum()
            spread = np.sqrt(mass * share * (1 - share) * max(0, 1 - mass / (w.sum() + 1)) + 0.5)
            z.append(((w * y)[has].sum() - mass * share) / spread if mass > 1.5 else 0)
        assert abs(vote - (w @ y + 0.3) / (w.sum() + 1)) < 1e-9 and abs(evidence - np.mean(sorted(z)[-6:])) < 1e-8


def test_byte_bpe_offsets_of_whole_texts(monkeypatch, bpe):
    """Equal to the library's offsets piece by piece, also where pieces are long or forgotten, or the pattern leaves text out."""
    words = byte_bpe.ByteBPE(byte_bpe._published()[0], "[a-z]+")
    ids = np.frombuffer(words.encode("ab - cdé f"), "<u4")
    assert list(zip(*(x.tolist() for x in words.offsets("ab - cdé f", ids)), strict=True)) == words.encode_with_offsets("ab - cdé f")[1]
    rng = random.Random(6)
    alphabet = "aaab  !!--##..==\n\n\t\r01'sé中한🙂👍🏽‍\x00"
    for cache in (byte_bpe.CACHE, 3):
        monkeypatch.setattr(byte_bpe, "CACHE", cache)
        for _ in range(800):
            s = "".join(rng.choice(alphabet) * rng.choice((1, 2, 5, 90)) for _ in range(rng.randint(0, 8)))
            ids = np.frombuffer(bpe.encode(s), "<u4")
            starts, ends = bpe.offsets(s, ids)
            expected = bpe.encode_with_offsets(s)
            assert ids.tolist() == expected[0] and list(zip(starts.tolist(), ends.tolist(), strict=True)) == expected[1]
            assert bpe.split_tokens(ids) == sum(b[0] & 0xC0 == 0x80 for b in (bpe.tokens[i] for i in ids.tolist()))
