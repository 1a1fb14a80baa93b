"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and pipeline stage."""

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tributary.llm import decontaminate, fingerprints, hpy_lm, near_dup, secrets, sharding, tokens, toxicity, url_filter

CLASH = ["score", "ids", "cls", "n", "part", "copy", "row", "bucket", "label", "shard", "kept", "positive", "h", "task", "spans", "decoded"]
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (None, "a text without an id of its own"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one two three four five six seven eight nine ten"),
    (6, "one two three four five six seven eight nine ten"),
    (6, "one two three four five six seven eight nine ten"),
    (7, LONG),
    (8, LONG + " end"),
    (9, "x" * 5_000),
    (10, "token = \"0123456789abcdef0123456789abcdef01234567\" you idiot"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in ROWS], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (10, 0, 1), (7, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (4, "too short"), (None, "one two three four five six")], "item_id long, text string")


def path():
    return tokens.model_path()


def test_near_duplicates(docs, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, 4).collect())
    assert len(got) == len(ROWS)
    by = {k: (n, c, kept) for _, k, n, c, kept in got if k}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[4] == (1, 4, True) and by[5][1:] == (5, True) and by[6][1:] == (5, False)
    assert by[8][1:] == (7, False)
    assert near_dup.near_duplicates(empty).count() == 0


def test_drop_near_duplicates(docs, empty):
    out = near_dup.drop_near_duplicates(docs, 4)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10]
    assert near_dup.drop_near_duplicates(empty).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dup.drop_near_duplicates(df).collect()) == [1, 2]


def test_secrets(docs, empty):
    automata = secrets.learn(docs)
    got = {r.doc_id: r for r in secrets.scan(docs, automata).collect()}
    assert got[1].spans == got[2].spans == "" and got[10].n_assign == 1 and got[10].n_hex == 1
    assert got[10].spans == "assign:0:49,hex:9:49"
    red = {r.doc_id: r for r in secrets.redact(docs, automata).collect()}
    assert red[10].text == "[SECRET]\" you idiot" and red[10].n_chars == len(red[10].text) and red[1].text is None
    nothing = secrets.learn(empty)
    assert nothing.automata == {} and secrets.scan(empty, nothing).count() == secrets.scan(empty, None).count() == 0


def test_toxicity(docs, empty, labels):
    model = toxicity.train(docs, labels)
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    untrained = toxicity.train(empty, labels.where("false"))
    assert toxicity.score(empty, untrained).count() == 0


def test_sharding(docs, empty):
    got = sharding.shard(docs, shards=3).collect()
    assert len(got) == len(ROWS)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    shard = {}
    for r in got:
        assert shard.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard
    assert {r["size"] for r in got if r.doc_id in (1, 2)} == {8}
    assert sharding.shard(empty).count() == 0


def test_tokens(docs, empty):
    got = tokens.decode_pieces(tokens.encode_pieces(docs, path()), path()).collect()
    assert all(r.decoded == (r.text or "") for r in got)
    counts = {r.doc_id: r for r in tokens.count_tokens(docs, path()).collect()}
    assert counts[1].n_tokens == 0 and counts[2].n_tokens == 0 and counts[7].over_limit
    assert tokens.encode_pieces(empty, path()).count() == tokens.count_tokens(empty, path()).count() == tokens.piece_digests(empty, path()).count() == 0


def test_language_model(docs, empty):
    got = hpy_lm.score(docs, docs).collect()
    assert len(got) == len(ROWS) and all(r.score < 0 and r.base_score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    blank = hpy_lm.score(docs, empty).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in blank)
    assert hpy_lm.score(empty, empty).count() == 0


def test_decontamination(docs, empty, benchmark):
    got = sorted((r.doc_id, r.item_id or 0) for r in decontaminate.contained_items(docs, benchmark).collect())
    assert got == [(5, 1), (6, 1)]
    out = decontaminate.drop_contaminated(docs, benchmark)
    assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10]
    assert decontaminate.contained_items(empty, benchmark).count() == 0
    assert decontaminate.contained_items(docs, benchmark.where("false")).count() == 0


def test_url_filter(spark, labels):
    urls = [(1, "http://a.example.com/en/x"), (1, "http://a.example.com/en/x"), (2, None), (3, ""), (4, "no scheme"), (5, "HTTP://WWW.Example.COM/en/"), (6, "ftp://b.net/fr/q?x#y"), (None, "http://net/es/"), (7, "http://x.org")]
    pages = spark.createDataFrame([(k, u, "h") for k, u in urls], "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("tokens", F.lit("clash"))
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect())
    assert got == [
        (0, "net", "/es/", "net/es/", "block"), (1, "a.example.com", "/en/x", "example.com/en/", "block"), (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "", "", None, "allow"),
        (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "www.example.com", "/en/", "www.example.com/en/", "allow"), (6, "b.net", "/fr/q", "net/fr/", "block"), (7, "x.org", "", None, "allow"),
    ]
    assert url_filter.judge(pages.where("false"), labels).count() == 0


def test_fingerprints_of_rows_without_ids(spark):
    """They come first, in the order of Spark's hash of their texts, and spread over parts."""
    rows = [(None, f"text number {i} " + "of many words " * (i % 7)) for i in range(300)] + [(i, f"row {i} with an id") for i in range(-20, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = {r.part for r in fingerprints.neighbours(docs).where("copy = 0 AND doc_id IS NULL").collect()}
    assert len(parts) > 4
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, signed(r[1]) if r[0] is None else r[0]))
    follower = {r: ordered[(i + 1) % len(ordered)][1] for i, r in enumerate(ordered)}
    want = sorted((k is None, k or 0, hashlib.sha256(fingerprints.edited(t, follower[k, t]).encode()).hexdigest()) for k, t in rows)
    got = fingerprints.fingerprint_edits(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.edited_sha256) for r in got) == want


def test_fingerprints(docs, empty, spark):
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == "" and by[5].fingerprint == by[6].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert by[7].near_next > 0.9
    alone = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "some text alone")], "doc_id long, text string")).collect()
    assert alone[0].near_next == 1.0
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_pipeline_stages(spark, docs, empty, labels, benchmark, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, empty):
        df = frame
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns
            out.write.mode("overwrite").parquet(f"{tmp_path}/out{i}-{len(frame.columns)}")
            out = spark.read.parquet(f"{tmp_path}/out{i}-{len(frame.columns)}")
            # the prior of a few labels is too high for any document to stay, so the next stage starts from all
            df = out if i else frame
        assert {"doc_id", "ids", "n_tokens", "decoded"} <= set(df.columns)
        kept = sorted((r.doc_id or 0, len(r.ids), r.n_tokens, r.decoded) for r in df.collect())
        assert all(n == m and (n > 0) == bool(d) for _, n, m, d in kept)
        # 5 and 6 hold the benchmark item
        assert frame is empty and not kept or {1, 2, 3} <= {k for k, *_ in kept} and not {5, 6} & {k for k, *_ in kept}


def test_contamination_needs_no_id(spark, benchmark):
    item = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id").first().text
    rows = [(None, f"x {item} y"), (None, "clean text of some words here"), (1, f"{item}"), (2, None)]
    out = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, "clean text of some words here"), (2, "")]
