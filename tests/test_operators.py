"""Decision, feature, evaluation, source and streaming operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import blocking as B
from tributary.operators import decide as D
from tributary.operators import evaluate as E
from tributary.operators import features as X
from tributary.sources import tables, tsv
from tributary.streaming import incremental


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "s1_id long, cand_id long, p double")


def test_competition(spark):
    df = pairs(spark, (1, 1, 0.9), (2, 1, 0.9), (3, 2, 0.5))
    for weight, both in ((0.0, 0.9), (1.0, 9 / 19), (2.0, 9 / 28)):
        got = {(r.s1_id, r.cand_id): r.p for r in D.compete(df, weight).collect()}
        assert got[1, 1] == pytest.approx(both) and got[3, 2] == pytest.approx(0.5)


def test_best_owner_and_ties(spark):
    df = pairs(spark, (2, 1, 0.9), (1, 1, 0.9), (3, 1, 0.1))
    assert [r.s1_id for r in D.best_owner(df).collect()] == [1]


def test_expected_f(spark):
    df = pairs(spark, (1, 1, 0.99), (1, 2, 0.01), (2, 3, 0.1), (3, 4, 0.6), (3, 5, 0.6))
    got = sorted((r.s1_id, r.cand_id) for r in D.select_expected_f(df, 0.05).collect())
    assert got == [(1, 1), (3, 4), (3, 5)]


def test_macro_f05(spark):
    predicted = pairs(spark, (1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (3, 9, 1.0))
    truth = pairs(spark, (1, 1, 1.0), (1, 3, 1.0), (4, 7, 1.0))
    entities = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "s1_id long")
    f = {r.s1_id: r.f for r in E.entity_counts(predicted, truth, entities).withColumn("f", E.f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))).collect()}
    assert f[1] == pytest.approx(0.714, abs=1e-3) and f[2] == 1 and f[3] == 0 and f[4] == 0
    assert E.macro_f05(predicted, truth, entities).first().f05 == pytest.approx((f[1] + 1) / 4)


def test_one_member_lead(spark):
    df = pairs(spark, (1, 1, 0.7), (2, 1, 0.9), (2, 2, 0.4))
    got = {(r.s1_id, r.cand_id): r for r in X.competition(df, "s1_id", {"p": "p"}, "p").collect()}
    assert got[1, 1].s1_id_lead == pytest.approx(1000.7)
    assert got[2, 1].s1_id_lead == pytest.approx(0.5) and got[2, 2].s1_id_lead == pytest.approx(-0.5)


def test_caps(spark):
    rows = [(1, i, 0.5 + i / 100) for i in range(15)]
    df = pairs(spark, *rows).withColumn("source", F.when(F.col("cand_id") < 7, "S2").otherwise("S3"))
    got = sorted(r.cand_id for r in D.cap_per_source(df, {"S2": 5, "S3": 6}).collect())
    assert got == [2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 14]


def test_corrections(spark):
    selected = pairs(spark, (1, 1, 1.0), (2, 2, 1.0)).select("s1_id", "cand_id")
    log = spark.createDataFrame([(1, 1, 1, "remove"), (2, 2, 1, "add"), (3, 9, 9, "remove"), (4, 5, 2, "add")], "seq long, s1_id long, cand_id long, action string")
    assert sorted((r.s1_id, r.cand_id) for r in D.apply_corrections(selected, log.where("seq < 3")).collect()) == [(2, 1), (2, 2)]
    assert {r.seq: r.fault for r in D.correction_faults(selected, log).collect()} == {3: "remove of a pair that is absent", 4: "add of an owned record"}


def test_attach_score_checks_coverage(spark):
    df = pairs(spark, *((i, i, 0.5) for i in range(200)))
    assert X.attach_score(df, df, "ce").count() == 200
    with pytest.raises(Exception, match="too few pairs"):
        X.attach_score(df, df.where("s1_id > 100"), "ce").collect()


def test_token_weights_are_unit_vectors(spark):
    left = spark.createDataFrame([("x", 1, "a"), ("x", 1, "b"), ("x", 2, "c")], "part string, id long, token string")
    right = spark.createDataFrame([("x", 7, "a"), ("x", 8, "z"), ("y", 9, "a")], "part string, id long, token string")
    a, _ = B.token_weights(left, right, 10)
    norms = a.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms)
    assert [(r.id_1, r.id_2) for r in B.token_pairs(left, right, 10).collect()] == [(1, 7)]


def test_union_passes_fill(spark):
    schema = "id_1 long, id_2 long, score double, rank_fwd int, rank_rev int"
    out = {(r.id_1, r.id_2): r for r in B.union_passes(spark.createDataFrame([(1, 1, 0.5, 0, 99)], schema), spark.createDataFrame([(2, 2, 0.7, 1, 0)], schema)).collect()}
    assert (out[2, 2].blk_score, out[2, 2].blk_rank_fwd, out[2, 2].found_blk) == (0.0, 99, 0)
    assert (out[1, 1].emb_score, out[1, 1].emb_rank_rev, out[1, 1].found_emb) == (0.0, 99, 0)


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "s1.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A" & Co\t\tUS\nS1-2\t\t1 "x\tIN\n', encoding="utf-8")
    got = [tuple(r) for r in tsv.read_tsv(spark, str(tmp_path / "s1.tsv")).orderBy("entity_id").collect()]
    assert got == [("S1-1", '"A" & Co', "", "US"), ("S1-2", "", '1 "x', "IN")]
    lists = spark.createDataFrame([("S1-1", "S2-1,S3-2"), ("S1-2", "")], "s1_id string, ids string")
    tsv.write_id_lists(lists, str(tmp_path / "out"))
    assert sorted(map(tuple, tsv.read_id_lists(spark, str(tmp_path / "out")).collect())) == [("S1-1", "S2-1,S3-2"), ("S1-2", "")]


def test_tables(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def make():
        calls.append(1)
        return spark.range(3)

    assert tables.once(spark, path, make).count() == tables.once(spark, path, make).count() == 3 and len(calls) == 1
    df = spark.read.parquet(path)
    tables.write_manifest(df, str(tmp_path / "m"))
    tables.check_manifest(df, str(tmp_path / "m"))
    spark.range(50).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="stale"):
        tables.check_manifest(spark.read.parquet(path), str(tmp_path / "m"))
    parts = str(tmp_path / "p")
    tables.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "x int, c string"), parts, "c")
    tables.replace_partitions(spark.createDataFrame([(9, "b")], "x int, c string"), parts, "c")
    assert sorted((r.x, r.c) for r in spark.read.parquet(parts).collect()) == [(1, "a"), (9, "b")]


def test_stream_links(spark, tmp_path):
    schema = "part string, id long, token string"
    corpus = spark.createDataFrame([("x", 1, "a"), ("x", 1, "b"), ("x", 2, "c")], schema)
    spark.createDataFrame([("x", 7, "a"), ("x", 7, "b"), ("x", 8, "q")], schema).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = incremental.link_stream(stream, corpus, lambda df, n: got.extend((r.s1_id, r.cand_id) for r in df.collect()), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert got == [(1, 7)]


def test_soft_idf(spark):
    from tributary.functions.similarity import ratio

    rows = [(1, "acme pharmacy", "acme pharmacie"), (2, "acme", "zzz"), (3, "", "x"), (4, "a b", "a b")]
    got = {r.key: r.n_soft_idf for r in X.soft_idf(spark.createDataFrame(rows, "key int, core_1 string, core_2 string"), spark.createDataFrame([("acme", 2.0), ("pharmacy", 3.0)], "token string, idf double")).collect()}
    assert got == {1: pytest.approx((2 + 3 * ratio("pharmacy", "pharmacie") / 100) / 5), 2: 0.0, 3: 0.0, 4: 1.0}
