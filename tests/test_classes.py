"""Pair queries by classes: features are found for pairs of distinct values, before the records' ids are listed, and all pairs of records come out."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_oracles import rows
from tributary.operators import classes as C
from tributary.operators import features as X
from tributary.plans.catalogue import ORACLES, QUERIES

COPIES = 6
BY_CLASS = [
    "idf_coverage",
    "number_features",
    "soft_idf",
    "vocab_swap",
    "flag_features",
    "legal_relation",
    "number_street_types",
    "recovery_rules",
    "fuzzy_similarity",
    "pair_types",
    "twin_edits",
]


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """Tables in which each part occurs several times, with other keys."""
    folder = str(tmp_path_factory.mktemp("copied"))
    c = duckdb.connect()
    c.execute(f"COPY (SELECT p.* REPLACE (p_partkey + k * (SELECT max(p_partkey) + 1 FROM '{SF}/part.parquet') AS p_partkey) FROM '{SF}/part.parquet' p, range({COPIES}) t(k)) TO '{folder}/part.parquet' (FORMAT parquet)")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return folder, c


@pytest.mark.parametrize("name", BY_CLASS)
def test_copies_share_their_features(spark, copied, name):
    folder, duck = copied
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(id_1s" in plan and "explode(id_2s" in plan  # ids are listed after the features of their classes
    got, want = df.toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) > 0
    assert rows(got, columns) == rows(want, columns)


def test_classes_lose_no_pair(spark):
    left = spark.createDataFrame([("x", i, "same" if i < 50 else f"w{i}") for i in range(53)] + [("y", 90, "same")], "block string, id_1 long, v_1 string")
    right = spark.createDataFrame([("x", 100 + i, None if i < 30 else "same") for i in range(35)], "block string, id_2 long, v_2 string")
    pairs = C.class_pairs(left, right, ["block"], members=7)
    assert max(r.n for r in pairs.select(F.size("id_1s").alias("n")).collect()) < 50  # a class is cut into lists
    asked = []

    def find(values):
        asked.extend(values.select("v_1", "v_2").collect())
        return values.select("key", F.concat_ws("/", "v_1", "v_2").alias("text"))

    got = C.expand(C.by_value(pairs, ["v_1", "v_2"], find)).select("id_1", "id_2", "text").collect()
    assert len(asked) == 8  # four values by two
    want = left.join(right, "block").select("id_1", "id_2", F.concat_ws("/", "v_1", "v_2").alias("text")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
