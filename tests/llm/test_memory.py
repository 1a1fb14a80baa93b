"""What a Python worker holds on to between stages."""

import pytest
from pyspark.sql import functions as F

from tributary.llm import common, near_dup, secrets, tokens, toxicity


class Plan:
    """A table that keeps the functions that would run over it."""

    columns, schema = ["doc_id", "text"], "doc_id long, text string"

    def __init__(self, spark):
        self.sparkSession, self.runs = spark, []

    def select(self, *columns):
        return self

    join = drop = withColumn = select

    def mapInArrow(self, run, schema):
        self.runs.append(run)
        return self


def plans():
    yield "signed", lambda p: near_dup.signed(p, 5)
    yield "class_sets", lambda p: near_dup.class_sets(p, 5)
    yield "confirmed", lambda p: near_dup.confirmed(p, p, 80)
    yield "drop_toxic", lambda p: toxicity.drop_toxic(p, toxicity.Model({}, 0.0))
    yield "redact", lambda p: secrets.redact(p, None)


@pytest.mark.parametrize("name,build", list(plans()))
def test_stages_give_up_the_engines_of_others(spark, name, build):
    plan = Plan(spark)
    build(plan)
    assert plan.runs
    common.KEPT["engine"] = object()
    for run in plan.runs:
        assert list(run(iter([]))) == []
    assert not common.KEPT


def test_engines_stay_for_the_next_task(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(4)], "doc_id long, text string").repartition(4)
    plan = Plan(spark)
    tokens.piece_digests(plan, tokens.model_path())
    common.KEPT.clear()
    list(plan.runs[0](iter([])))
    engine = next(iter(common.KEPT.values()))
    list(plan.runs[0](iter([])))
    assert next(iter(common.KEPT.values())) is engine
    common.KEPT.clear()
    assert tokens.piece_digests(docs, tokens.model_path()).where(F.col("n_tokens") > 0).count() == 4
