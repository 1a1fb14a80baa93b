"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread for the next one.

All stages but the last return the columns of documents. Part of the subpackage `tributary.llm`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import decontaminate, near_dup, secrets, tokens, toxicity
from tributary.llm.common import table, written

#: SQL can express neither trained scores nor inferred automata; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 by the model trained on them and on the labels."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with similarity of 0.8 or more."""
    return near_dup.drop_near_duplicates(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold 0.8 or more of a benchmark item's five-word shingles."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark."""
    return secrets.redact(docs, secrets.learn(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece ids, their number, and the text that decoding them gives."""
    return tokens.transcode(docs.select("doc_id", "lang", "source", "text"), tokens.model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
