"""Operators 5 and 10: exact piece ids and decoding by the prefix table, and token counts by heap merging."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, table
from .piece_bpe import Decoder, HeapCounter, PrefixTable, Vocabulary

MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _shipped(df: DataFrame, model_path: str):
    """The vocabulary as a broadcast variable: read once on the driver, a few MB whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))


def _engine(kind, vocabulary: Vocabulary):
    """One engine of a kind for each worker process and vocabulary, with what it has in memory; another vocabulary replaces it."""
    held = KEPT.get(kind)
    if held is None or held.source != vocabulary.source:
        held = KEPT[kind] = kind(vocabulary)
        held.source = vocabulary.source
    return held


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of df plus `ids`, the exact piece ids of the whole text.

    A null or empty text gives an empty list. A column of the same name as `ids` is replaced. Rows are independent: nothing shuffles.
    """
    df = df.drop(ids)
    shipped = _shipped(df, model_path)
    schema = df.withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches):
        engine = _engine(PrefixTable, shipped.value)
        for batch in batches:
            for part in _slices(batch):
                encoded = [engine.encode(x) for x in _texts(part, text)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(encoded, pa.list_(pa.int32()))], names=[*part.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of df plus `decoded`, the text that the library gives for the ids; null ids give an empty text."""
    df = df.drop(decoded)
    shipped = _shipped(df, model_path)
    schema = df.withColumn(decoded, F.lit(None).cast("string")).schema

    def run(batches):
        decoder = Decoder(shipped.value)
        for batch in batches:
            for part in _slices(batch):
                texts = [decoder.decode(x or ()) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, decoded])

    return df.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, most: int = 1 << 20):
    """Parts of a batch of about `most` bytes, so that lists of ids stay small in memory."""
    step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def transcode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", n: str = "n_tokens") -> DataFrame:
    """The columns of df without `text`, plus the piece ids of the whole text, the text that decoding them gives, and their number, in one pass.

    A null or empty text gives no ids and an empty text. Columns named like the new ones are replaced. Rows are independent: nothing shuffles.
    """
    shipped = _shipped(df, model_path)
    kept = [c for c in df.columns if c not in (text, ids, decoded, n)]
    schema = df.select(*kept, F.lit(None).cast("array<int>").alias(ids), F.lit("").alias(decoded), F.lit(0).cast("long").alias(n)).schema

    def run(batches):
        engine = _engine(PrefixTable, shipped.value)
        for batch in batches:
            for part in _slices(batch):
                numbers, texts, counts = [], [], []
                for x in _texts(part, text):
                    count, found, back = engine.encode_and_decode(x)
                    numbers.append(np.fromiter(map(int, found.split(",")), dtype=np.int32, count=count) if count else np.empty(0, dtype=np.int32))
                    texts.append(back)
                    counts.append(count)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(numbers, pa.list_(pa.int32())), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*kept, ids, decoded, n]
                )

    return df.select(*kept, text).mapInArrow(run, schema)


def piece_digests(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, SHA-256 of the ids and of the decoded text. Encoding and decoding run in one pass, the ids are not kept.

    A null or empty text has no ids; its digests are those of the empty string. Rows that repeat, and null keys, are encoded each.
    """
    shipped = _shipped(df, model_path)

    def run(batches):
        engine = _engine(PrefixTable, shipped.value)
        for batch in batches:
            for part in _slices(batch):
                counts, ids_sha, text_sha = [], [], []
                for x in _texts(part, text):
                    n, ids, decoded = engine.encode_and_decode(x)
                    counts.append(n)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(key, text).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens and whether that is over the limit. A null text counts as empty: no bytes, no tokens."""
    shipped = _shipped(df, model_path)

    def run(batches):
        counter = _engine(HeapCounter, shipped.value)
        for batch in batches:
            texts = _texts(batch, text)
            counts = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).cast(pa.int64()), pa.array([len(x.encode("utf-8", "replace")) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(key, text).mapInArrow(run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), model_path())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_path())
