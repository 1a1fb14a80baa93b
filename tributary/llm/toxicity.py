"""Operator 3: toxicity by non-negative positive-unlabelled learning.

A linear model with logistic loss is trained in numpy from confirmed toxic texts and unlabelled ones. The risk estimator is corrected by the class
prior: prior * (risk of positives as positive) + max(0, risk of the unlabelled as negative - prior * risk of positives as negative). Where the
second part falls below zero the step goes back up along it, as the published method does.

Inputs of a score are rates of words and word beginnings in the whole text, nothing else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, lean, partitions, table, written

#: Documented bounds of the training sample, which is chosen by hash; all else covers every row.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
FEATURES = 600
LETTERS = re.compile(r"[^\W\d_]+")
#: Words of up to 64 characters whose features a task keeps at hand.
MEMO = 100_000
#: A word in this many makes a feature's value 1.
SATURATION = 100.0


def word_features(word: str) -> tuple[str, ...]:
    """Of each run of letters in a word of the text: its beginnings of 4, 5 and 6 letters, and the run itself."""
    out: list[str] = []
    for w in LETTERS.findall(word):
        out.append(w + "$")
        out.extend(w[:n] for n in (4, 5, 6) if len(w) >= n)
    return tuple(out)


def values(text: str) -> dict[str, float]:
    """Features of a text: occurrences for each word of the text, times SATURATION, at most 1."""
    counts: dict[str, int] = {}
    words = text.lower().split()
    for w in words:
        for f in word_features(w):
            counts[f] = counts.get(f, 0) + 1
    scale = SATURATION / max(len(words), 1)
    return {f: min(1.0, c * scale) for f, c in counts.items()}


@dataclass
class Model:
    """Weights of the chosen features; memo maps a word to the indices of its features."""

    weights: dict[str, float]
    bias: float
    memo: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.index = {f: i for i, f in enumerate(self.weights)}
        self.vector = np.array(list(self.weights.values()), dtype=np.float64)

    def score(self, text: str) -> float:
        """Probability that the text is toxic; an empty text gets that of no feature at all."""
        memo, hits = self.memo, []
        words = text.lower().split()
        for w in words:
            found = memo.get(w)
            if found is None:
                found = tuple(self.index[f] for f in word_features(w) if f in self.index)
                if len(w) <= 64:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[w] = found
            if found:
                hits += found
        g = self.bias
        if hits:
            g += float(np.minimum(1.0, np.bincount(hits, minlength=len(self.vector)) * (SATURATION / len(words))) @ self.vector)
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


@dataclass
class Sparse:
    """Rows of few non-zero values, as three parallel arrays."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, at: list[list[int]], x: list[list[float]], columns: int) -> Sparse:
        sizes = [len(r) for r in at]
        flat = lambda rows, kind: np.fromiter((v for r in rows for v in r), dtype=kind, count=sum(sizes))
        return cls(np.repeat(np.arange(len(at)), sizes), flat(at, np.int64), flat(x, np.float64), (len(at), columns))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.shape[0])

    def transposed_times(self, s: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * s[self.row], minlength=self.shape[1])


def fit_nnpu(p: Sparse, u: Sparse, prior: float, steps: int = 500, rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample. p: confirmed positives; u: unlabelled texts."""
    w = np.zeros(p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    softplus = lambda g: np.logaddexp(0, g)
    gradient = lambda x, slope: np.append(x.transposed_times(slope), slope.sum()) / x.shape[0]
    for t in range(1, steps + 1):
        gp, gu = p.times(w[:-1]) + w[-1], u.times(w[:-1]) + w[-1]
        sp, su = sigmoid(gp), sigmoid(gu)
        negative_risk = softplus(gu).mean() - prior * softplus(gp).mean()
        d_negative = gradient(u, su) - prior * gradient(p, sp)
        d = prior * gradient(p, sp - 1) + d_negative if negative_risk >= 0 else -d_negative
        d[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _held_out(key: str = "doc_id") -> Column:
    return id_crc(key) % 4 == 2


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """A written table (text, positive) of the bounded sample, and the class prior among the labelled rows that may be used."""
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~_held_out())
    n, toxic = usable.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = min(max((toxic or 0) / n if n else 0.1, 0.01), 0.9)
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = usable.where("toxic = 1").select("doc_id").distinct().orderBy(order).limit(MAX_POSITIVE).withColumn("positive", F.lit(True))
    # ids only, so that this scan reads one column
    others = docs.where(F.col("doc_id").isNotNull() & ~_held_out()).select("doc_id").distinct().orderBy(order).limit(MAX_UNLABELLED).withColumn("positive", F.lit(False))
    # the sample has at most MAX_POSITIVE + MAX_UNLABELLED ids, so broadcasting it is bounded
    ids = F.broadcast(chosen.unionByName(others))
    return written(docs.join(ids, "doc_id").select("text", "positive").repartition(partitions(docs.sparkSession)), "toxicity-sample"), prior


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, toxic). Without a confirmed positive text, as with empty tables, it scores the prior.

    Rows of either table with a null doc_id, and labels with a null toxic, teach nothing. A document whose doc_id repeats, with equal or other texts,
    counts once for each row; a doc_id with several labels is positive if one of them is. Null texts count as empty. Other columns play no part.
    """
    sample, prior = _sample(docs.select("doc_id", "text"), labels)

    def sums(batches):
        total: dict[str, list[float]] = {}
        for batch in batches:
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f, x in values(text or "").items():
                    s = total.setdefault(f, [0.0, 0.0, 0.0, 0.0])
                    s[0 if positive else 2] += x
                    s[1 if positive else 3] += x * x
        rows = list(total.items())
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.string()), *(pa.array([s[i] for _, s in part], pa.float64()) for i in range(4))], names=["f", "p", "pp", "u", "uu"])

    n_p, n_u = sample.agg(F.sum(F.col("positive").cast("long")), F.sum((~F.col("positive")).cast("long"))).first()
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))))
    by_feature = sample.mapInArrow(lean(sums), "f string, p double, pp double, u double, uu double").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("p", "pp", "u", "uu")))
    # means and spread among positives and unlabelled texts; a small constant keeps features of single texts down
    mean_p, mean_u = F.col("p") / n_p, F.col("u") / n_u
    spread = F.sqrt((F.col("pp") / n_p + F.lit(2.0) / n_p) / n_p + (F.col("uu") / n_u + F.lit(2.0) / n_u) / n_u)
    chosen = by_feature.select("f", ((mean_p - mean_u) / spread).alias("z")).orderBy(F.abs("z").desc(), "f").limit(FEATURES).select("f")
    names = sorted(r.f for r in chosen.collect())
    index = {f: i for i, f in enumerate(names)}

    def rows(batches):
        for batch in batches:
            at, x = [], []
            for text in batch.column(0).to_pylist():
                found = dict(sorted((index[f], v) for f, v in values(text or "").items() if f in index))
                at.append(list(found))
                x.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["positive", "at", "x"])

    # bounded: at most MAX_POSITIVE + MAX_UNLABELLED rows of at most FEATURES values
    got = sample.mapInArrow(lean(rows), "positive boolean, at array<int>, x array<float>").toArrow()
    # one order whatever the partitions, so that sums round alike
    ordered = sorted(zip(*(got.column(c).to_pylist() for c in ("positive", "at", "x"))))
    positive, at, x = zip(*ordered)
    part = lambda kind: Sparse.of([a for a, k in zip(at, positive) if k is kind], [v for v, k in zip(x, positive) if k is kind], len(names))
    weights, bias = fit_nnpu(part(True), part(False), prior)
    return Model({f: float(w) for f, w in zip(names, weights)}, bias)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs plus `out`, the probability of toxicity of the whole text (null counts as empty). A column of that name is replaced."""
    docs = docs.drop(out)
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            scores = [model.score(x or "") for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(lean(run), schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns. A null text is scored as an empty one; repeated rows and rows with

    a null doc_id are judged like all others.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            yield batch.filter(pa.array([model.score(x or "") < threshold for x in texts], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
