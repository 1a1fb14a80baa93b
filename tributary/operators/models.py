"""Scorers with Spark ML: a tree model on pair features, a second stage by folds, text vectors and a text-pair model.

These stand in, behind the same interface, for models that aren't available here: gradient-boosted trees for the tree models, hashed token vectors with a
random projection for the text encoder, logistic regression on token interactions for the pair encoder. No quality of the originals is claimed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import split_words


def _probability(model, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "_features")


def fit_trees(labelled: DataFrame, features: list[str], rounds: int = 20, depth: int = 4, seed: int = 7):
    """A fitted pipeline from feature columns and label (0 or 1). Nulls and NaN are kept as a value of their own, -1."""
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[assembler, trees]).fit(labelled.na.fill(-1, features).withColumn("label", F.col("label").cast("double")))


def apply_trees(model, df: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    return _probability(model, df.na.fill(-1, features), out)


def importances(model, features: list[str]) -> dict[str, float]:
    return dict(zip(features, model.stages[-1].featureImportances.toArray().tolist()))


def two_folds(labelled: DataFrame, features: list[str], key: str = "s1_id", **options) -> DataFrame:
    """Out-of-fold scores p2: the entities' hash decides the fold, each fold is scored by the model of the other one."""
    dealt = labelled.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(2)))
    out = None
    for fold in (0, 1):
        model = fit_trees(dealt.where(F.col("fold") != fold), features, **options)
        part = apply_trees(model, dealt.where(F.col("fold") == fold), features, "p2")
        out = part if out is None else out.unionByName(part)
    return out.drop("fold")


def text_vectors(df: DataFrame, text: str, width: int = 64, buckets: int = 1 << 16, seed: int = 11) -> DataFrame:
    """df with `vector`: unit vectors from TF-IDF weighted hashed words and a seeded random projection. Texts without words get a zero vector.

    `buckets` weights come to the driver, whatever the corpus; the projection matrix is buckets x width numbers and is made from its seed once in a worker.
    """
    words = split_words(F.lower(F.coalesce(F.col(text), F.lit(""))))
    hashed = df.withColumn("_at", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))
    seen = hashed.select(F.explode(F.array_distinct("_at")).alias("at")).groupBy("at").agg(F.count("*").alias("df")).toArrow()
    weight = np.full(buckets, np.log(df.count() + 1.0))
    weight[seen.column("at").to_numpy()] -= np.log(seen.column("df").to_numpy() + 1.0)
    shipped = df.sparkSession.sparkContext.broadcast(weight.astype(np.float32))
    schema = df.withColumn("vector", F.array().cast("array<float>")).schema

    def run(batches):
        matrix = _projection(buckets, width, seed)
        for batch in batches:
            lists = batch.column(batch.schema.names.index("_at"))
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()])
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((batch.num_rows, width), dtype=np.float32)
            ends = np.cumsum(sizes)
            for i, (begin, end) in enumerate(zip(ends - sizes, ends)):
                if end > begin:
                    at, n = np.unique(flat[begin:end], return_counts=True)
                    v = (n * shipped.value[at]).astype(np.float32) @ matrix[at]
                    out[i] = v / max(float(np.linalg.norm(v)), 1e-9)
            rest = [c for c in batch.schema.names if c != "_at"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(list(out), pa.list_(pa.float32()))], names=[*rest, "vector"])

    return hashed.mapInArrow(run, schema)


@functools.lru_cache(maxsize=1)
def _projection(buckets: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, width)).astype(np.float32)


#: Columns of the second stage by group; a model's tag has one suffix for each group beyond the base.
FEATURE_GROUPS = {
    "base": ["p", "s1_max", "s1_sum", "s1_rank", "p_gap", "s1_n_hi", "s1_n_mid", "sib_n", "sib_cos_max", "sib_cos_mean", "sib_addr_max", "sib_name_max", "sib_addr_eq", "sib_name_eq", "c_no_addr"],
    "ce": ["ce", "ce_rank", "ce_gap"],
    "ce2": ["ce2", "ce2_rank", "ce2_gap"],
    "x": ["name_eq", "n_name_c", "n_name_a", "name_eq_uniq", "core_eq", "n_core_c", "n_core_a", "core_eq_uniq"],
    "tw": ["lg_rel", "lg_n1", "lg_n2", "lg_seq_eq", "hn_has1", "hn_has2", "hn_eq", "hn_absdiff", "hn_reldiff", "hn_digit_ed", "hn_prefix", "hn_samelen", "hn_best_absdiff", "hn_n_extra", "hn_frac_in"]
    + ["nt_miss", "nt_extra", "nt_sub", "nt_miss_first", "nt_order_eq", "st_miss", "st_extra"],
    "d": ["n_cc_a", "n_cc_c", "city_eq", "n_st_a", "t_name", "t_num", "t_street"],
}


def feature_set(groups: list[str]) -> list[str]:
    """Columns of a second-stage model with these groups besides the base; columns of the twin group carry the prefix tw_."""
    unknown = set(groups) - set(FEATURE_GROUPS)
    if unknown:
        raise ValueError(f"no such feature group: {sorted(unknown)}")
    return [f"tw_{c}" if g == "tw" else c for g in FEATURE_GROUPS if g == "base" or g in groups for c in FEATURE_GROUPS[g]]


def model_tag(tag: str, ce: bool = False, second: str = "", names: bool = False, dense: bool = False, no_ghosts: bool = False) -> str:
    """Name of a second-stage model: the first stage's tag and a suffix for each group of features that is on."""
    return tag + "ce" * ce + second + "x" * names + "d" * dense + "g" * no_ghosts


def attach(pairs: DataFrame, features: DataFrame, prefix: str = "tw_", on: tuple[str, ...] = ("s1_id", "cand_id")) -> DataFrame:
    """pairs with every other column of features under a prefix; pairs without a row there have nulls."""
    return pairs.join(features.select(*on, *(F.col(c).alias(prefix + c) for c in features.columns if c not in on)), list(on), "left")


def interactions(a: Column, b: Column) -> Column:
    """Words that two texts share and words that only one has, tagged."""
    x, y = F.array_distinct(split_words(F.lower(a))), F.array_distinct(split_words(F.lower(b)))
    tag = lambda t, items: F.transform(items, lambda w: F.concat(F.lit(t), w))
    return F.concat(tag("=", F.array_intersect(x, y)), tag("<", F.array_except(x, y)), tag(">", F.array_except(y, x)), F.array(F.concat(F.lit("#"), F.size(F.array_intersect(x, y)).cast("string"))))


def fit_pair_model(labelled: DataFrame, a: str, b: str, buckets: int = 1 << 14, strength: float = 0.01):
    """A fitted pipeline that scores text pairs; labelled has texts a and b and label."""
    rows = labelled.select(interactions(F.col(a), F.col(b)).alias("_words"), F.col("label").cast("double"))
    hashed = HashingTF(inputCol="_words", outputCol="_features", numFeatures=buckets)
    return Pipeline(stages=[hashed, LogisticRegression(featuresCol="_features", labelCol="label", regParam=strength)]).fit(rows)


def score_pairs(model, pairs: DataFrame, a: str, b: str, out: str = "ce") -> DataFrame:
    return _probability(model, pairs.withColumn("_words", interactions(F.col(a), F.col(b))), out).drop("_words")
