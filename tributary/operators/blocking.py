"""Candidate pairs: rare-token retrieval and exact vector neighbours in both directions, within a partition column.

Every function takes and returns DataFrames. Records have the columns part (partition) and id; pairs have id_1 and id_2. Ranks count from 0; NOT_FOUND
stands for "not among the best".
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOT_FOUND = 99
#: Tokens of the right side in one block of nearest_tokens, about.
BLOCK_ROWS = 4_000_000
#: Records of either side in one task of nearest, about.
VECTORS = 20_000


def token_frequency(left: DataFrame, right: DataFrame) -> DataFrame:
    """(part, token, df) over both sides; each side has (part, id, token), tokens distinct for a record."""
    return left.select("part", "token").unionAll(right.select("part", "token")).groupBy("part", "token").agg(F.count("*").alias("df"))


def token_weights(left: DataFrame, right: DataFrame, max_df: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with weight = ln((n + 1) / (df + 1)) divided by the record's norm. Tokens above max_df leave before any join on tokens,

    which bounds what one token can bring together to (max_df / 2) ** 2 pairs.
    """
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(2)))
    size = both.groupBy("part").agg(F.countDistinct("side", "id").alias("n"))
    capped = token_frequency(left, right).where(F.col("df") <= max_df)
    idf = capped.join(size, "part").select("part", "token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("side", "part", "id")))
    weighted = both.join(idf, ["part", "token"]).withColumn("norm", norm)
    weighted = weighted.withColumn("weight", F.when(F.col("norm") > 0, F.col("idf") / F.col("norm")).otherwise(F.lit(0.0)))
    side = lambda i: weighted.where(F.col("side") == i).select("part", "id", "token", "weight")
    return side(1), side(2)


def best(pairs: DataFrame, by: str, other: str, score: str, k: int, rank: str) -> DataFrame:
    """The k best pairs for each value of `by`, with their rank from 0; equal scores (to nine places) by the other id."""
    order = Window.partitionBy(by).orderBy(F.round(F.col(score), 9).desc(), other)
    return pairs.withColumn(rank, F.row_number().over(order) - 1).where(F.col(rank) < k)


def token_pairs(left: DataFrame, right: DataFrame, max_df: int) -> DataFrame:
    """(id_1, id_2, score): cosine of the weighted token vectors of all pairs that share a token within a part."""
    a, b = token_weights(left, right, max_df)
    joined = a.select("part", "token", F.col("id").alias("id_1"), F.col("weight").alias("w_1")).join(b.select("part", "token", F.col("id").alias("id_2"), F.col("weight").alias("w_2")), ["part", "token"])
    return joined.groupBy("id_1", "id_2").agg(F.sum(F.col("w_1") * F.col("w_2")).alias("score"))


def both_directions(pairs: DataFrame, forward: int, reverse: int, score: str = "score", fwd: str = "rank_fwd", rev: str = "rank_rev") -> DataFrame:
    """Pairs that are among the best of either record, with both ranks."""
    f = best(pairs, "id_1", "id_2", score, forward, fwd)
    r = best(pairs, "id_2", "id_1", score, reverse, rev).withColumnRenamed(score, "score_r")
    out = f.join(r, ["id_1", "id_2"], "full_outer")
    missing = F.lit(NOT_FOUND)
    return out.select("id_1", "id_2", F.coalesce(score, "score_r").alias(score), F.coalesce(fwd, missing).alias(fwd), F.coalesce(rev, missing).alias(rev))


def union_passes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a token pass (score, rank_fwd, rank_rev) and a vector pass (the same columns) with blk_ and emb_ columns; what a pass lacks is score 0, rank 99, found 0."""
    named = lambda df, p: df.select("id_1", "id_2", *(F.col(c).alias(f"{p}_{c}") for c in ("score", "rank_fwd", "rank_rev")), F.lit(1).alias(f"found_{p}"))
    out = named(a, "blk").join(named(b, "emb"), ["id_1", "id_2"], "full_outer")
    fill = lambda p: [F.coalesce(f"{p}_score", F.lit(0.0)).alias(f"{p}_score"), *(F.coalesce(f"{p}_{r}", F.lit(NOT_FOUND)).alias(f"{p}_{r}") for r in ("rank_fwd", "rank_rev")), F.coalesce(f"found_{p}", F.lit(0)).alias(f"found_{p}")]
    return out.select("id_1", "id_2", *fill("blk"), *fill("emb"))


def nearest(left: DataFrame, right: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """(id_1, id_2, score, rank): the k records of right with the largest dot product for each of left, exact, within a part.

    left and right have (part, id, vector) with unit vectors. Each side is dealt into blocks of about VECTORS records by its counted size, and each block meets
    each of the other side; a task is one matrix product and hands on k candidates for each record, so no task grows with the tables. A record isn't its own
    neighbour.
    """

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == 1], rows[rows["side"] == 2]
        empty = pd.DataFrame({"id_1": pd.Series(dtype="int64"), "id_2": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(a) or not len(b):
            return empty
        b = b.sort_values("id")
        keys, matrix = b["id"].to_numpy(), np.stack(b["vector"].to_numpy()).astype(np.float64)
        out = []
        for at in range(0, len(a), 1024):
            part = a.iloc[at : at + 1024]
            ids = part["id"].to_numpy()
            scores = np.round(np.stack(part["vector"].to_numpy()).astype(np.float64) @ matrix.T, 9)
            scores[ids[:, None] == keys[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # stable: equal scores by id
            s = np.take_along_axis(scores, top, axis=1)
            found = pd.DataFrame({"id_1": np.repeat(ids, top.shape[1]), "id_2": keys[top].ravel(), "score": s.ravel()})
            out.append(found[found["score"] > -np.inf])
        return pd.concat(out) if out else empty

    blocks, slices = 1 + _largest(right) // VECTORS, 1 + _largest(left) // VECTORS
    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = right.select("part", "id", "vector", F.lit(2).alias("side"), spread(blocks).alias("block"), every(slices).alias("slice"))
    copied = left.select("part", "id", "vector", F.lit(1).alias("side"), every(blocks).alias("block"), spread(slices).alias("slice"))
    found = copied.unionByName(dealt).groupBy("part", "block", "slice").applyInPandas(block, "id_1 long, id_2 long, score double")
    return best(found, "id_1", "id_2", "score", k, rank)


def _largest(df: DataFrame) -> int:
    """Rows of the largest part."""
    return df.groupBy("part").count().agg(F.max("count")).first()[0] or 0


def token_bags(records: DataFrame, max_df: int) -> DataFrame:
    """(part, side, id, tokens, weights): what token_weights gives, a row for each record that has a token below the cap; tokens as hashes.

    records: (part, side, id, tokens), tokens distinct for a record.
    """
    size = records.where(F.size("tokens") > 0).groupBy("part").agg(F.count("*").alias("n"))
    each = records.select("part", "side", "id", F.explode("tokens").alias("token"))
    capped = each.groupBy("part", "token").agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    idf = capped.join(size, "part").select("part", "token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    bags = each.join(idf, ["part", "token"]).groupBy("part", "side", "id").agg(F.collect_list(F.struct(F.xxhash64("token").alias("token"), "idf")).alias("bag"))
    norm = F.sqrt(F.aggregate("bag", F.lit(0.0), lambda s, x: s + x["idf"] * x["idf"]))
    weights = F.transform("bag", lambda x: F.when(F.col("norm") > 0, x["idf"] / F.col("norm")).otherwise(F.lit(0.0)))
    return bags.withColumn("norm", norm).select("part", "side", "id", F.col("bag.token").alias("tokens"), weights.alias("weights"))


def nearest_tokens(bags: DataFrame, k: int, left: int = 1, rank: str = "rank") -> DataFrame:
    """(id_1, id_2, score, rank): the k records of the other side with the largest token cosine for each of side `left`, exact, within a part; what best()
    makes of token_pairs(). bags: as token_bags gives them.

    No pairs are joined: the other side is dealt into blocks of about BLOCK_ROWS tokens, left into slices, and each block meets each slice; a task goes
    through the postings of its block in arrays and hands on k candidates for each record, so a common token costs additions, not rows.
    """
    one, two = bags.where(F.col("side") == left), bags.where(F.col("side") != left)
    largest = lambda df: max((r["n"] for r in df.groupBy("part").agg(F.sum(F.size("tokens")).alias("n")).collect()), default=0)  # noqa: E731 - one row for each part
    blocks, slices = 1 + largest(two) // BLOCK_ROWS, 4 + largest(one) // BLOCK_ROWS

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = rows[rows["side"] == left], rows[rows["side"] != left].sort_values("id")
        empty = pd.DataFrame({"id_1": pd.Series(dtype="int64"), "id_2": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(one) or not len(two):
            return empty
        keys = two["id"].to_numpy()
        tokens = np.concatenate(two["tokens"].to_numpy())
        order = np.argsort(tokens, kind="stable")
        known, first = np.unique(tokens[order], return_index=True)
        first = np.append(first, len(tokens))
        holder = np.repeat(np.arange(len(two)), two["tokens"].map(len).to_numpy())[order]
        weights = np.concatenate(two["weights"].to_numpy())[order]
        out = []
        for own, wanted, w in zip(one["id"], one["tokens"], one["weights"]):
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            has = known[at] == wanted
            at, w = at[has], w[has]
            n = first[at + 1] - first[at]
            if not len(n):
                continue
            posting = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            held = holder[posting]
            scores = np.bincount(held, weights=np.repeat(w, n) * weights[posting], minlength=len(two))
            at = np.flatnonzero(np.bincount(held, minlength=len(two)))
            rounded = np.round(scores[at], 9)
            if len(at) > k:
                least = np.partition(rounded, len(at) - k)[len(at) - k]
                at, rounded = at[rounded >= least], rounded[rounded >= least]
            at = at[np.argsort(-rounded, kind="stable")[:k]]  # stable: equal scores by id
            out.append(pd.DataFrame({"id_1": np.full(len(at), own), "id_2": keys[at], "score": scores[at]}))
        return pd.concat(out) if out else empty

    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = one.withColumn("slice", spread(slices)).withColumn("block", every(blocks)).unionByName(two.withColumn("block", spread(blocks)).withColumn("slice", every(slices)))
    found = dealt.groupBy("part", "block", "slice").applyInPandas(block, "id_1 long, id_2 long, score double")
    return best(found, "id_1", "id_2", "score", k, rank)


def equal_texts(left: DataFrame, right: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """(id_1, id_2, score, rank) of equal records: the first k of right by id for each of left, with score 1. Both have (part, id, hash).

    For records that no token retrieves. A group of n equal records gives k pairs for each of left, not n.
    """
    first = right.withColumn(rank, F.row_number().over(Window.partitionBy("part", "hash").orderBy("id")) - 1).where(F.col(rank) < k)
    one, two = left.select("part", "hash", F.col("id").alias("id_1")), first.select("part", "hash", F.col("id").alias("id_2"), rank)
    return one.join(two, ["part", "hash"]).select("id_1", "id_2", F.lit(1.0).alias("score"), rank)


def nearest_both(left: DataFrame, right: DataFrame, forward: int, reverse: int) -> DataFrame:
    """Vector pass in both directions, as both_directions gives it."""
    f = nearest(left, right, forward, rank="rank_fwd")
    r = nearest(right, left, reverse, rank="rank_rev").select(F.col("id_2").alias("id_1"), F.col("id_1").alias("id_2"), F.col("score").alias("score_r"), "rank_rev")
    missing = F.lit(NOT_FOUND)
    return f.join(r, ["id_1", "id_2"], "full_outer").select("id_1", "id_2", F.coalesce("score", "score_r").alias("score"), F.coalesce("rank_fwd", missing).alias("rank_fwd"), F.coalesce("rank_rev", missing).alias("rank_rev"))
