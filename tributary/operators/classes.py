"""Pairs of records by classes: what depends on a few values of either record is found once for each pair of distinct values, then handed to all pairs.

A class is the records of one block and side whose values are equal; it carries their ids in lists of about MEMBERS, so neither a row nor a task grows with a
class. Where all values differ a class is one record and the pairs of classes are the pairs of records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ids in one list of a class, about.
MEMBERS = 1_000


def classes(records: DataFrame, key: str, members: int = MEMBERS) -> DataFrame:
    """records (key and values) -> the distinct values, with the list `{key}s`; classes of more than `members` records have several rows."""
    values = [c for c in records.columns if c != key]
    n = F.count("*").over(Window.partitionBy(*values))
    dealt = records.withColumn("_list", F.pmod(F.xxhash64(key), F.ceil(n / members)))
    return dealt.groupBy(*values, "_list").agg(F.collect_list(key).alias(f"{key}s")).drop("_list")


def class_pairs(left: DataFrame, right: DataFrame, block: list[str], members: int = MEMBERS) -> DataFrame:
    """(id_1s, id_2s, values of both sides) of the classes of one block. left: (block, id_1, values); right: (block, id_2, values)."""
    return classes(left, "id_1", members).join(classes(right, "id_2", members), block).drop(*block)


def by_value(pairs: DataFrame, columns: list[str], find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs with what `find` gives for their distinct values of some columns; find: (key, columns) -> (key, features)."""
    keyed = pairs.withColumn("key", F.struct(*columns))
    return keyed.join(find(keyed.select("key", *columns).distinct()), "key", "left").drop("key")


def expand(pairs: DataFrame) -> DataFrame:
    """(id_1, id_2, the other columns) of all pairs of two classes' members."""
    rest = [c for c in pairs.columns if c not in ("id_1s", "id_2s")]
    return pairs.select(F.explode("id_1s").alias("id_1"), "id_2s", *rest).select("id_1", F.explode("id_2s").alias("id_2"), *rest)
