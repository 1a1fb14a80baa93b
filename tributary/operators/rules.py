"""Rules on scored and typed pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import split_words
from .features import NAME_TYPES, NUMBER_TYPES, STREET_TYPES

#: Legal words whose loss marks a disguised swap.
LOST_WORDS = ("co", "etablissements")


def pair_sim(name_set: Column, joined: Column, address: Column, numbers: Column) -> Column:
    """Mean of two name similarities, plus the address similarity (50 without one), plus 100 times the number overlap (30 without one)."""
    return (name_set + joined) / 2 + F.coalesce(address, F.lit(50.0)) + F.coalesce(100 * numbers, F.lit(30.0))


def _is(column: Column, names: list[str], value: str) -> Column:
    return column == names.index(value)


def recover(p: Column, swap: Column, name: Column, number: Column, acronym: Column, low: float, high: float) -> Column:
    """Whether a pair with p in [low, high), no vocabulary swap, is of a kind that is usually right."""
    same = _is(number, NUMBER_TYPES, "eq")
    kinds = (
        (_is(name, NAME_TYPES, "other") & acronym & same)
        | (_is(name, NAME_TYPES, "swap1") & same)
        | (_is(name, NAME_TYPES, "eq") & _is(number, NUMBER_TYPES, "c_none") & (p >= 0.5))
        | (_is(name, NAME_TYPES, "extra") & same & (p >= 0.5))
    )
    return (p >= low) & (p < high) & ~swap & kinds


def low_acronym(p: Column, swap: Column, name: Column, number: Column, street: Column, acronym: Column, low: float = 0.05, high: float = 0.3) -> Column:
    """Acronyms at the same number and street whose p is low."""
    return (p >= low) & (p < high) & ~swap & _is(name, NAME_TYPES, "other") & acronym & _is(number, NUMBER_TYPES, "eq") & _is(street, STREET_TYPES, "eq")


def disguised_swap(core_1: Column, core_2: Column, name_1: Column, name_2: Column, r_of_new_word: Column, low: float = 0.5, high: float = 1.1) -> Column:
    """Whether the record's core is the entity's and one word of the vocabulary more, while a legal word of the entity's name is lost."""
    t1, t2 = split_words(core_1), split_words(core_2)
    lost = F.lit(False)
    for w in LOST_WORDS:
        lost = lost | (F.array_contains(split_words(name_1), w) & ~F.array_contains(split_words(name_2), w))
    return (F.size(F.array_except(t1, t2)) == 0) & (F.size(F.array_except(t2, t1)) == 1) & (r_of_new_word >= low) & (r_of_new_word < high) & lost


def noaddr_exact(scored: DataFrame, selected: DataFrame, left: DataFrame, low: float, high: float, shared_min: int, shared_max: int) -> DataFrame:
    """Pairs to add: p in [low, high), an entity that has a match, a record without address and with the same non-empty core, a core that shared_min to shared_max

    entities of the country carry. scored has s1_id, cand_id, p, core_1, core_2, no_address; left has s1_id, country, core.
    """
    counts = left.groupBy("country", "core").agg(F.count("*").alias("n"))
    shared = left.join(counts, ["country", "core"]).where(F.col("n").between(shared_min, shared_max)).select("s1_id")
    band = scored.where((F.col("p") >= low) & (F.col("p") < high) & F.col("no_address") & (F.col("core_2") != "") & (F.col("core_1") == F.col("core_2")))
    return band.join(selected.select("s1_id").distinct(), "s1_id", "left_semi").join(shared, "s1_id", "left_semi").select("s1_id", "cand_id")
