"""From scored pairs to matches. Scored pairs have s1_id, cand_id and p; a selection has s1_id and cand_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EDGE = 1e-6


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))


def compete(scored: DataFrame, weight: float) -> DataFrame:
    """p after the entities that claim one record compete: odds o become o / (1 + o + weight * odds of the others)."""
    odds = clipped(F.col("p")) / (1 - clipped(F.col("p")))
    total = F.sum("o").over(Window.partitionBy("cand_id"))
    return scored.withColumn("o", odds).withColumn("p", F.col("o") / (1 + F.col("o") + weight * (total - F.col("o")))).drop("o")


def best_owner(scored: DataFrame) -> DataFrame:
    """The pair of largest p for each record (to nine places, then the smallest s1_id)."""
    order = Window.partitionBy("cand_id").orderBy(F.round("p", 9).desc(), "s1_id")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def select_threshold(scored: DataFrame, threshold: float, power: float = 1.0) -> DataFrame:
    """Best owners with clipped p ** power of at least the threshold."""
    return best_owner(scored).where(F.pow(clipped(F.col("p")), F.lit(power)) >= threshold)


def select_expected_f(scored: DataFrame, least: float, power: float = 1.0) -> DataFrame:
    """For each entity the first k of its best-owner pairs, by p, that maximise the expected F0.5; none if an empty answer expects as much.

    Expected F of k pairs: 1.25 * (sum of the k largest p) / (0.25 * sum of all p + k); of none: the product of 1 - p. Pairs below `least` don't count.
    """
    pool = best_owner(scored).withColumn("q", F.pow(clipped(F.col("p")), F.lit(power)))
    order = Window.partitionBy("s1_id").orderBy(F.round("q", 9).desc(), "cand_id")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("s1_id")
    k = F.row_number().over(order)
    gain = 1.25 * F.sum("q").over(so_far) / (0.25 * F.sum("q").over(whole) + k)
    ranked = pool.withColumns({"k": k, "ef": gain, "none": F.exp(F.sum(F.log1p(-F.col("q"))).over(whole))})
    ranked = ranked.withColumn("most", F.max("ef").over(whole))
    ranked = ranked.withColumn("stop", F.min(F.when(F.col("ef") >= F.col("most") - 1e-12, F.col("k"))).over(whole))
    return ranked.where((F.col("most") > F.col("none")) & (F.col("k") <= F.col("stop")) & (F.col("q") >= least)).select("s1_id", "cand_id", "p")


def fill_empty(best: DataFrame, selected: DataFrame, least: float) -> DataFrame:
    """The best pair of each entity that has no selected pair, if its p is at least `least`."""
    order = Window.partitionBy("s1_id").orderBy(F.round("p", 9).desc(), "cand_id")
    open_ = best.join(selected.select("s1_id").distinct(), "s1_id", "left_anti")
    return open_.withColumn("n", F.row_number().over(order)).where((F.col("n") == 1) & (F.col("p") >= least)).select("s1_id", "cand_id")


def append_unclaimed(selected: DataFrame, more: DataFrame) -> DataFrame:
    """selected, and the pairs of `more` that are new and whose record nobody has."""
    fresh = more.join(selected, ["s1_id", "cand_id"], "left_anti").join(selected.select("cand_id"), "cand_id", "left_anti")
    return selected.select("s1_id", "cand_id").unionByName(fresh.select("s1_id", "cand_id"))


def cap_per_source(selected: DataFrame, limits: dict[str, int]) -> DataFrame:
    """At most so many pairs of an entity from each source, largest p first; a null p counts as 1. selected also has source and p."""
    order = Window.partitionBy("s1_id", "source").orderBy(F.round(F.coalesce("p", F.lit(1.0)), 9).desc(), "cand_id")
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("source"))
    return selected.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def select_by_policy(scored: DataFrame, policy: DataFrame, group: str) -> DataFrame:
    """Best owners whose p reaches the threshold of their group; policy has (group, threshold). Groups without a policy select nothing."""
    policy = F.broadcast(policy) if policy.count() <= 100_000 else policy
    return best_owner(scored).join(policy, group).where(F.col("p") >= F.col("threshold")).drop("threshold")


def prune(scored: DataFrame, least: float, most: int) -> DataFrame:
    """Pairs of p >= least, the `most` best of each entity."""
    order = Window.partitionBy("s1_id").orderBy(F.round("p", 9).desc(), "cand_id")
    return scored.where(F.col("p") >= least).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def unique_claims(selected: DataFrame) -> DataFrame:
    """Pairs whose record is claimed once; of a record claimed more often all pairs go."""
    return selected.withColumn("n", F.count("*").over(Window.partitionBy("cand_id"))).where("n = 1").drop("n")


def id_lists(entities: DataFrame, selected: DataFrame, order: Column | None = None) -> DataFrame:
    """One row for each entity (s1_id), selected or not: its records joined by commas, by id or by `order`, and their number."""
    pairs = selected.dropDuplicates(["s1_id", "cand_id"]).withColumn("at", order if order is not None else F.lit(0))
    lists = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("at", "cand_id"))).alias("found"))
    out = entities.select("s1_id").distinct().join(lists, "s1_id", "left")
    text = F.array_join(F.transform("found", lambda x: x["cand_id"].cast("string")), ",")
    return out.select("s1_id", F.coalesce(text, F.lit("")).alias("ids"), F.coalesce(F.size("found"), F.lit(0)).alias("n_ids"))


def explode_lists(lists: DataFrame) -> DataFrame:
    """(s1_id, cand_id as text) of comma lists; empty ones give nothing."""
    return lists.select("s1_id", F.explode(F.split("ids", ",")).alias("cand_id")).where("cand_id <> ''")


def apply_corrections(selected: DataFrame, log: DataFrame) -> DataFrame:
    """(s1_id, cand_id, at): the selection after a log of (seq, s1_id, cand_id, action 'add' or 'remove').

    A log that removes a pair which isn't there, or adds a record that has an owner, is refused with a ValueError that names its first fault. `at` orders an
    entity's records as a replay would leave them: those of the selection by their own `at` (0 where it has none), then added ones by seq.
    """
    fault = correction_faults(selected, log).orderBy("seq").first()
    if fault:
        raise ValueError(f"correction {fault.seq}: {fault.fault}")
    last = log.groupBy("s1_id", "cand_id").agg(F.max(F.struct(F.col("seq").cast("long").alias("seq"), "action")).alias("last"))
    place = (F.col("at") if "at" in selected.columns else F.lit(0)).cast("long")
    kept = selected.select("s1_id", "cand_id", F.struct(F.lit(0).alias("added"), place.alias("place")).alias("at")).join(last, ["s1_id", "cand_id"], "left_anti")
    added = last.where("last.action = 'add'").select("s1_id", "cand_id", F.struct(F.lit(1).alias("added"), F.col("last.seq").alias("place")).alias("at"))
    return kept.unionByName(added)


def correction_faults(selected: DataFrame, log: DataFrame) -> DataFrame:
    """(seq, fault): removals of a pair that isn't there and additions of a record that has an owner, at that point of the log.

    A record's history is one sequence of claims, starting with its owner in the selection: entry i is at fault against the state that entry i - 1 leaves.
    """
    start = selected.select(F.lit(-1).cast("long").alias("seq"), "s1_id", "cand_id", F.lit("add").alias("action"))
    history = start.unionByName(log.select(F.col("seq").cast("long"), "s1_id", "cand_id", "action"))
    before = Window.partitionBy("cand_id").orderBy("seq")
    state = history.withColumns({"last": F.lag("action").over(before), "owner": F.lag("s1_id").over(before)})
    owned = F.coalesce(F.col("last") == "add", F.lit(False))
    fault = F.when((F.col("action") == "remove") & ~(owned & (F.col("owner") == F.col("s1_id"))), "remove of a pair that is absent").when((F.col("action") == "add") & owned, "add of an owned record")
    return state.where("seq >= 0").withColumn("fault", fault).where("fault IS NOT NULL").select("seq", "fault")


def overlay(scored: DataFrame, rescored: DataFrame) -> DataFrame:
    """p replaced by p2 of (s1_id, cand_id, p2) where there is one."""
    return scored.join(rescored, ["s1_id", "cand_id"], "left").withColumn("p", F.coalesce("p2", "p")).drop("p2")


def blend(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean p of two scorings of the same pairs. Fails when run if either lacks a pair of the other."""
    both = a.select("s1_id", "cand_id", "p").join(b.select("s1_id", "cand_id", F.col("p").alias("p_b")), ["s1_id", "cand_id"], "full_outer")
    scored = lambda c: F.coalesce(c, F.raise_error(F.lit("the two scorings aren't of the same pairs")).cast("double"))
    return both.select("s1_id", "cand_id", ((scored(F.col("p")) + scored(F.col("p_b"))) / 2).alias("p"))


def lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """rows with `value` of their key from a dimension (key, value). Fails when run if a key is missing from the dimension or stands there twice."""
    one = dimension.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(value))
    error = lambda text: F.raise_error(F.concat(F.lit(text), F.col(key).cast("string")))
    found = rows.join(one, key, "left")
    checked = F.when(F.col("_n") == 1, F.col(value)).when(F.col("_n") > 1, error("key with several rows: ").cast(dimension.schema[value].dataType)).otherwise(error("unknown key: ").cast(dimension.schema[value].dataType))
    return found.withColumn(value, checked).drop("_n")


def list_statistics(lists: DataFrame) -> DataFrame:
    """One row for id lists (s1_id, ids, n_ids): entities, ids, longest and mean list, and empty lists."""
    n = F.col("n_ids").cast("long")
    return lists.agg(F.count("*").alias("n_lists"), F.coalesce(F.sum(n), F.lit(0)).alias("n_ids"), F.coalesce(F.max(n), F.lit(0)).alias("longest"), F.avg(n).alias("mean"), F.count_if(n == 0).alias("n_empty"))


def matches_by_group(entities: DataFrame, selected: DataFrame, group: str) -> DataFrame:
    """(group, n_entities, n_matched, n_pairs, pairs_per_entity) of entities (s1_id, group), groups without a match too."""
    counts = selected.groupBy("s1_id").agg(F.count("*").alias("n"))
    rows = entities.select("s1_id", group).distinct().join(counts, "s1_id", "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return rows.groupBy(group).agg(F.count("*").alias("n_entities"), F.count("n").alias("n_matched"), total.alias("n_pairs"), (total / F.count("*")).alias("pairs_per_entity"))


def by_locality(records: DataFrame, address: str, name: str, files: int) -> DataFrame:
    """records in ranges of (last address word, name), sorted within each: neighbours are near twins. Records without address words come first."""
    last = F.coalesce(F.element_at(F.filter(F.split(address, " "), lambda w: w != ""), -1), F.lit(""))
    placed = records.withColumn("locality", last)
    return placed.repartitionByRange(files, "locality", name).sortWithinPartitions("locality", name)


def hard_pairs(pairs: DataFrame, truth: DataFrame, measures: list[str], most: int) -> DataFrame:
    """pairs with label, those that are true or among the `most` best of their entity by any of the measures (nulls last, then by record)."""
    keep = F.lit(False)
    for m in measures:
        rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.round(m, 9).desc_nulls_last(), "cand_id"))
        pairs = pairs.withColumn(f"_{m}", rank)
        keep = keep | (F.col(f"_{m}") <= most)
    marked = truth.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1))
    out = pairs.join(marked, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("hit", F.lit(0)))
    return out.where(keep | (F.col("label") == 1)).drop("hit", *(f"_{m}" for m in measures))


def select_by_scores(scored: dict[str, DataFrame], policy: dict[str, tuple[str, float]], entities: DataFrame, group: str, weight: float = 0.0) -> DataFrame:
    """(s1_id, cand_id, p): each group's entities decided on the score table and by the threshold that the policy (group -> (table, threshold)) names.

    Pairs compete first where weight is above 0. A group of entities without a policy is an error.
    """
    missing = entities.where(~F.col(group).isin(list(policy))).select(group).distinct().limit(5).collect()
    if missing:
        raise ValueError(f"no policy for {sorted(str(r[0]) for r in missing)}")
    out = None
    for name in sorted({table for table, _ in policy.values()}):
        mine = {g: t for g, (table, t) in policy.items() if table == name}
        part = scored[name].join(entities.select("s1_id", group).where(F.col(group).isin(list(mine))), "s1_id")
        part = best_owner(compete(part, weight) if weight else part)
        threshold = F.element_at(F.create_map(*(F.lit(x) for pair in mine.items() for x in pair)), F.col(group))
        part = part.where(F.col("p") >= threshold).select("s1_id", "cand_id", "p")
        out = part if out is None else out.unionByName(part)
    return out


def replace_groups(base: DataFrame, other: DataFrame, group: str, values) -> DataFrame:
    """Rows of base, except those of the given groups, which come from other."""
    inside = F.col(group).isin(list(values))
    return base.where(~inside).unionByName(other.where(inside))
