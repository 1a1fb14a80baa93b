"""Quality of candidates and matches, and checks of written answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where (s1_id, cand_id) is true, else 0."""
    marked = truth.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1))
    return pairs.join(marked, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


def entity_counts(selected: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1_id, n_pred, n_true, tp) of every entity."""
    both = label_pairs(selected.select("s1_id", "cand_id"), truth)
    pred = both.groupBy("s1_id").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    out = entities.select("s1_id").distinct().join(pred, "s1_id", "left").join(true, "s1_id", "left")
    return out.select("s1_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pred", "n_true", "tp")))


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """1.25 tp / (0.25 n_true + n_pred); 1 if nothing is predicted and nothing true."""
    bottom = 0.25 * n_true + n_pred
    return F.when(bottom > 0, 1.25 * tp / bottom).otherwise(F.lit(1.0))


def macro_f05(selected: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of measures over all entities, singletons included."""
    rows = entity_counts(selected, truth, entities).withColumn("f", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))
    precision, recall = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")), F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true"))
    return rows.agg(
        F.avg("f").alias("f05"),
        F.avg(precision).alias("precision_macro"),
        F.avg(recall).alias("recall_macro"),
        F.avg(F.when(F.col("n_true") == 0, F.col("f"))).alias("f05_singletons"),
        F.avg(F.when(F.col("n_true") > 0, F.col("f"))).alias("f05_nonsingletons"),
        F.count("*").alias("n_entities"),
        (F.sum("tp") / F.greatest(F.sum("n_pred"), F.lit(1))).alias("micro_precision"),
        (F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1))).alias("micro_recall"),
    )


def blocking_recall(candidates: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: share of true pairs among the candidates, number of candidates, and candidates for each entity."""
    n = entities.select("s1_id").distinct().agg(F.count("*").alias("n"))
    mine = candidates.join(entities.select("s1_id").distinct(), "s1_id", "left_semi").select("s1_id", "cand_id")
    real = truth.join(entities.select("s1_id").distinct(), "s1_id", "left_semi").select("s1_id", "cand_id")
    hits = real.join(mine.distinct(), ["s1_id", "cand_id"], "left_semi").agg(F.count("*").alias("hits"))
    counts = mine.agg(F.count("*").alias("pairs")).join(real.agg(F.count("*").alias("true")), F.lit(True)).join(hits, F.lit(True)).join(n, F.lit(True))  # four tables of one row
    return counts.select((F.col("hits") / F.greatest("true", F.lit(1))).alias("pair_recall"), "pairs", (F.col("pairs") / F.greatest("n", F.lit(1))).alias("pairs_per_s1"))


def weighted_f05(selected: DataFrame, owners: DataFrame, entities: DataFrame, ownerless: float = 1.94) -> DataFrame:
    """F0.5 with predictions of ownerless records weighted. owners: (cand_id, owner, owner_role); a wrong pair counts only if its owner is a valid entity."""
    pairs = selected.join(entities.select("s1_id").distinct(), "s1_id", "left_semi").join(owners, "cand_id", "left")
    hit = F.coalesce(F.col("owner") == F.col("s1_id"), F.lit(False))
    weight = F.when(hit, 1.0).when(F.col("owner_role") == "valid", 1.0).when(F.coalesce("owner_role", F.lit("none")) == "none", ownerless).otherwise(0.0)
    pred = pairs.groupBy("s1_id").agg(F.sum(weight).alias("n_pred"), F.sum(hit.cast("int")).alias("tp"))
    true = owners.where("owner IS NOT NULL").groupBy(F.col("owner").alias("s1_id")).agg(F.count("*").alias("n_true"))
    rows = entities.select("s1_id").distinct().join(pred, "s1_id", "left").join(true, "s1_id", "left").na.fill(0, ["n_pred", "tp", "n_true"])
    return rows.agg(
        F.avg(f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("f05"),
        (F.sum("tp") / F.greatest(F.sum("n_pred"), F.lit(1e-9))).alias("precision"),
        (F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1))).alias("recall"),
    )


def threshold_sweep(scored: DataFrame, truth: DataFrame, entities: DataFrame, thresholds) -> DataFrame:
    """(threshold, f05, n_selected) for each threshold on best-owner pairs, in one pass over them: a pair counts for every threshold it reaches."""
    grid = F.array(*(F.lit(float(t)) for t in thresholds))
    labelled = label_pairs(scored, truth).select("s1_id", "label", F.explode(F.filter(grid, lambda t: t <= F.col("p"))).alias("threshold"))
    pred = labelled.groupBy("threshold", "s1_id").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    rows = entities.select("s1_id").distinct().join(true, "s1_id", "left").withColumn("threshold", F.explode(grid)).join(pred, ["threshold", "s1_id"], "left").na.fill(0)
    return rows.groupBy("threshold").agg(F.avg(f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("f05"), F.sum("n_pred").alias("n_selected"))


def count_signature(selected: DataFrame) -> DataFrame:
    """(source, n, r): for the pairs of each source, the mean number of the entity's other matches from the same source over the mean number from other ones."""
    whole, own = Window.partitionBy("s1_id"), Window.partitionBy("s1_id", "source")
    rows = selected.withColumns({"same": F.count("*").over(own) - 1, "other": F.count("*").over(whole) - F.count("*").over(own)})
    return rows.groupBy("source").agg(F.count("*").alias("n"), (F.avg("same") / F.when(F.avg("other") > 0, F.avg("other"))).alias("r"))


def true_share(signature: DataFrame, constants: dict[str, tuple[float, float]]) -> DataFrame:
    """count_signature with `share`, the share of true pairs of each source: (u - r) / (u - t), constants naming each source's (u, t), the value of r for unrelated and for true pairs."""
    of = lambda k: F.element_at(F.create_map(*(F.lit(x) for s, pair in constants.items() for x in (s, float(pair[k])))), F.col("source"))
    return signature.withColumn("share", (of(0) - F.col("r")) / (of(0) - of(1)))


def mode_sweep(modes: dict[str, DataFrame], truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(mode, f05, n_selected) of several selections (s1_id, cand_id), by name, in one pass."""
    every = None
    for name, selected in modes.items():
        part = selected.select("s1_id", "cand_id", F.lit(name).alias("mode"))
        every = part if every is None else every.unionByName(part)
    pred = label_pairs(every, truth).groupBy("mode", "s1_id").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    true = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    grid = F.explode(F.array(*(F.lit(m) for m in modes)))
    rows = entities.select("s1_id").distinct().join(true, "s1_id", "left").withColumn("mode", grid).join(pred, ["mode", "s1_id"], "left").na.fill(0)
    return rows.groupBy("mode").agg(F.avg(f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("f05"), F.sum("n_pred").alias("n_selected"))


def misses(truth: DataFrame, candidates: DataFrame, entities: DataFrame, group: str) -> DataFrame:
    """(group, n_true, n_missed, miss_rate): true pairs that are no candidates, by the group of their entity (s1_id, group)."""
    found = candidates.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1))
    rows = truth.join(entities.select("s1_id", group), "s1_id").join(found, ["s1_id", "cand_id"], "left")
    missed = F.count_if(F.col("hit").isNull())
    return rows.groupBy(group).agg(F.count("*").alias("n_true"), missed.alias("n_missed"), (missed / F.count("*")).alias("miss_rate"))


def validate(lists: DataFrame, required: DataFrame, known: DataFrame, own_prefix: str = "S1-", prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """(rule, n, example) of every rule, n 0 where it holds. lists: (s1_id, ids); required: (s1_id); known: (cand_id)."""
    rows = lists.select("s1_id", F.filter(F.split("ids", ","), lambda x: x != "").alias("ids"))
    ids = rows.select(F.explode("ids").alias("id")).distinct()
    right = F.lit(False)
    for p in prefixes:
        right = right | F.col("id").startswith(p)
    have = rows.select("s1_id").distinct()
    found = {
        "duplicate rows": rows.groupBy("s1_id").count().where("count > 1").select(F.col("s1_id").alias("x")),
        "duplicate ids in a list": rows.where(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("s1_id").alias("x")).distinct(),
        "ids of source 1": ids.where(F.col("id").startswith(own_prefix)).select(F.col("id").alias("x")),
        "ids with a wrong prefix": ids.where(~F.col("id").startswith(own_prefix) & ~right).select(F.col("id").alias("x")),
        "unknown ids": ids.where(right).join(known.select(F.col("cand_id").alias("id")), "id", "left_anti").select(F.col("id").alias("x")),
        "missing entities": required.select("s1_id").distinct().join(have, "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
        "extra entities": have.join(required.select("s1_id"), "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
    }
    out = None
    for rule, offenders in found.items():
        row = offenders.agg(F.count("*").alias("n"), F.coalesce(F.min("x"), F.lit("")).alias("example")).select(F.lit(rule).alias("rule"), "n", "example")
        out = row if out is None else out.unionByName(row)
    return out


#: Findings that don't make an answer wrong.
WARNINGS = ("no candidate file", "ids not checked", "matches that are no candidates")


def validate_file(spark: SparkSession, path: str, required: DataFrame, known: DataFrame | None, columns: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> tuple[DataFrame, DataFrame]:
    """Findings (rule, n, example) for a written id-list file or folder, and its lists (s1_id, ids).

    Besides the rules of validate(): an empty file; a file whose header (case and spaces aside) isn't the two columns with a tab between; lines without a tab.
    Blank lines are ignored. Without `known` ids no unknown ones are looked for.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    names = F.transform(F.split(F.lower("value"), "\t"), lambda c: F.trim(c))
    is_header = names == F.array(*(F.lit(c) for c in columns))
    marked = lines.where(F.trim("value") != "").withColumn("header", is_header)
    headers = marked.groupBy("file").agg(F.max(F.col("header").cast("int")).alias("has"), F.min("value").alias("x"))
    body = marked.where("NOT header")
    cut = F.instr("value", "\t")
    rows = body.where(cut > 0).select(F.substring_index("value", "\t", 1).alias("s1_id"), F.expr("substring(value, instr(value, '\t') + 1)").alias("ids"))
    empty = lines.agg((F.count("*") == 0).cast("long").alias("n")).select(F.lit("empty file").alias("rule"), "n", F.lit("").alias("example"))
    row = lambda rule, offenders: offenders.agg(F.count("*").alias("n"), F.coalesce(F.min("x"), F.lit("")).alias("example")).select(F.lit(rule).alias("rule"), "n", "example")
    found = validate(rows, required, known if known is not None else rows.select(F.explode(F.split("ids", ",")).alias("cand_id")))
    found = found.unionByName(empty).unionByName(row("wrong header", headers.where("has = 0"))).unionByName(row("lines without a tab", body.where(cut == 0).select(F.col("value").alias("x"))))
    return found, rows


def validate_answer(spark: SparkSession, matches: str, required: DataFrame, known: DataFrame | None = None, candidates: str | None = None) -> DataFrame:
    """(file, rule, n, example, severity) for a match file and, if there is one, a candidate file. Only findings of severity error make the answer wrong."""
    found, lists = validate_file(spark, matches, required, known)
    out = found.withColumn("file", F.lit("matches"))
    note = lambda rule, n: spark.createDataFrame([("answer", rule, n, "")], "file string, rule string, n long, example string")
    if known is None:
        out = out.unionByName(note("ids not checked", 1))
    if candidates is None:
        out = out.unionByName(note("no candidate file", 1))
    else:
        more, pool = validate_file(spark, candidates, required, known, ("source1_entity_id", "candidate_entity_ids"))
        pairs = lambda rows: rows.select("s1_id", F.explode(F.split("ids", ",")).alias("cand_id")).where("cand_id <> ''")
        outside = not_contained(pairs(lists), pairs(pool)).select(F.concat_ws(" ", "s1_id", "cand_id").alias("x"))
        outside = outside.agg(F.count("*").alias("n"), F.coalesce(F.min("x"), F.lit("")).alias("example")).select(F.lit("answer").alias("file"), F.lit("matches that are no candidates").alias("rule"), "n", "example")
        out = out.unionByName(more.withColumn("file", F.lit("candidates"))).unionByName(outside)
    severity = F.when(F.col("n") == 0, "none").when(F.col("rule").isin(*WARNINGS), "warning").otherwise("error")
    return out.select("file", "rule", "n", "example", severity.alias("severity"))


def exit_code(findings: DataFrame) -> int:
    """1 if there is an error, else 0."""
    return int(not findings.where("severity = 'error'").isEmpty())


def not_contained(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates."""
    return matches.select("s1_id", "cand_id").join(candidates, ["s1_id", "cand_id"], "left_anti")
