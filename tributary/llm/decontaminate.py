"""Operator 7 [native]: benchmark items inside long documents, by size-partitioned MinHash containment search and exact verification.

Shingles are five lower-cased words. Items are indexed by the minima of one hash order: an item of q shingles keeps its floor((1 - t) * q) + 1
smallest ones. A document that holds a share t of the item misses at most floor((1 - t) * q) shingles, so it holds one of the kept minima at
least: the search loses nothing. Items and documents are partitioned by size: each geometric class of items has its own hash limit, and an
item is only looked for in documents of enough shingles. Candidates are verified on all shingles of both sides.

DataFrame functions only: no Python, pandas, Arrow or RDD code runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, table, written

WORDS, THRESHOLD = 5, 0.8
#: A side is broadcast only if it was counted and has no more rows than this; else it is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Smaller than any hash that is kept.
_NONE = -(1 << 63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS + "+"), lambda w: w != "")


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once for each row: bound as a lambda's variable, which the optimizer can't expand into every place of use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(hashed_words: Column, n: int = WORDS) -> Column:
    """64-bit hashes of all n successive words, in order, repeats included; empty with fewer words. hashed_words must be bound with let()."""
    at = lambda i, k: F.get(hashed_words, i + k)
    return F.when(F.size(hashed_words) >= n, F.transform(F.sequence(F.lit(0), F.size(hashed_words) - n), lambda i: F.xxhash64(*(at(i, k) for k in range(n))))).otherwise(F.array().cast("array<bigint>"))


def shingle_set(text: Column) -> Column:
    """Distinct shingles of a text."""
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda w: F.array_distinct(shingles(w)))


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has been found small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per (doc_id, item_id) with containment of at least `threshold`: n_item (distinct shingles of the item), n_shared, containment.

    Each row is a document; rows that repeat a doc_id are found one by one and verified together. Null and empty texts, and items or documents of fewer than five words, have no shingles and match
    nothing; rows with a null doc_id or item_id are left out. Equal items are reported each. Other columns of either table play no part.
    """
    docs, benchmark = docs.where("doc_id IS NOT NULL"), benchmark.where("item_id IS NOT NULL")
    share = F.lit(str(threshold)).cast("decimal(10,6)")  # decimals: exact bounds at whole multiples
    items = written(
        benchmark.select("item_id", F.explode(shingle_set(F.col("text"))).alias("h")).distinct()
        .withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
        .withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h")))
        .select("item_id", "h", F.col("n").alias("n_item"), "rank", F.ceil(F.col("n") * share).cast("int").alias("least"), F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("size_class")),
        "benchmark-shingles",
    )
    minima = items.where(F.col("rank") <= F.col("n_item") - F.col("least") + 1)
    # one row for each size class (32 at most): the largest kept minimum and the fewest shingles a document needs
    classes = minima.groupBy("size_class").agg(F.max("h").alias("limit"), F.min("least").alias("least")).orderBy("size_class").collect()
    # the limit of a row's size partition: that of the classes whose items it has shingles enough for
    limit = lambda s: F.greatest(F.lit(_NONE), F.lit(_NONE), *(F.when(F.size(s) >= c.least, F.lit(c.limit)) for c in classes))
    sketch = let(shingle_set(F.col("text")), lambda s: let(limit(s), lambda top: F.filter(s, lambda h: h <= top)))
    probes = docs.select("doc_id", F.explode(sketch).alias("h"))
    found = probes.join(_small(minima.select("item_id", "h")), "h").select("doc_id", "item_id").distinct()
    candidates = written(found, "containment-candidates")

    suspects = docs.select("doc_id", "text").join(_small(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
    full = suspects.select("doc_id", F.explode(shingle_set(F.col("text"))).alias("h"))
    shared = full.join(_small(items.select("item_id", "h", "n_item", "least")), "h").join(_small(candidates), ["doc_id", "item_id"], "left_semi")
    counted = shared.groupBy("doc_id", "item_id", "n_item", "least").agg(F.countDistinct("h").alias("n_shared"))
    return counted.where("n_shared >= least").select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"), F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item. Whether one does depends on its text alone, so rows without a doc_id are judged

    like others, and equal texts alike; null texts hold nothing and stay.
    """
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = written(contained_items(keyed, benchmark, threshold).select(F.col("doc_id").alias("hash")).distinct(), "contaminated")
    return docs.join(_small(found), F.xxhash64("text") == F.col("hash"), "left_anti").select(docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH side AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), words AS (
  SELECT side, id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM side
), sets AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) >= 5
), items AS (
  SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM sets WHERE side = 'i'
)
SELECT d.id AS doc_id, i.item_id, i.n_item, count(*) AS n_shared, round(count(*) / i.n_item, 6) AS containment
FROM sets d JOIN items i ON d.s = i.s
WHERE d.side = 'd'
GROUP BY d.id, i.item_id, i.n_item
HAVING count(*) * 10 >= i.n_item * 8
"""
