"""Profiles of sources and of match tables, and exact containment of short texts in long ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.normalize import let


def profile_texts(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Numbers of rows, of empty and of distinct texts, and lengths, for each group."""
    size = F.length(text)
    return docs.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col(text) == "").alias("n_empty"), F.round(F.avg(size), 6).alias("mean_chars"), F.max(size).cast("long").alias("max_chars"), F.countDistinct(F.md5(text)).alias("n_texts")
    )


def missing_rates(rows: DataFrame) -> DataFrame:
    """(column, n, null_rate, empty_rate) of every column, in one pass; the empty rate counts texts of length 0 among all rows."""
    n = F.count("*")
    rate = lambda cond: F.coalesce(F.avg(cond.cast("double")), F.lit(0.0))
    each = [F.struct(F.lit(c).alias("column"), n.alias("n"), rate(F.col(f"`{c}`").isNull()).alias("null_rate"), rate(F.coalesce(F.col(f"`{c}`").cast("string") == "", F.lit(False))).alias("empty_rate")) for c in rows.columns]
    return rows.agg(F.array(*each).alias("each")).select(F.explode("each").alias("e")).select("e.*")


def matches_histogram(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(matches, n): how many entities have so many matches, 0 included."""
    counts = pairs.groupBy("s1_id").agg(F.count("*").alias("matches"))
    return entities.join(counts, "s1_id", "left").groupBy(F.coalesce("matches", F.lit(0)).alias("matches")).agg(F.count("*").alias("n"))


def top_tokens(frequency: DataFrame, k: int) -> DataFrame:
    """The k commonest tokens of each part."""
    order = Window.partitionBy("part").orderBy(F.desc("df"), "token")
    return frequency.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("part", "token", F.col("df").alias("n"))


#: Items that are sent to every task; with more, the windows of all documents shuffle.
FEW_ITEMS = 10_000
WINDOW = 4


def _word_windows(text: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, cut at white space, in order."""
    hashed = F.transform(F.split(text, r"\s+", -1), lambda w: F.xxhash64(w))
    return let(
        hashed,
        lambda h: F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(F.lit(size), *(F.get(h, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>")),
    )


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the item's text is a substring of the document's. Null texts hold and are nothing; an empty item is in every other text.

    They meet on the hash of up to WINDOW words from inside the item: there these stand between white space, so a document that holds the item has the same run
    of words. Then texts are compared. Items of one or two words have nothing inside; an automaton of them goes over the documents.
    """
    sized = items.where("item IS NOT NULL").withColumn("inside", F.least(F.size(F.split("item", r"\s+", -1)) - 2, F.lit(WINDOW)))
    out = _short_items(docs, sized.where("inside <= 0").select("item_id", "item"))
    for size in range(1, WINDOW + 1):
        starts = sized.where(F.col("inside") == size).withColumn("h", F.get(_word_windows(F.col("item"), size), F.lit(1)))
        n = starts.count()
        if not n:
            continue
        probes = docs.select("doc_id", "text", F.explode(F.array_distinct(_word_windows(F.col("text"), size))).alias("h"))
        if n <= FEW_ITEMS:
            hits = probes.join(F.broadcast(starts), "h")
        else:
            hits = probes.select("doc_id", "h").join(starts, "h").join(docs.select("doc_id", "text"), "doc_id")
        found = hits.where(F.col("text").contains(F.col("item"))).select("item_id", "doc_id").distinct()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.limit(0).join(items.limit(0).select("item_id"), F.lit(True)).select("item_id", "doc_id")
    return out


def _short_items(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(item_id, doc_id) for items of one or two words, in blocks of FEW_ITEMS."""
    rows = sorted((r.item, r.item_id) for r in items.toLocalIterator())
    out = None
    for at in range(0, len(rows), FEW_ITEMS):
        block = rows[at : at + FEW_ITEMS]

        def run(batches, block=block):
            import ahocorasick

            automaton, always = ahocorasick.Automaton(), [i for text, i in block if not text]
            for text, i in block:
                if text:
                    automaton.add_word(text, [*automaton.get(text, []), i])
            automaton.make_automaton()
            for batch in batches:
                ids, found = [], []
                for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                    if text is not None:
                        hits = {i for _, several in automaton.iter(text) for i in several} if len(automaton) else set()
                        hits.update(always)
                        ids += [key] * len(hits)
                        found += sorted(hits)
                yield pa.RecordBatch.from_arrays([pa.array(found, batch_type), pa.array([k.as_py() for k in ids], batch.column(0).type)], names=["item_id", "doc_id"])

        batch_type = to_arrow_type(items.schema["item_id"].dataType)
        part = docs.select("doc_id", "text").mapInArrow(run, StructType([items.schema["item_id"], docs.schema["doc_id"]]))
        out = part if out is None else out.unionByName(part)
    return out
