"""Operator 1: near duplicates by b-bit MinHash.

Each document's distinct word shingles give HASHES minima. Bands of full minima make candidate buckets; the low BITS bits of all minima, packed into
64-bit words, estimate the similarity of a candidate pair by bit counts, corrected for chance collisions; pairs that may reach the threshold are
confirmed on the full shingle sets.

Documents with equal sets form one class from the start. A class is first compared with two hubs of its buckets only. Classes of buckets in which more
than one component is left are then joined exactly, by prefix and position of their rarest shingles, so no link between components is lost, and a bucket
of thousands of near copies costs a few comparisons for each, not one for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, blocks, drop_written, lean, mix64, table, word_hashes, written
from .components import components

BANDS, ROWS, BITS = 32, 5, 4
HASHES = BANDS * ROWS
#: How far the estimate may lie below the threshold: six standard deviations of it.
MARGIN = 0.2
BROADCAST_ROWS = 200_000
WORDS64 = HASHES * BITS // 64

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], words: int):
    """Distinct shingles of each text as sorted 64-bit hashes; the whole word sequence as one if it is shorter; none without words."""
    hashes, first, _, _ = word_hashes(texts)
    for i in range(len(texts)):
        w = hashes[first[i] : first[i + 1]]
        k = min(words, len(w))
        if not k:
            yield w
            continue
        total = np.full(len(w) - k + 1, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            total += w[j : len(w) - k + 1 + j] * _PLACE[j]
        yield np.unique(mix64(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima (uint32) of each set; the sets aren't empty."""
    folded = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((folded ^ _XOR[j]) * _MULTIPLY[j], starts)
    return out


def packed_bits(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of all minima of a row, packed into WORDS64 signed 64-bit words."""
    lanes = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima), WORDS64, 64 // BITS)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    banded = minima.astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    return mix64((banded * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[63]).view(np.int64)


_SIGNED = ["cls long", "n long", "bands array<long>", "bits array<long>"]


def _class_of(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int(mix64(mix64(s).sum(dtype=np.uint64)[None] + np.uint64(len(s))).view(np.int64)[0])


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, cls, n, bands, bits) of each row, h being a hash of the text; cls, bands and bits are null without shingles."""

    def run(batches):
        for batch in batches:
            texts, keys, h = as_bytes(batch.column(1)), batch.column(0).cast(pa.int64()), batch.column(2)
            for begin, end in blocks(texts):
                sets = list(shingle_sets(texts[begin:end], words))
                full = [i for i, s in enumerate(sets) if len(s)]
                cls: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                if full:
                    minima = signatures([sets[i] for i in full])
                    for i, b, p in zip(full, band_keys(minima), packed_bits(minima)):
                        cls[i], bands[i], bits[i] = _class_of(sets[i]), b, p
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(begin, end - begin), h.slice(begin, end - begin), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["doc_id", "h", "cls", "n", "bands", "bits"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(lean(run), "doc_id long, h long, " + ", ".join(_SIGNED))


def class_sets(docs: DataFrame, words: int) -> DataFrame:
    """(cls, shingles) with the shingles as the bytes of sorted 64-bit hashes."""

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for begin, end in blocks(texts):
                sets = [s for s in shingle_sets(texts[begin:end], words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "shingles"])

    return docs.select("text").mapInArrow(lean(run), "cls long, shingles binary")


def differing(a: Column, b: Column) -> Column:
    """Number of minima whose low bits differ, by bit counts of the packed words."""
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    ones -= (1 << 64) if ones >= 1 << 63 else 0
    total = F.lit(0)
    for i in range(WORDS64):
        x = a[i].bitwiseXOR(b[i])
        for half in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, half))
        total = total + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return total


def most_differing(threshold: float) -> int:
    """Largest number of differing minima at which the collision-corrected estimate reaches the threshold less MARGIN: low bits agree with chance J + (1 - J) / 2**BITS."""
    j = threshold - MARGIN
    return round(HASHES * (1 - (j + (1 - j) / (1 << BITS))))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets have 100 * intersection >= percent * union."""
    with_b = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b")
    with_both = with_b.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")), "a").select("a", "b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_both.mapInArrow(lean(run), "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Equal texts, repeated rows too, are always linked. Rows
    that repeat a doc_id stay rows of their own. Rows with a null doc_id link like all others; a component without any doc_id has a null component_id. An
    empty table gives no rows.
    """
    rows, firsts = _grouped(docs, words, percent)
    out = rows.join(firsts, "cls", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, cls, n) of docs, and (cls, first) of the classes that have several rows or links: first is the least (no_id, doc_id, h) of the

    component, rows with a doc_id before those without.
    """
    rows = written(signed(docs, words), "signatures")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = written(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min(own).alias("first"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes")
    n = classes.count()
    banded = classes.select("cls", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(shared, "band"), "buckets")

    # the hub of a bucket is its member of the largest buckets: in a group of near copies, the text they come from
    weight = members.groupBy("cls").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "cls").groupBy("band").agg(F.max(F.struct("weight", "cls")).alias("hub"))
    stars = members.join(hubs, "band").where("cls <> hub.cls").select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"), F.col("hub.weight").alias("weight")).distinct()
    stars = _alike(stars, classes, percent)
    # a class is tested against the hub of most weight and the most similar one
    chosen = stars.groupBy("b").agg(F.max(F.struct("weight", "a")).alias("x"), F.min(F.struct("d", "a")).alias("y"))
    first = written(chosen.select("b", F.explode(F.array_distinct(F.array("x.a", "y.a"))).alias("a")), "pairs", 2 * n)
    sets = _sets(docs, classes, members, words)
    links = written(confirmed(first, sets, percent), "links")
    roots = components(links)

    # second round: classes in buckets where more than one component is left
    placed = members.select("band", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("band", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = placed.groupBy("band").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("band")
    open_classes = written(placed.join(mixed, "band", "left_semi").select("cls", "root").distinct(), "open-classes", n)
    prefixes = _prefixes(open_classes, sets, percent)
    second = written(_alike(_crossing(prefixes, percent), classes, percent).select("a", "b"), "pairs")
    if not second.isEmpty():
        more = written(confirmed(second, sets, percent), "links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))

    linked = classes.select("cls", "first", "rows").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    linked = written(linked.where("rows > 1 OR root IS NOT NULL").select("cls", "first", F.coalesce("root", "cls").alias("root")), "linked", n)
    least = linked.groupBy("root").agg(F.min("first").alias("first"))
    for used in (members, open_classes, prefixes, first, second):
        drop_written(used)
    return rows.select("doc_id", "h", "cls", "n"), linked.select("cls", "root").join(least, "root").select("cls", "first")


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with d, the number of minima whose low bits differ, where the estimate from the packed bits may reach the threshold."""
    bits = classes.select("cls", "bits")
    for side in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("cls").alias(side), F.col("bits").alias(f"bits_{side}")), side)
    return pairs.withColumn("d", differing(F.col("bits_a"), F.col("bits_b"))).where(F.col("d") <= most_differing(percent / 100)).drop("bits_a", "bits_b")


def _prefixes(open_classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A written table (s, cls, root, n, at, major) of the shingles by which open classes (cls, root) may meet a class of another root.

    Shingles are put in one order, rarest first. Two sets that share enough have their first common shingle so early in both that these prefixes hold it.
    Heavily edited copies begin with shingles of their own, so they meet next to nothing. Shingles of one root alone bring nobody together. major: whether
    root is the one that most classes with this shingle belong to.
    """

    def listed(batches):
        for batch in batches:
            values = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64())), batch.column(2)], names=["cls", "shingles", "root"])

    wanted = sets.join(open_classes, "cls").select("cls", "shingles", "root").mapInArrow(lean(listed), "cls long, shingles array<long>, root long")
    each = wanted.select("cls", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    df = each.groupBy("s").agg(F.count("*").alias("df"), F.min("root").alias("least"), F.max("root").alias("most"))
    placed = each.join(df, "s").withColumn("at", F.row_number().over(Window.partitionBy("cls").orderBy("df", "s")))
    # a set of n shingles shares at least percent * n / 100 of them with any linked one
    prefix = written(placed.where((100 * (F.col("n") - F.col("at") + 1) >= percent * F.col("n")) & (F.col("least") != F.col("most"))).select("s", "cls", "root", "n", "at"), "prefixes")
    sizes = prefix.groupBy("s", "root").agg(F.count("*").alias("size"))
    top = sizes.groupBy("s").agg(F.max(F.struct("size", "root")).alias("top"))
    out = written(prefix.join(top, "s").select("s", "cls", "root", "n", "at", (F.col("root") == F.col("top.root")).alias("major")), "prefixes")
    drop_written(prefix)
    return out


def _crossing(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open classes of different roots whose sets may reach the threshold, by prefix and position; none that does is lost.

    A shingle's classes outside its major root meet all its classes of other roots, so classes of one large root never meet each other: a group of k near
    copies beside m others gives k * m pairs at most, never k * k.
    """
    x, y = (prefix.select("s", *(F.col(c).alias(f"{c}_{side}") for c in ("cls", "root", "n", "at", "major"))) for side in ("x", "y"))
    rest = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) + 1
    once = F.col("major_y") | (F.col("cls_x") < F.col("cls_y"))
    may = (F.col("root_x") != F.col("root_y")) & once & (rest * (100 + percent) >= percent * (F.col("n_x") + F.col("n_y")))
    pairs = x.where("NOT major_x").join(y, (x.s == y.s) & may)
    return pairs.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b")).distinct()


def _sets(docs: DataFrame, classes: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """A written table (cls, shingles) of the classes in shared buckets, each made again from its first row."""
    wanted = members.select("cls").distinct()
    ids = classes.select("cls", "first").join(wanted, "cls").select(F.col("first.doc_id").alias("id"), F.col("first.h").alias("hash")).distinct()
    ids = _small(ids)
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left_semi")
    found = class_sets(texts, words).join(wanted, "cls", "left_semi")
    return written(found.dropDuplicates(["cls"]), "shingle-sets")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay when one row of each group of near duplicates does: the one of smallest doc_id, rows without a

    doc_id last, then by the text's hash. Rows whose text has no shingles stay. Of rows that repeat both doc_id and text one stays.
    """
    rows, firsts = _grouped(docs, words, percent)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    judged = rows.join(firsts, "cls").groupBy("doc_id", "h").agg(F.bool_and(own.eqNullSafe(F.col("first"))).alias("kept"), F.count("*").alias("rows"))
    judged = written(judged.where("NOT kept OR rows > 1").select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), "kept"), "near-duplicates")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash"))
    out = docs.join(_small(judged.where("NOT kept")), same, "left_anti").select(docs.columns)
    repeated = judged.where("kept")
    if repeated.isEmpty():
        return out
    # these rows alone are compared by text
    repeated = _small(repeated)
    return out.join(repeated, same, "left_anti").unionByName(out.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(docs.columns)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reached r JOIN edges b ON r.y = b.x
), smallest AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY 1
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN smallest USING (doc_id) LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
