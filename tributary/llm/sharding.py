"""Operator 4: shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups (equal texts).

Differencing keeps partial partitions of k subsets. The two with the largest spread are combined, the largest subset of one with the smallest
of the other, until one is left. Here each task differences its own share of the groups; tasks of the next level go on in the same way with the partial
partitions (k sums) of FAN tasks each, until one task's share is left for the driver. So no task and not the driver holds more than a bounded number of
sums, and the shards depend on the rows alone, not on the session.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written


#: Rows for each task that differences groups, partial partitions for each task that goes on with them, and rows for each bucket in which slots are numbered.
GROUPS, FAN, SLOTS = 20_000, 1_000, 50_000
#: Names of partial subsets are broadcast up to this number, which is counted first.
BROADCAST_ROWS = 200_000


def difference(partials: list[list[tuple[int, object]]], k: int) -> list[tuple[int, object]]:
    """Combine partial partitions, each a list of at most k (sum, members); members are leaves or pairs of members."""

    def entry(n: int, subsets: list) -> tuple:
        low = subsets[-1][0] if len(subsets) == k else 0
        return low - subsets[0][0], n, subsets

    heap = [entry(n, sorted(p, key=lambda s: -s[0])) for n, p in enumerate(partials) if p]
    heapq.heapify(heap)
    n = len(partials)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        # the subsets of b that meet an empty one of a, smallest of a last: b's largest go to the empty places
        joined = a + b[:free]
        rest = b[free:]
        for i, (size, members) in enumerate(rest):
            # a descending against b ascending
            at = len(a) - 1 - i
            joined[at] = (joined[at][0] + size, (joined[at][1], members))
        joined.sort(key=lambda s: -s[0])
        n += 1
        heapq.heappush(heap, entry(n, joined))
    return heap[0][2] if heap else []


def leaves(members) -> list:
    out, stack = [], [members]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return out


def shard(docs: DataFrame, shards: int = 24, overhead: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard, by bucket and key), grown_shard (null).

    Size is the text's UTF-8 bytes (null: none) plus `overhead`. Null and empty texts are equal. Rows with equal texts, repeated rows too, are in
    one shard. Null keys are numbered like others, first in their bucket. An empty table gives no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    # equal texts: 64-bit hash, CRC and length all agree
    rows = docs.select(F.col(key), F.xxhash64(body).alias("h"), F.crc32(body).alias("text_crc32"), (F.octet_length(body) + overhead).cast("long").alias("size"))
    same = ["h", "text_crc32", "size"]
    n = docs.count()
    # one task for each GROUPS rows: with fewer, a task's own differencing would have too few groups to be even
    tasks = max(1, n // GROUPS)
    groups = rows.groupBy(*same).agg(F.sum("size").alias("bytes")).withColumn("task", F.pmod(F.col("h"), F.lit(tasks)))

    def local(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in same])
        subset = _subsets([[(b, i)] for i, b in enumerate(group.column("bytes").to_pylist())], shards, group.num_rows)
        return group.append_column("subset", pa.array(subset, pa.int32()))

    # one row for each group of equal texts; tasks are dealt by hash
    local_parts = written(groups.groupBy("task").applyInArrow(local, groups.withColumn("subset", F.lit(0)).schema), "shard-groups")
    sums = local_parts.groupBy("task", "subset").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("subset", "place")
    names = _named(sums, tasks, shards)
    names = F.broadcast(names) if tasks * shards <= BROADCAST_ROWS else names
    placed = rows.join(local_parts.join(names.withColumnRenamed("place", "subset"), ["task", "subset"]).select(*same, "shard"), same)
    # slots without one task for each shard: number the rows of (shard, bucket), then add what stands in earlier buckets
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(F.col(key), F.lit("slot"), "h"), F.lit(1 + n // SLOTS)))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(key, *same)) - 1
    return (
        placed.withColumn("number", number)
        .join(offsets, ["shard", "bucket"])
        .select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def _subsets(partials: list, shards: int, n: int) -> list[int]:
    """Which subset of the differenced partition each of n leaves is in."""
    out = [0] * n
    for s, (_, members) in enumerate(difference(partials, shards)):
        for i in leaves(members):
            out[i] = s
    return out


def _named(sums: DataFrame, tasks: int, shards: int) -> DataFrame:
    """(task, place, shard) of the partial subsets (task, place, bytes) of all tasks, level by level."""
    spark = sums.sparkSession
    if tasks <= FAN:
        partials: dict[int, list] = {}
        rows = sums.orderBy("task", "place").collect()  # FAN x shards rows at most
        for i, r in enumerate(rows):
            partials.setdefault(r.task, []).append((r.bytes, i))
        shard_of = _subsets(list(partials.values()), shards, len(rows))
        return spark.createDataFrame([(r.task, r.place, s) for r, s in zip(rows, shard_of)], "task long, place int, shard int")

    def onward(group: pa.Table) -> pa.Table:
        group = group.sort_by([("task", "ascending"), ("place", "ascending")])
        partials: dict[int, list] = {}
        for i, (t, b) in enumerate(zip(group.column("task").to_pylist(), group.column("bytes").to_pylist())):
            partials.setdefault(t, []).append((b, i))
        return group.append_column("up_place", pa.array(_subsets(list(partials.values()), shards, group.num_rows), pa.int32()))

    dealt = sums.withColumn("up", F.floor(F.col("task") / FAN).cast("long"))
    level = written(dealt.groupBy("up").applyInArrow(onward, dealt.withColumn("up_place", F.lit(0)).schema), "shard-level")
    above = level.groupBy(F.col("up").alias("task"), F.col("up_place").alias("place")).agg(F.sum("bytes").alias("bytes"))
    names = _named(above, -(-tasks // FAN), shards)
    return level.join(names.select(F.col("task").alias("up"), F.col("place").alias("up_place"), "shard"), ["up", "up_place"]).select("task", "place", "shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
