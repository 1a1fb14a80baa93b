"""Incremental linkage (an extension): new records of a stream are linked with a static corpus, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, decide


def link_batch(records: DataFrame, corpus: DataFrame, max_df: int, threshold: float) -> DataFrame:
    """(s1_id, cand_id, p) of new records (part, id, token) whose best corpus record (part, id, token) reaches the threshold."""
    pairs = blocking.token_pairs(corpus, records, max_df).select(F.col("id_1").alias("s1_id"), F.col("id_2").alias("cand_id"), F.col("score").alias("p"))
    return decide.best_owner(pairs).where(F.col("p") >= threshold)


def link_stream(records: DataFrame, corpus: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, max_df: int = 5000, threshold: float = 0.5) -> StreamingQuery:
    """Start a query that links every micro-batch of a stream (part, id, token) with the static corpus and hands the links to sink(links, batch id).

    A batch that is run again after a failure has the same id, so a sink that overwrites by id keeps each link once.
    """
    return records.writeStream.foreachBatch(lambda batch, n: sink(link_batch(batch, corpus, max_df, threshold), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and sums of a stream (ts, event_type, value) in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
