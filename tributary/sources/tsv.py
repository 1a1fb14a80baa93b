"""Tab-separated sources and sinks: every field text, quotes literal, empty fields empty and never null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = ["entity_id", "business_name", "business_address", "country"]


def schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str, columns: list[str] = RECORD, escape: str | None = None) -> DataFrame:
    """Columns as declared, never inferred; what the reader gives as null is ''. escape: the character that the writer escaped tabs and line ends with."""
    options = {"sep": "\t", "header": True, "quote": "", "encoding": "UTF-8", "mode": "FAILFAST"} | ({"escape": escape} if escape else {})
    rows = spark.read.schema(schema(columns)).options(**options).csv(path)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def write_records(df: DataFrame, path: str) -> None:
    """Rows as text under a header, nothing quoted; fields must not hold tabs or line ends."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", nullValue="").csv(path)


def read_split(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(source 1, sources 2 and 3 together), each with its source's name."""
    read = {s: read_tsv(spark, p).withColumn("source", F.lit(s)) for s, p in paths.items()}
    return read["S1"], read["S2"].unionByName(read["S3"])


def write_id_lists(lists: DataFrame, path: str, id_column: str = "source1_entity_id", list_column: str = "matched_entity_ids", order: str | None = None, one_file: bool = False) -> None:
    """(s1_id, ids) as a header and one line each, empty lists too.

    order: a column of lists by which the lines stand, over the part files in the order of their names. one_file: a single part, which one task writes.
    """
    if order:
        lists = lists.orderBy(order)
    out = lists.select(F.col("s1_id").cast("string").alias(id_column), F.col("ids").alias(list_column))
    out = out.coalesce(1) if one_file else out
    out.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", nullValue="").csv(path)


def read_id_lists(spark: SparkSession, path: str, id_column: str = "source1_entity_id", list_column: str = "matched_entity_ids") -> DataFrame:
    return read_tsv(spark, path, [id_column, list_column]).select(F.col(id_column).alias("s1_id"), F.col(list_column).alias("ids"))
