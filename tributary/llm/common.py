"""Shared helpers: tables, the shared folder, word splitting and vectorised hashing of bytes."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a Java and a Python character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of an Arrow batch where the session has no smaller limits: texts can be long, and a batch is held several times over by a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, whatever the lengths of texts."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and all of Spark is in one process (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


#: Rows of a narrow table for each of its files, at least.
ROWS_A_FILE = 20_000


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    rows: a bound on the number of (narrow) rows where one is known; then there are no more files than they fill. The folder is removed when the driver's
    JVM ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if rows is not None and 1 + rows // ROWS_A_FILE < partitions(spark):
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table made by written() once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What a worker process keeps from task to task, by kind. Workers live on from stage to stage, so tasks of other stages give it up.
KEPT: dict = {}


def give_up() -> None:
    """Drop what other stages keep in this process, and hand free memory back to the system: it counts beside that of the JVM."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """run over a task's batches, in a process that holds nothing from other stages then, and no free memory afterwards."""

    def task(batches):
        give_up()
        yield from run(batches)
        give_up()

    return task


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_crc(column: str) -> Column:
    """crc32 of an integer id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


# --- vectorised hashing of the words of many texts at once -----------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _BASE_INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
#: Words longer than this are hashed with a wider table of powers made on demand.
_POWERS = {"up": powers(_BASE, 1 << 16), "down": powers(_BASE_INVERSE, 1 << 16)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_POWERS[which]) < n:
        _POWERS[which] = powers(_BASE if which == "up" else _BASE_INVERSE, 1 << int(n - 1).bit_length())
    return _POWERS[which]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text after lower-casing A-Z: (64-bit hashes, first word of each text with the end, and the bytes' buffer

    positions of word starts and ends). Words are maximal runs of bytes that aren't white space. A word's hash depends on its bytes
    and length only: a sum of byte codes times powers of an odd base, made independent of the place by the inverse power, then mixed.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    n = len(data)
    up, down = _power("up", n), _power("down", n)
    summed = np.empty(n + 1, dtype=np.uint64)
    summed[0] = 0
    np.cumsum(_BYTE_CODE[_FOLD[data]] * up[:n], out=summed[1:])
    hashes = mix64((summed[ends] - summed[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return hashes, np.searchsorted(starts, bounds), starts, ends


def blocks(texts: list[bytes], most: int = 1 << 20):
    """Index ranges of consecutive texts of about `most` bytes together; a longer text stands alone."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow string or binary column as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
