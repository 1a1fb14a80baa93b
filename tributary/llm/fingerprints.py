"""Operator 9: improbable-feature digests of whole texts.

Every window of WINDOW bytes is ranked by how rare its entropy is; of each SPAN successive windows the leftmost one of lowest rank gets a point,
and windows of POINTS points or more are features. Features are hashed into chained Bloom filters of FILTER_BYTES bytes; a filter that holds
FEATURES features is closed and the next one opened. Two digests are compared by the overlap of filter bits beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix64, partitions, table

WINDOW, SPAN, POINTS = 64, 64, 16
FILTER_BYTES, FEATURES, PROBES = 256, 160, 5
#: Ranges of the key for each shuffle partition.
PARTS = 4
#: Bytes that are worked on at once, so that memory doesn't grow with a text.
PIECE = 1 << 20
_SCALE = 1 << 20

_c = np.arange(WINDOW + 2, dtype=np.float64)
_f = np.concatenate(([0.0], _c[1:] * np.log2(_c[1:])))
#: Change of sum(c * log2 c), in fixed point, when a byte's count in the window goes from c - 1 to c.
_STEP = np.concatenate(([0], np.round((_f[1:] - _f[:-1]) * _SCALE))).astype(np.int64)


def _rank_table(levels: int = 1000) -> np.ndarray:
    """Rank of each entropy level (0 to 1000 thousandths of the highest). Level 0 ranks last; the rest by rarity: entropies of windows are taken as

    normally spread about 0.67 with 0.06, the usual values for prose, and a level's rank is its density. Levels far above or below rank first.
    Windows of almost no entropy (below 0.1) are no features at all.
    """
    level = np.arange(levels + 1) / levels
    density = np.exp(-0.5 * ((level - 0.67) / 0.06) ** 2)
    rank = np.round(density * 900).astype(np.int64) + 1
    rank[level < 0.1] = 1001
    return rank


_RANK = _rank_table()


def _ranks(data: np.ndarray) -> np.ndarray:
    """Rank of every window of the bytes."""
    n = len(data)
    before = np.zeros(n, dtype=np.uint8)  # equal bytes among the WINDOW - 1 before, and after
    behind = np.zeros(n, dtype=np.uint8)
    for lag in range(1, min(WINDOW, n)):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        behind[: n - lag] += same
    total = np.empty(n - WINDOW + 1, dtype=np.int64)
    counts = np.bincount(data[:WINDOW])
    total[0] = np.sum(np.concatenate([_STEP[1 : c + 1] for c in counts if c]))
    if n > WINDOW:
        total[1:] = total[0] + np.cumsum(_STEP[before[WINDOW:].astype(np.intp) + 1] - _STEP[behind[: n - WINDOW].astype(np.intp) + 1])
    # entropy = log2(WINDOW) - total / WINDOW, as thousandths of log2(WINDOW)
    top = int(np.log2(WINDOW)) * WINDOW * _SCALE
    return _RANK[np.clip((top - total) * 1000 // top, 0, 1000)]


def _chosen(ranks: np.ndarray) -> np.ndarray:
    """Points of every window: how often it is the leftmost lowest of SPAN successive ones."""
    n = len(ranks)
    span = min(SPAN, n)
    key = ranks * (1 << 32) + np.arange(n)
    low, width = key, 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    points = np.bincount(low & 0xFFFFFFFF, minlength=n)
    points[ranks > 1000] = 0
    return points


def features(data: bytes) -> np.ndarray:
    """64-bit hashes of the chosen windows, in order. A text shorter than a window has one feature, itself; an empty one none."""
    if len(data) < WINDOW:
        return np.array([int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")], dtype=np.uint64) if data else np.empty(0, dtype=np.uint64)
    whole = np.frombuffer(data, dtype=np.uint8)
    least = min(POINTS, max(1, (len(whole) - WINDOW + 1) // 4))
    out = []
    overlap = WINDOW + 2 * SPAN
    # pieces overlap so far that every window's points are whole in one piece
    for at in range(0, max(1, len(whole) - overlap), PIECE):
        begin = max(0, at - overlap)
        part = whole[begin : at + PIECE + overlap]
        points = _chosen(_ranks(part))
        spots = np.flatnonzero(points >= least)
        last = at + PIECE >= len(whole) - overlap
        spots = spots[(spots + begin >= at) & ((spots + begin < at + PIECE) | last)]
        if len(spots):
            out.append(_hashed(part, spots))
    found = np.concatenate(out) if out else np.empty(0, dtype=np.uint64)
    return found if len(found) else _whole(data)


def _whole(data: bytes) -> np.ndarray:
    """The text as its own feature, where there is no other: a short text, or windows without entropy."""
    return np.array([int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")], dtype=np.uint64)


def _hashed(data: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at the spots."""
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[spots].copy().view("<u8")
    h = np.zeros(len(spots), dtype=np.uint64)
    for k in range(WINDOW // 8):
        h = mix64(h ^ words[:, k]) + np.uint64(k + 1)
    return mix64(h)


#: Texts of these lengths are worked on together, about TOGETHER bytes at once: enough windows for the usual points, not too long.
_LEAST_TOGETHER, _MOST_TOGETHER, TOGETHER = WINDOW + SPAN, 1 << 16, 1 << 18


def features_of(texts: list[bytes]) -> list[np.ndarray]:
    """features() of each text. Windows of all usual texts are ranked in one array; those that cross from one text to the next are left out."""
    out: list = [None] * len(texts)
    held: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if _LEAST_TOGETHER <= len(t) <= _MOST_TOGETHER:
            held.append(i)
            size += len(t)
            if size >= TOGETHER:
                _together(texts, held, out)
                held, size = [], 0
        else:
            out[i] = features(t)
    if held:
        _together(texts, held, out)
    return out


def _together(texts: list[bytes], which: list[int], out: list) -> None:
    data = np.frombuffer(b"".join(texts[i] for i in which), dtype=np.uint8)
    sizes = np.array([len(texts[i]) for i in which])
    ends = np.cumsum(sizes)
    ranks = _ranks(data)
    n = len(ranks)
    low, width = ranks * (1 << 32) + np.arange(n), 1
    while width < SPAN:  # SPAN is a power of two
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    # spans whose windows all lie in one text: from its start to SPAN + WINDOW - 1 bytes before its end
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, ends - sizes, 1)
    np.add.at(edge, ends - (SPAN + WINDOW - 2), -1)
    inside = np.cumsum(edge)[: len(low)] > 0
    points = np.bincount(low[inside] & 0xFFFFFFFF, minlength=n)
    spots = np.flatnonzero((points >= POINTS) & (ranks <= 1000))
    hashes = _hashed(data, spots) if len(spots) else np.empty(0, dtype=np.uint64)
    cuts = np.searchsorted(spots, ends)
    for i, a, b in zip(which, np.concatenate(([0], cuts[:-1])), cuts):
        out[i] = hashes[a:b] if b > a else _whole(texts[i])


def digest(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters of a text; see filters()."""
    return filters(features(data))


def filters(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters (rows of FILTER_BYTES) of features and the number in each. A feature that came before isn't inserted again."""
    _, first = np.unique(found, return_index=True)
    found = found[np.sort(first)]
    n = -(-len(found) // FEATURES)
    bits = np.zeros((n, FILTER_BYTES * 8), dtype=np.uint8)
    row = np.arange(len(found)) // FEATURES
    for p in range(PROBES):
        bits[row, ((found >> np.uint64(11 * p)) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.intp)] = 1
    return np.packbits(bits, axis=1), np.bincount(row, minlength=n) if n else np.empty(0, dtype=np.int64)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def likeness(a: tuple, b: tuple) -> float:
    """0 to 1: mean, over the filters of the digest with fewer, of the best overlap with a filter of the other one.

    Overlap is the number of shared bits beyond what chance gives, as a share of the most there can be. Two empty digests are alike; an empty and
    another one aren't.
    """
    (fa, na), (fb, nb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(fa):
        return 1.0 if not len(fb) else 0.0
    size, weight, total = FILTER_BYTES * 8, 0, 0.0
    bits_b = _BITS[fb].sum(1)
    for f, n in zip(fa, na):
        bits = int(_BITS[f].sum())
        shared = _BITS[fb & f].sum(1)
        chance = bits * bits_b / size
        most = np.minimum(bits, bits_b)
        # the cut lies above the expected number by a tenth of the way to the most
        cut = chance + 0.1 * (most - chance)
        score = np.where(shared > cut, (shared - cut) / np.maximum(most - cut, 1e-9), 0.0)
        total += n * float(np.max(score))
        weight += n
    return min(1.0, total / weight)


def as_text(d: tuple) -> str:
    """features:filter, joined by |, filters in base 64."""
    return "|".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for f, n in zip(*d))


def edited(text: str, other: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many (or all) of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text, part, copy), in partitions by part: all rows, and for each part the first rows of the next one as copies (copy 1).

    Parts are ranges of the key between quantiles; before them come ranges of the text's hash, for null keys, which are in the order of that hash. The last
    part gets the first rows of all. Only the key column is read for the bounds; the texts shuffle once.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    # several parts for each partition, so that those which meet in one by hash even out
    wanted_parts = PARTS * n
    cuts = sorted(set(rows.approxQuantile(key, [i / wanted_parts for i in range(1, wanted_parts)], max(0.2 / wanted_parts, 1e-4))))
    rows = rows.withColumn("known", F.col(key).isNotNull()).withColumn("at", F.coalesce(F.col(key), F.xxhash64(text)))
    # a binary search on the key as a double, which keeps the order
    bucketizer = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="_at", outputCol="_part")
    rows = bucketizer.transform(rows.withColumn("_at", F.col("at").cast("double"))).drop("_at")
    of_hash = F.shiftright((F.shiftright("at", 33) + (1 << 30)) * wanted_parts, 31)
    rows = rows.withColumn("part", F.when(F.col("known"), F.col("_part").cast("int") + wanted_parts).otherwise(of_hash.cast("int"))).drop("_part")
    firsts = rows.groupBy("part").agg(F.min(F.struct("known", "at")).alias("f")).orderBy("part").collect()  # a row for each part
    # (first place of a part, part that needs its rows as copies); one for each part
    wanted = docs.sparkSession.createDataFrame([(b.f.known, b.f.at, a.part) for a, b in zip(firsts, firsts[1:] + firsts[:1])], "known boolean, at long, copied_to int")
    copies = rows.join(F.broadcast(wanted), ["known", "at"]).groupBy("known", "at", key, F.col("copied_to").alias("part")).agg(F.min(text).alias(text))
    dealt = rows.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1))).repartition(n, "part").sortWithinPartitions("part", "copy", "at", text)
    return dealt.select(key, text, "part", "copy")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): the digests of the text and of its edited form, and how like the text's digest is to that and to the next row's.

    The next row is that of the next doc_id (ties by text; null first, by the texts' hashes), after the last the first. A null text counts as empty: no filters, an empty
    fingerprint. An empty table gives no rows.
    """

    def run(batches):
        held = None  # (part, doc_id, text, digest) of the row before
        done = None  # part whose copy has been used
        for batch in batches:
            rows = []
            for key, text, part, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "copy"))):
                if not (copy and done == part):
                    rows.append((key, text, part, copy))
                    done = part if copy else done
            for begin, end in blocks([r[1] for r in rows]):
                chunk = rows[begin:end]
                own = [filters(f) for f in features_of([r[1].encode("utf-8", "replace") for r in chunk])]
                pairs = []  # (row, next text, next digest)
                for (key, text, part, copy), d in zip(chunk, own):
                    if held is not None and held[0] == part:
                        pairs.append((held, text, d))
                    held = None if copy else (part, key, text, d)
                if pairs:
                    changed = [edited(row[2], other).encode("utf-8", "replace") for row, other, _ in pairs]
                    out = []
                    for ((_, key, text, mine), _, next_digest), data, f in zip(pairs, changed, features_of(changed)):
                        d = filters(f)
                        out.append((key, len(text), hashlib.sha256(data).hexdigest(), as_text(mine), as_text(d), likeness(mine, d), likeness(mine, next_digest)))
                    yield _rows(out)

    return neighbours(docs.select("doc_id", "text")).mapInArrow(run, OUT)


def _rows(out: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.strip().split(" ")[0] for c in OUT.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
