"""Operator 6: language-model scores from a hierarchical Pitman-Yor process.

Tokens are a text's lower-cased words, then one end. The context of a token is the word before it. Every word has a restaurant of its own; its parent is
the restaurant of its class (256 classes by the last two bytes; the start of a text is a class alone); one root is the parent of all classes, over a uniform
base. Seating is sampled by Gibbs sweeps: in a sweep all customers of a dish in a restaurant leave and are seated again one by one by the
Chinese-restaurant rule, each opened table sending a customer to the parent. Within a sweep the numbers of tables of whole restaurants stay as the sweep
before left them, so words are independent and sweeps run over word buckets in parallel. The predictive probabilities of the samples after the first sweep
are averaged.

Restaurants of words that make up 1 / CONTEXTS of the training tokens are numbered, and their table counts (with those of classes and the root, CONTEXTS +
513 at most) return to the driver. The others, however many, lie in the bucket of their context. That bucket counts the pairs, so it knows a restaurant's
customers and dishes; it tells the words' buckets each pair's class, times and the restaurant's dishes, and they reply with the class's averaged probability
of the word and the pair's averaged tables. A pair that occurs once has one table whatever is sampled; the others are seated in every sweep, where the number of tables
of the restaurant stays that of its dishes, its first seating. Where their second word is frequent (below), they are seated in their context's bucket, as guests, so that no
bucket has all pairs of such a word: what they send to its class's restaurant, and the probability they meet there, are those of the sweep before. The predictive probability has the averaged tables, so it adds up to one. It is that of the class times
the context's back-off times a gain that only seen pairs have, so a token asks its word's bucket and its context's, and neither asks the other.

Counts of all training texts are combined by (word, restaurant) or pair before they shuffle. Words that make up at least 1 / FREQUENT of the training tokens (so
FREQUENT words at most, whatever the corpus) are scored where the text is read, from a table of at most FREQUENT x (CONTEXTS + CLASSES) probabilities; the
rest is scored in the word's bucket, so no bucket gets more than that share of rows from one word.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _FOLD, as_bytes, blocks, drop_written, give_up, id_crc, lean, mix64, partitions, table, word_hashes, written

CLASSES, CONTEXTS = 256, 10_000
SWEEPS, BURN_IN = 4, 1
STRENGTH = 1.0
#: At most CONTEXTS, so that frequent words have numbered restaurants.
FREQUENT = 1_000
#: A word's identity is 50 bits of its hash, so that word and restaurant fit into one 64-bit key; restaurants below CLASSES are those of classes.
_WORD, _PLACE = np.uint64(0xFFFFFFFFFFFFC000), np.uint64(0x3FFF)
END = np.uint64(0x5DEECE66D1CE4000)
START_CLASS = CLASSES - 1
#: Customers that are seated one by one; beyond, they come in blocks of a sixteenth of those present, with one probability for each block.
ONE_BY_ONE = 64
#: Texts of about so many bytes, and so many texts at most, are scored together.
CHUNK, CHUNK_ROWS = 8 << 20, 30_000
#: The part of a hash that decides on the bucket, of a word or a pair.
_HEAD = np.uint64(0xFFFFFF0000000000)

#: Classes are 15 groups of last bytes by 16 groups of the bytes before them.
_LAST = (mix64(np.arange(256, dtype=np.uint64)) % np.uint64(15)).astype(np.uint64)
_SECOND = (mix64(np.arange(256, dtype=np.uint64) + np.uint64(977)) % np.uint64(16)).astype(np.uint64)


class Contexts:
    """The words with a restaurant of their own, and the class that is each restaurant's parent (a class is its own)."""

    def __init__(self, keys: np.ndarray, frequent: np.ndarray = np.empty(0, dtype=np.uint64)):
        """frequent: words whose pairs with contexts that aren't numbered are seated in the contexts' buckets."""
        keys = np.sort(keys)  # word and class
        self.frequent = np.sort(frequent)
        self.words = keys & _WORD
        self.parent = np.concatenate((np.arange(CLASSES), (keys & _PLACE).astype(np.intp)))

    def __len__(self):
        return len(self.parent)

    def restaurants(self, keys: np.ndarray) -> np.ndarray:
        """Of the tokens after these words, given with their classes."""
        at, has = _find(self.words, keys & _WORD)
        return np.where(has, at.astype(np.uint64) + np.uint64(CLASSES), keys & _PLACE)


def classed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in order, each 50 bits of its hash with its class; and the first word of each text, with the end."""
    hashes, first, starts, ends = word_hashes(texts)
    data = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    second = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0)
    return hashes & _WORD | (_LAST[data[ends - 1]] * np.uint64(16) + _SECOND[second]), first


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64 bits for each pair of words: 24 of the first one's hash, which deal it to that word's bucket, and 40 of a hash of both."""
    return before & _HEAD | mix64((before & _WORD) ^ mix64(words & _WORD)) & ~_HEAD


def keyed_tokens(texts: list[bytes], contexts: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of all texts in order: key (word's 50 bits and the restaurant or class it sits in), and the number of tokens of each text; then which

    tokens come after a word without a numbered restaurant, and these words with their classes.
    """
    words, first = classed_words(texts)
    counts = np.diff(first) + 1
    stops = np.cumsum(counts) - 1  # places of the ends
    keys = np.empty(int(counts.sum()), dtype=np.uint64)
    before = np.empty_like(keys)
    is_word = np.ones(len(keys), dtype=bool)
    is_word[stops] = False
    keys[is_word] = words & _WORD
    keys[stops] = END
    follows = np.concatenate(([True], ~is_word[:-1]))  # the first token of each text
    places = contexts.restaurants(words)
    before[~follows] = places
    before[follows] = START_CLASS
    rare = places < CLASSES
    return keys | before, counts, np.flatnonzero(~follows)[rare], words[rare]


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of results that are written: it does so once the driver's garbage is collected, which nothing else may start."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def find_contexts(docs: DataFrame) -> Contexts:
    """The words that make up 1 / CONTEXTS of the tokens, from exact counts: added up in each task, then by word; CONTEXTS rows at most reach the driver."""

    def run(batches):
        tokens = 0

        def words():
            nonlocal tokens
            for batch in batches:
                texts = as_bytes(batch.column(0))
                for begin, end in blocks(texts):
                    found = classed_words(texts[begin:end])[0]
                    tokens += len(found) + end - begin
                    yield found

        for k, c in counted(words()):
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([tokens], pa.int64())], names=["key", "n"])

    counts = written(docs.select("text").mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    tokens, words = (counts.where(f"key IS {x}").agg(F.sum("n")).first()[0] or 0 for x in ("NULL", "NOT NULL"))
    least = max(-(-tokens // CONTEXTS), 1)
    found = counts.where(F.col("key").isNotNull() & (F.col("n") >= least)).select("key", "n").toArrow()
    drop_written(counts)
    keys = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
    frequent = keys[found.column("n").to_numpy() * FREQUENT >= tokens] & _WORD
    return Contexts(keys, np.append(frequent, END) if (tokens - words) * FREQUENT >= tokens else frequent)


def bucket_edges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where, in sorted keys, each of n buckets (ranges of the hash) begins, and the end."""
    top = [np.uint64(min((i << 64) // n, (1 << 64) - 1)) & _HEAD for i in range(1, n)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(top, dtype=np.uint64)), [len(keys)]))


def summed(keys: np.ndarray, counts: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and their added counts; of other columns, the value beside a key."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=np.intp)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts, *(x[order[first]] for x in columns)


#: Distinct keys, and distinct pairs, that a task holds while it counts.
HELD, HELD_PAIRS = 1_000_000, 300_000


class Tally:
    """Keys, counts and columns beside the keys, added up as far as `most` distinct keys allow."""

    def __init__(self, most: int):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray, *columns: np.ndarray):
        """Yields what no longer fits."""
        if columns:
            k, at, c = np.unique(keys, return_index=True, return_counts=True)
        else:
            (k, c), at = np.unique(keys, return_counts=True), None
        self.parts.append((k, c, *(x[at] for x in columns)))
        self.held += len(k)
        if self.held > 2 * self.most:
            merged = self._merged()
            if len(merged[0]) > self.most:
                self.parts, self.held = [], 0
                yield merged
            else:
                self.parts, self.held = [merged], len(merged[0])

    def rest(self):
        if self.parts:
            yield self._merged()

    def _merged(self):
        return summed(*(np.concatenate(x) for x in zip(*self.parts)))


def counted(parts):
    """Keys and counts of arrays of keys, added up as far as HELD distinct ones allow."""
    tally = Tally(HELD)
    for part in parts:
        yield from tally.add(part)
    yield from tally.rest()


def packed(values: np.ndarray) -> bytes:
    """64-bit integers without loss: differences, their bytes by place, compressed. Best for rising ones."""
    steps = np.ascontiguousarray(values).astype(np.int64, copy=False).view(np.uint64).copy()
    steps[1:] -= steps[:-1].copy()
    return _framed(steps)


def _framed(steps: np.ndarray) -> bytes:
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(steps).to_bytes(8, "little") + bytes([width]) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unframed(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), dtype=np.uint8)
    if n * width:
        out[:, :width] = np.frombuffer(pa.decompress(data[9:], n * width, "zstd", asbytes=True), dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def unpacked(data: bytes | None) -> np.ndarray:
    return np.cumsum(_unframed(data), dtype=np.uint64).view(np.int64) if data else np.empty(0, dtype=np.int64)


def plain(values: np.ndarray) -> bytes:
    """Like packed, of integers from 0 in no order."""
    return _framed(np.ascontiguousarray(values).astype(np.uint64))


def unplain(data: bytes | None) -> np.ndarray:
    return _unframed(data).view(np.int64) if data else np.empty(0, dtype=np.int64)


def floats(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values, dtype=np.float64).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unfloats(data: bytes | None) -> np.ndarray:
    size = int.from_bytes(data[:8], "little") if data else 0
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), dtype=np.float64) if size else np.empty(0)


def joined(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype=kind)


_COUNTED = "bucket int, keys binary, counts binary, contexts binary, dishes binary, words binary, word_at binary, times binary"
_OF_FREQUENT = "more binary, guests binary, guest_times binary, guest_dishes binary"
_LETTERS = f"bucket int, source int, keys binary, counts binary, many binary, times binary, dishes binary, {_OF_FREQUENT}"
_OF_WORDS = f"bucket int, keys binary, counts binary, many binary, times binary, dishes binary, {_OF_FREQUENT}"
_SENT = "sources binary, source_keys binary, source_at binary, source_many binary"
_SEATED = "states array<binary>, tables binary"
_REPLIES = "bucket int, source int, chances binary, seats binary"
#: How a column is packed: as rising integers unless it is here.
_PACK = {x: (plain, unplain) for x in ("counts", "dishes", "word_at", "times", "place", "pair_place", "runs", "pair_runs", "source_keys", "source_many", "more", "guests", "guest_times", "guest_dishes")}
_PACK |= {x: (floats, unfloats) for x in ("chances", "seats", "tables")}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    pairs = [c.split() for c in schema.split(",")]
    return [(name, pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array") else _ARROW[kind]) for name, kind in pairs]


def _row(schema: str, **values) -> pa.RecordBatch:
    """One row, with arrays packed in binary columns; columns without a value are null."""
    kinds = _kinds(schema)
    value = lambda name, kind: _PACK.get(name, (packed,))[0](values[name]) if pa.types.is_binary(kind) and name in values else values.get(name)
    return pa.RecordBatch.from_arrays([pa.array([value(name, kind)], kind) for name, kind in kinds], names=[name for name, _ in kinds])


def _items(table, name: str, i: int) -> np.ndarray:
    return _PACK.get(name, (None, unpacked))[1](table.column(name)[i].as_py())


def _all(table, name: str) -> list[np.ndarray]:
    """The arrays of all rows, empty where they are null."""
    return [_items(table, name, i) for i in range(table.num_rows)]


def by_context(before: np.ndarray, words: np.ndarray, times: np.ndarray) -> dict[str, np.ndarray]:
    """Of distinct pairs: the contexts with their dishes, and the words, as places among the distinct ones, with the times, context by context."""
    order = np.lexsort((words, before))
    own, dishes = np.unique(before, return_counts=True)
    distinct, at = np.unique(words[order], return_inverse=True)
    return {"contexts": own, "dishes": dishes, "words": distinct, "word_at": at, "times": times[order]}


def count_pairs(docs: DataFrame, n: int, contexts: Contexts) -> DataFrame:
    """For each bucket one row: the sorted (word, restaurant) keys of all texts and how often they occur, where the restaurant is numbered or the start's; and of

    the bucket's other contexts, sorted, the number of dishes and, context by context, the words after it and how often they are.
    """

    def run(batches):
        cells, pairs = Tally(HELD), Tally(HELD_PAIRS)

        def dealt(found, columns):
            edges = bucket_edges(found[0], n)
            for i in np.flatnonzero(np.diff(edges)):
                yield _row(_COUNTED, bucket=int(i), **columns(*(x[edges[i] : edges[i + 1]] for x in found)))

        of_cells = lambda found: dealt(found, lambda k, c: {"keys": k, "counts": c})
        of_pairs = lambda found: dealt(found, lambda _, times, before, words: by_context(before, words, times))
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for begin, end in blocks(texts):
                keys, _, at, before = keyed_tokens(texts[begin:end], contexts)
                words = keys[at] & _WORD
                numbered = np.ones(len(keys), dtype=bool)
                numbered[at] = False
                for found in cells.add(keys[numbered]):
                    yield from of_cells(found)
                for found in pairs.add(pair_keys(before, words), before, words):
                    yield from of_pairs(found)
        for found in cells.rest():
            yield from of_cells(found)
        for found in pairs.rest():
            yield from of_pairs(found)

    def merge(group: pa.Table) -> pa.Table:
        give_up()
        k, c = summed(joined(_all(group, "keys")).view(np.uint64), joined(_all(group, "counts")))
        found = [_pairs(group, i) for i in range(group.num_rows)]
        before, words, times = (joined(x) for x in zip(*((np.repeat(own, dishes), words, times) for own, dishes, words, times in found)))
        _, times, before, words = summed(pair_keys(before, words), times, before, words)
        row = _row(_COUNTED, bucket=group.column("bucket")[0].as_py(), keys=k, counts=c, **by_context(before, words, times))
        return pa.Table.from_batches([row])

    return docs.select("text").mapInArrow(lean(run), _COUNTED).groupBy("bucket").applyInArrow(merge, _COUNTED)


class Pairs:
    """The restaurants of one bucket's contexts that aren't numbered, as count_pairs gives them."""

    def __init__(self, contexts: np.ndarray, dishes: np.ndarray, words: np.ndarray, times: np.ndarray, n: int, frequent: np.ndarray = np.empty(0, dtype=np.uint64)):
        self.contexts, self.dishes, self.words, self.times, self.n = contexts, dishes, words, times, n
        self.own = np.repeat(np.arange(len(contexts)), dishes)
        cells = words | (contexts & _PLACE)[self.own]
        self.keys, self.at = np.unique(cells, return_inverse=True)  # word and class
        word, is_frequent = _find(frequent, words)
        self.guests = np.flatnonzero((times > 1) & is_frequent)
        self.guest_cells = word[self.guests] * CLASSES + (cells[self.guests] & _PLACE).astype(np.intp)
        many = np.flatnonzero((times > 1) & ~is_frequent)
        self.many = many[np.argsort(cells[many], kind="stable")]
        self.key_edges, self.many_edges = bucket_edges(self.keys, n), bucket_edges(cells[self.many], n)

    def letters(self):
        """What each bucket of words must know: the bucket, keys, pairs of each that occur once; of the others the key, times, and dishes of the restaurant; and

        by key, how often those pairs occur that are seated here, the guests.
        """
        more = np.bincount(self.at[self.guests], weights=self.times[self.guests], minlength=len(self.keys))
        once = np.bincount(self.at[self.times == 1], minlength=len(self.keys))
        for i in np.flatnonzero(np.diff(self.key_edges)):
            part, many = slice(self.key_edges[i], self.key_edges[i + 1]), self.many[self.many_edges[i] : self.many_edges[i + 1]]
            yield int(i), self.keys[part], once[part], (self.at[many] - part.start), self.times[many], self.dishes[self.own[many]], more[part]

    def settle(self, chances: np.ndarray, seats: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the probabilities of `keys` and the tables of `guests` and `many`: sorted pairs, the log10 of their gain, and the log10 of each context's back-off.

        A word's probability after a context is that after the class, times the back-off, times the gain if the pair was seen.
        """
        tables = np.ones(len(self.words))
        tables[np.concatenate((self.guests, self.many))] = seats
        rooms = STRENGTH + discount * np.bincount(self.own, weights=tables, minlength=len(self.contexts))
        customers = np.bincount(self.own, weights=self.times, minlength=len(self.contexts))
        gain = np.log10(1 + (self.times - discount * tables) / (rooms[self.own] * chances[self.at]))
        pairs = pair_keys(self.contexts[self.own], self.words)
        order = np.argsort(pairs)
        return pairs[order], gain[order], np.log10(rooms / (STRENGTH + customers))


def _pairs(table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row's contexts, dishes, words and times."""
    contexts, dishes, words, at, times = (_items(table, x, i) for x in ("contexts", "dishes", "words", "word_at", "times"))
    return contexts.view(np.uint64), dishes, words.view(np.uint64)[at], times


def count_cells(counts: DataFrame, n: int, frequent: np.ndarray = np.empty(0, dtype=np.uint64)) -> DataFrame:
    """From the rows of count_pairs: for each bucket one row with the sorted (word, restaurant) keys of all texts and the customers that they send for sure, that

    is how often they occur in a numbered restaurant or after the start, and for classes how many pairs occur once. For pairs that occur more often: place of the key, times,
    and dishes of the context's restaurant. sources, source_keys and source_many: who sent how many keys (at source_at among the row's) and such pairs, in order.

    Pairs of a frequent word that occur more than once may be many, so they stay in the bucket of their context, as guests: number of word and class, times and dishes.
    more: by key, how often its guests elsewhere occur.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                own = Pairs(*_pairs(batch, i), n, frequent)
                keys, guests = _items(batch, "keys", i), {"guests": own.guest_cells, "guest_times": own.times[own.guests], "guest_dishes": own.dishes[own.own[own.guests]]}
                yield _row(_LETTERS, bucket=bucket, source=-1, keys=keys, counts=_items(batch, "counts", i), more=np.zeros(len(keys)), **guests)
                for to, keys, once, many, times, dishes, more in own.letters():
                    yield _row(_LETTERS, bucket=to, source=bucket, keys=keys, counts=once, many=many, times=times, dishes=dishes, more=more)

    def merge(group: pa.Table) -> pa.Table:
        give_up()
        group = group.sort_by("source")
        keys, many = _all(group, "keys"), _all(group, "many")
        sizes, others = np.array([len(x) for x in keys]), np.array([len(x) for x in many])
        keys, at = np.unique(np.concatenate(keys).view(np.uint64), return_inverse=True)
        counts, more = (np.bincount(at, weights=joined(_all(group, x)), minlength=len(keys)).astype(np.int64) for x in ("counts", "more"))
        guests = {x: joined(_all(group, x)) for x in ("guests", "guest_times", "guest_dishes")}
        many = at[np.concatenate(many) + np.repeat(np.cumsum(sizes) - sizes, others)]
        sources = group.column("source").to_numpy()
        sent = sources >= 0
        row = _row(
            f"{_OF_WORDS}, {_SENT}", bucket=group.column("bucket")[0].as_py(), keys=keys, counts=counts, many=many, times=joined(_all(group, "times")),
            dishes=joined(_all(group, "dishes")), sources=sources[sent], source_keys=sizes[sent], source_at=at[sizes[~sent].sum() :], source_many=others[sent], more=more, **guests,
        )
        return pa.Table.from_batches([row])

    return counts.mapInArrow(lean(run), _LETTERS).groupBy("bucket").applyInArrow(merge, f"{_OF_WORDS}, {_SENT}")


class Words:
    """One bucket's words: their cells in the contexts' restaurants, in the classes' and in the root."""

    def __init__(self, bucket: int, keys: np.ndarray, counts: np.ndarray, contexts: Contexts, many=(np.empty(0, dtype=np.intp), np.empty(0), np.empty(0)), more=None, *guests):
        """many: of pairs that occur more than once and whose context isn't numbered, place among the keys, times, and dishes of the context's restaurant.

        more and guests: as count_cells gives them.
        """
        self.bucket = bucket
        place = (keys & _PLACE).astype(np.intp)
        cls = contexts.parent[place]
        self.up_keys, up = np.unique(keys & _WORD | cls.astype(np.uint64), return_inverse=True)
        self.cls = (self.up_keys & _PLACE).astype(np.intp)
        self.words, self.top = np.unique(self.up_keys & _WORD, return_inverse=True)  # class cell -> word
        at, self.times, self.dishes = many
        self.many = up[at]  # pair -> class cell
        self.states: list[bytes] = []  # kept samples, the current one last
        self.guests, self.guest_times, self.guest_dishes = guests or (np.empty(0, dtype=np.intp), np.empty(0), np.empty(0))
        frequent, has = _find(contexts.frequent, self.up_keys & _WORD)
        self.hosts = np.flatnonzero(has)  # class cells of frequent words, with their number
        self.host_cells = frequent[self.hosts] * CLASSES + self.cls[self.hosts]
        self.counts = np.bincount(self.top[up], weights=counts if more is None else counts + more, minlength=len(self.words)) + np.bincount(self.top[self.many], weights=self.times, minlength=len(self.words))
        deep = place >= CLASSES
        self.keys, self.customers, self.place, self.up = keys[deep], counts[deep], place[deep], up[deep]  # cells of contexts; context cell -> class cell
        self.direct = np.bincount(up[~deep], weights=counts[~deep], minlength=len(self.up_keys))  # customers of classes that are there in any seating
        self.once = counts[~deep & (place != START_CLASS)].sum()  # pairs


class Level:
    """Customers and tables of one level's restaurants, over the whole corpus."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, discount: float):
        self.discount = discount
        self.open = STRENGTH + discount * tables  # weight of a new table, before the parent's probability
        self.share = 1 / (STRENGTH + customers)
        self.back = self.open * self.share


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each cell's customers one by one; weight: of a new table."""
    tables = np.ones(len(customers))
    order = np.argsort(-customers, kind="stable")
    tables_o, c, w = tables[order], customers[order].astype(np.float64), weight[order]
    seated, most = 1, c[0] if len(c) else 0
    while seated < most:
        block = 1 if seated < ONE_BY_ONE else seated // 16
        n = int(np.searchsorted(-c, -seated, side="left"))  # cells with more customers than are seated
        t = tables_o[:n]
        p = w[:n] / (w[:n] + np.maximum(seated - discount * t, 1e-9))
        if block == 1:
            t += rng.random(n) < p
        else:
            t += rng.binomial(np.minimum(block, c[:n] - seated).astype(np.int64), np.clip(p, 0, 1))
        seated += block
    tables[order] = tables_o
    return tables


class State:
    """Seating of a bucket's words, and the predictive probabilities it gives."""

    def __init__(self, w: Words, kept: bytes | None = None, sent: np.ndarray | None = None):
        """kept: from a state's keep(); else every cell has one table. sent: customers that guests everywhere send to the class cells of frequent words."""
        self.w, self.sent = w, sent
        sizes = [len(w.words), len(w.up_keys), len(w.keys), len(w.many), len(w.guests)]
        tables = unplain(kept).astype(np.float64) if kept else np.ones(sum(sizes))
        self.t0, self.t1, self.t2, self.t3, self.t4 = np.split(tables, np.cumsum(sizes[:-1]))
        self._up()
        self._top()

    def keep(self) -> bytes:
        return plain(np.concatenate((self.t0, self.t1, self.t2, self.t3, self.t4)))

    def _up(self):
        n = len(self.w.up_keys)
        self.c1 = self.w.direct + np.bincount(self.w.up, weights=self.t2, minlength=n) + np.bincount(self.w.many, weights=self.t3, minlength=n)
        if self.sent is not None:
            self.c1 = self.c1.astype(np.float64)  # an empty count has integers
            self.c1[self.w.hosts] += self.sent[self.w.host_cells]

    def _top(self):
        self.c0 = np.bincount(self.w.top, weights=self.t1, minlength=len(self.w.words))

    def probabilities(self, levels: list[Level], base: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word in the root; discounted shares of class and context cells."""
        l0, l1, l2 = levels
        root = (self.c0 - l0.discount * self.t0) * l0.share[0] + l0.back[0] * base
        s1 = (self.c1 - l1.discount * self.t1) * l1.share[self.w.cls]
        s2 = (self.w.customers - l2.discount * self.t2) * l2.share[self.w.place]
        return root, s1, s2

    def sweep(self, levels: list[Level], base: float, rng: np.random.Generator, sent: np.ndarray | None = None, chances: np.ndarray | None = None) -> None:
        """sent: as above, from now on; chances: of the class cells of frequent words, for guests, who keep their tables without."""
        l0, l1, l2 = levels
        root, s1, _ = self.probabilities(levels, base)
        in_class = s1 + l1.back[self.w.cls] * root[self.w.top]
        self.t2 = seat(self.w.customers, l2.open[self.w.place] * in_class[self.w.up], l2.discount, rng)
        self.t3 = seat(self.w.times, (STRENGTH + l2.discount * self.w.dishes) * in_class[self.w.many], l2.discount, rng)
        if chances is not None:
            self.t4 = seat(self.w.guest_times, (STRENGTH + l2.discount * self.w.guest_dishes) * chances[self.w.guests], l2.discount, rng)
        self.sent, self.in_class = sent, in_class
        self._up()
        self.t1 = seat(self.c1, l1.open[self.w.cls] * root[self.w.top], l1.discount, rng)
        self._top()
        self.t0 = seat(self.c0, np.full(len(self.c0), l0.open[0] * base), l0.discount, rng)

    def tables(self, restaurants: int) -> np.ndarray:
        """Of the root, of the classes, of all numbered restaurants (those of the contexts count here), and of the others by class."""
        w = self.w
        by_class = [np.bincount(w.cls, weights=self.t1, minlength=CLASSES), np.bincount(w.place, weights=self.t2, minlength=restaurants)]
        return np.concatenate(([self.t0.sum()], *by_class, np.bincount(w.cls[w.many], weights=self.t3, minlength=CLASSES)))


    def of_frequent(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """What guests send, and the chances that the last sweep saw in class cells of frequent words here."""
        chances = np.zeros(size)
        chances[self.w.host_cells] = self.in_class[self.w.hosts]
        return np.bincount(self.w.guests, weights=self.t4, minlength=size), chances


class Model:
    """Corpus totals and the history of table counts; a sweep's random numbers depend on it and the bucket only, so it gives the same wherever it runs."""

    def __init__(self, tokens: int, types: int, direct: np.ndarray, customers: np.ndarray, discounts: tuple[float, float, float], contexts: Contexts):
        self.tokens, self.types, self.discounts, self.contexts = tokens, types, discounts, contexts
        #: Tokens seated in classes at once, and tokens of each restaurant.
        self.direct, self.customers = direct, customers
        self.base = 1 / (types + 1)
        self.history: list[np.ndarray] = []
        #: Of the class cells of frequent words: the customers from guests in each state, and their chances as each sweep found them.
        self.sent: list[np.ndarray] = []
        self.chances: list[np.ndarray] = []

    def sent_to(self, i: int) -> np.ndarray | None:
        """What counts as sent in state i: from guests as the sweep before found them, since they sit elsewhere."""
        return self.sent[max(i - 1, 0)] if self.sent else None

    def levels(self, i: int) -> list[Level]:
        t0, t1, t2, t3 = np.split(self.history[i], [1, 1 + CLASSES, 1 + CLASSES + len(self.contexts)])
        in_classes = self.direct + np.bincount(self.contexts.parent, weights=t2, minlength=CLASSES) + t3
        if self.sent:
            in_classes += self.sent_to(i).reshape(-1, CLASSES).sum(axis=0)
        return [Level(t1.sum(keepdims=True), t0, self.discounts[0]), Level(in_classes, t1, self.discounts[1]), Level(self.customers, t2, self.discounts[2])]

    def replay(self, w: Words, sweeps: int):
        """The bucket's state at first and after each sweep; sweep i needs the tables of the state before it, history[i]."""
        state = State(w, None, self.sent_to(0))
        yield state
        for i in range(sweeps):
            self.sweep(state, i)
            yield state

    def sweep(self, state: State, i: int) -> None:
        chances = self.chances[i - 1] if i and self.chances else None
        state.sweep(self.levels(i), self.base, np.random.default_rng([state.w.bucket, i]), self.sent_to(i + 1), chances)

    def samples(self, w: Words):
        """The states after the first sweep, each with its number: those that were kept, or else sampled again."""
        if w.states:
            begin = len(self.history) - len(w.states)
            yield from ((begin + i, State(w, kept, self.sent_to(begin + i))) for i, kept in enumerate(w.states))
        else:
            yield from ((i, state) for i, state in enumerate(self.replay(w, len(self.history) - 1)) if i > BURN_IN)

    def predict(self, w: Words, queries: np.ndarray, seats: np.ndarray | None = None) -> np.ndarray:
        """Averaged predictive probability of sorted or unsorted keys, words that aren't in the bucket's training counts included.

        seats: takes the averaged tables of the pairs w.many and w.guests.
        """
        word, place = queries & _WORD, (queries & _PLACE).astype(np.intp)
        cls, deep = self.contexts.parent[place], place >= CLASSES
        at2, has2 = _find(w.keys, queries)
        at1, has1 = _find(w.up_keys, word | cls.astype(np.uint64))
        at0, has0 = _find(w.words, word)
        out, n = np.zeros(len(queries)), 0
        pick = lambda values, at, has: np.where(has, values[at], 0.0) if len(values) else np.zeros(len(at))
        for i, state in self.samples(w):
            levels = self.levels(i)  # of this very state, so that probabilities add up to one
            l0, l1, l2 = levels
            root, s1, s2 = state.probabilities(levels, self.base)
            p = np.where(has0, pick(root, at0, has0), l0.back[0] * self.base)
            p = pick(s1, at1, has1) + l1.back[cls] * p
            out += np.where(deep, pick(s2, at2, has2) + l2.back[place] * p, p)
            n += 1
            if seats is not None:
                seats += (np.concatenate((state.t3, state.t4)) - seats) / n
        return out / n


def _find(among: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(among):
        return np.zeros(len(wanted), dtype=np.intp), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(among, wanted), len(among) - 1)
    return at, among[at] == wanted


def _each_bucket(batches, contexts: Contexts):
    for batch in batches:
        for i in range(batch.num_rows):
            keys, counts, *rest = (_items(batch, x, i) for x, _ in _kinds(_OF_WORDS)[1:])
            w = Words(batch.column("bucket")[i].as_py(), keys.view(np.uint64), counts, contexts, rest[:3], *rest[3:])
            if "states" in batch.schema.names:
                w.states = batch.column("states")[i].as_py() or []
            yield w


def replies(cells: DataFrame, model: Model) -> DataFrame:
    """To each bucket of contexts, its guests first and then in the order of its letters: averaged probabilities of keys, and tables of pairs that occur more than once."""

    def run(batches):
        for batch in batches:
            for i, w in enumerate(_each_bucket([batch], model.contexts)):
                keys = _items(batch, "keys", i).view(np.uint64)
                in_class = (keys & _PLACE) < CLASSES
                chances, seats = np.zeros(len(keys)), np.zeros(len(w.many) + len(w.guests))
                chances[in_class] = model.predict(w, keys[in_class], seats)
                sources, sizes, at, others = (_items(batch, x, i) for x in ("sources", "source_keys", "source_at", "source_many"))
                yield _row(_REPLIES, bucket=w.bucket, source=-1, seats=seats[len(w.many) :])
                key_ends, many_ends = np.cumsum(sizes), np.cumsum(others)
                for j, to in enumerate(sources):
                    mine = at[key_ends[j] - sizes[j] : key_ends[j]]
                    yield _row(_REPLIES, bucket=int(to), source=w.bucket, chances=chances[mine], seats=seats[many_ends[j] - others[j] : many_ends[j]])

    return cells.mapInArrow(lean(run), _REPLIES)


def train(cells: DataFrame, contexts: Contexts, sweeps: int = SWEEPS) -> tuple[Model, DataFrame]:
    """Totals and the first seating, one table for each cell; then the sweeps. Also the cells with the states after the first sweep.

    cells: as count_cells gives them, written; each sweep writes them anew with its state and removes those before.
    """
    places, size, cells_of_frequent = len(contexts), 1 + 2 * CLASSES + len(contexts), len(contexts.frequent) * CLASSES
    of_words, seated = [name for name, _ in _kinds(_OF_WORDS)], f"{_OF_WORDS}, {_SENT}, {_SEATED}"

    def added(rows: DataFrame, vectors, length: int) -> np.ndarray:
        """Sum of the vectors of rows, place by place: in each task, then by place."""

        def run(batches):
            total = np.zeros(length)
            for x in vectors(batches):
                total += x
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

        got = rows.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(length)
        out[got.column("at").to_numpy()] = got.column("n").to_numpy()
        return out

    def totals(w: Words) -> np.ndarray:
        state = State(w)
        once_and_twice = np.array([(x == i).sum() for x in (state.c0, state.c1, w.customers) for i in (1, 2)]) + [0, 0, 0, 0, w.once, (w.times == 2).sum() + (w.guest_times == 2).sum()]
        direct = np.bincount(w.cls, weights=w.direct, minlength=CLASSES)
        return np.concatenate(([w.counts.sum(), len(w.words), *once_and_twice], direct, np.bincount(w.place, weights=w.customers, minlength=places), state.tables(places), np.bincount(w.guests, minlength=cells_of_frequent)))

    head, direct, customers, first, sent = np.split(
        added(cells.select(*of_words), lambda batches: map(totals, _each_bucket(batches, contexts)), 8 + CLASSES + places + size + cells_of_frequent),
        np.cumsum([8, CLASSES, places, size]),
    )
    discounts = tuple(float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95)) for one, two in head[2:].reshape(3, 2))
    model = Model(int(head[0]), int(head[1]), direct, customers, discounts, contexts)
    model.history.append(first)
    model.sent.append(sent)
    for i in range(sweeps):

        def step(batches, i=i):
            for batch in batches:
                for j, w in enumerate(_each_bucket([batch], contexts)):
                    state = State(w, w.states[-1] if w.states else None, model.sent_to(i))
                    model.sweep(state, i)
                    kept = w.states if i > BURN_IN else []
                    values = {"states": pa.array([[*kept, state.keep()]], pa.list_(pa.binary())), "tables": pa.array([floats(np.concatenate((state.tables(places), *state.of_frequent(cells_of_frequent))))], pa.binary())}
                    names = [name for name, _ in _kinds(seated)]
                    yield pa.RecordBatch.from_arrays([values[x] if x in values else batch.column(x).slice(j, 1) for x in names], names=names)

        before, cells = cells, written(cells.mapInArrow(lean(step), seated), "lm-seated")
        drop_written(before)
        found = added(cells.select("tables"), lambda batches: (x for b in batches for x in _all(b, "tables")), size + 2 * cells_of_frequent)
        for past, now in zip((model.history, model.sent, model.chances), np.split(found, np.cumsum([size, cells_of_frequent]))):
            past.append(now)
    return model, cells


def frequent_words(cells: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that make up 1 / FREQUENT of the tokens: their hashes, log10 of count + 1, and log10 probabilities in all restaurants."""
    least, places = max(model.tokens / FREQUENT, 1), len(model.contexts)

    def run(batches):
        for w in _each_bucket(batches, model.contexts):
            often = np.flatnonzero(w.counts >= least)
            for one in often:
                p = np.log10(model.predict(w, w.words[one] | np.arange(places, dtype=np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(w.words[one : one + 1].view(np.int64)), pa.array(w.counts[one : one + 1]), pa.array([p], pa.list_(pa.float64()))], names=["word", "n", "p"])

    # FREQUENT rows of CONTEXTS + CLASSES numbers at most
    rows = cells.drop("tables", *(name for name, _ in _kinds(_SENT))).mapInArrow(run, "word long, n double, p array<double>").toArrow()
    words = rows.column("word").to_numpy().view(np.uint64) if rows.num_rows else np.empty(0, dtype=np.uint64)
    order = np.argsort(words)
    p = rows.column("p").combine_chunks().flatten().to_numpy().reshape(-1, places)[order] if rows.num_rows else np.empty((0, places))
    return words[order], np.log10(rows.column("n").to_numpy()[order] + 1) if rows.num_rows else np.empty(0), p


def _sorted(keys: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, places = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(keys, kind="stable")
    return keys[order], places[order]


_ASKED = "bucket int, chunk long, row array<long>, doc array<long>, tokens array<int>, known array<int>, base array<double>, score array<double>, place binary, runs binary, keys binary, pair_place binary, pair_runs binary, pairs binary"
_ASKED_KINDS = _kinds(_ASKED)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys, the distinct ones and how often each is there."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=np.intp)
    return keys[first], np.diff(np.append(first, len(keys)))


def score(docs: DataFrame, training: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score and score (log10).

    training has the texts to learn from. A null or empty text is one token, the end. Without training texts all words are unknown and the base is
    uniform. Rows that repeat a doc_id are scored each.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    contexts = find_contexts(training)
    counts = written(count_pairs(training, n, contexts), "lm-pairs")
    release(spark)
    cells = written(count_cells(counts, n, contexts.frequent), "lm-cells")
    release(spark)
    model, cells = train(cells, contexts, sweeps)
    release(spark)
    shipped = spark.sparkContext.broadcast(frequent_words(cells, model))
    norm = float(np.log10(model.tokens + model.types + 1))

    def ask(batches):
        words, log_counts, table_p = shipped.value

        def chunk(rows, ids, texts):
            local = np.zeros((3, len(texts)))
            tokens = np.empty(len(texts), dtype=np.int64)
            places, asked, pair_places, asked_pairs = [], [], [], []
            for begin, end in blocks(texts):
                keys, counts, after, before = keyed_tokens(texts[begin:end], contexts)
                tokens[begin:end] = counts
                place = np.repeat(np.arange(begin, end, dtype=np.int16), counts)
                pair_places.append(place[after])
                asked_pairs.append(pair_keys(before, keys[after]))
                at, often = _find(words, keys & _WORD)
                place_often = (keys[often] & _PLACE).astype(np.intp)
                sums = lambda x: np.bincount(place[often], weights=x, minlength=len(texts))  # noqa: B023,E731
                if often.any():
                    local += [sums(None), sums(log_counts[at[often]] - norm), sums(table_p[at[often], place_often])]
                places.append(place[~often])
                asked.append(keys[~often])
            (keys, place), (pairs, pair_place) = (_sorted(asked, places), _sorted(asked_pairs, pair_places))
            edges, pair_edges = bucket_edges(keys, n), bucket_edges(pairs, n)
            own = int(rows[0])
            yield _row(_ASKED, bucket=own % n, chunk=own, row=rows, doc=ids, tokens=tokens, known=local[0].astype(np.int64), base=local[1], score=local[2])
            for i in np.flatnonzero(np.diff(edges) + np.diff(pair_edges)):
                part, both = slice(edges[i], edges[i + 1]), slice(pair_edges[i], pair_edges[i + 1])
                (k, runs), (p, pair_runs) = _runs(keys[part]), _runs(pairs[both])
                yield _row(_ASKED, bucket=int(i), chunk=own, keys=k, runs=runs, place=place[part], pairs=p, pair_runs=pair_runs, pair_place=pair_place[both])

        rows, ids, texts, held = [], [], [], 0
        for batch in batches:
            for r, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                rows.append(r)
                ids.append(k)
                texts.append(t)
                held += len(t)
                if held >= CHUNK or len(rows) >= CHUNK_ROWS:
                    yield from chunk(rows, ids, texts)
                    rows, ids, texts, held = [], [], [], 0
        if rows:
            yield from chunk(rows, ids, texts)

    def answer(known: pa.Table, asked: pa.Table):
        give_up()
        if not asked.num_rows:
            return _empty()
        bucket = asked.column("bucket")[0].as_py()
        w = Words(bucket, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), contexts)
        pairs, gain, before, back_off = np.empty(0, dtype=np.uint64), np.empty(0), np.empty(0, dtype=np.uint64), np.empty(0)
        if known.num_rows:
            known = known.sort_by("source")
            kind = [known.filter(pc.is_valid(known.column(c))) for c in ("counts", "contexts", "source")]
            w = next(_each_bucket([kind[0]], contexts), w)
            if kind[1].num_rows:
                restaurants = Pairs(*_pairs(kind[1], 0), n, contexts.frequent)
                pairs, gain, back_off = restaurants.settle(joined(_all(kind[2], "chances"), float), joined(_all(kind[2], "seats"), float), model.discounts[2])
                before = restaurants.contexts & _WORD
        out = []
        p = base = is_known = gains = np.empty(0)
        asked_keys, asked_pairs = ([x.view(np.uint64) for x in _all(asked, c)] for c in ("keys", "pairs"))
        every = np.concatenate(asked_keys)
        if len(every):
            distinct, back = np.unique(every, return_inverse=True)
            at, has = _find(w.words, distinct & _WORD)
            p = np.log10(model.predict(w, distinct))
            if len(before):  # the token after this word backs off
                context, is_context = _find(before, distinct & _WORD)
                p += np.where(is_context, back_off[context], 0)
            p = p[back]
            base = (np.log10(np.where(has, w.counts[at], 0) + 1) if len(w.words) else np.zeros(len(distinct)))[back] - norm
            is_known = has[back]
        every = np.concatenate(asked_pairs)
        if len(every):
            at, has = _find(pairs, every)
            gains = np.where(has, gain[at], 0.0) if len(pairs) else np.zeros(len(every))
        begin = begin_pairs = 0
        for i in range(asked.num_rows):
            if asked.column("row")[i].is_valid:
                out.append(asked.slice(i, 1).combine_chunks().to_batches()[0])
                continue
            part, both = slice(begin, begin + len(asked_keys[i])), slice(begin_pairs, begin_pairs + len(asked_pairs[i]))
            begin, begin_pairs = part.stop, both.stop
            places, runs, pair_places, pair_runs = (_items(asked, x, i) for x in ("place", "runs", "pair_place", "pair_runs"))
            of_keys, of_pairs = np.repeat(np.arange(len(runs)), runs), np.repeat(np.arange(len(pair_runs)), pair_runs)
            docs_at, at = np.unique(np.concatenate((places, pair_places)), return_inverse=True)
            sums = lambda x, at: np.bincount(at, weights=x, minlength=len(docs_at))  # noqa: B023,E731
            key_docs, pair_docs = at[: len(places)], at[len(places) :]
            scores = sums(p[part][of_keys], key_docs) + sums(gains[both][of_pairs], pair_docs)
            known_here = sums(is_known[part][of_keys], key_docs).astype(np.int64)
            out.append(_row(_ASKED, bucket=bucket, chunk=asked.column("chunk")[i].as_py(), place=docs_at, known=known_here, base=sums(base[part][of_keys], key_docs), score=scores))
        return pa.Table.from_batches(out)

    def _empty():
        return pa.Table.from_arrays([pa.array([], kind) for _, kind in _ASKED_KINDS], names=[name for name, _ in _ASKED_KINDS])

    final = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def collect(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket")  # one order of adding up
        has_rows = [x.is_valid for x in group.column("row")]
        head = group.slice(has_rows.index(True), 1)
        docs_here, tokens = head.column("doc")[0].as_py(), head.column("tokens")[0].values.to_numpy()
        known, base, total = (head.column(c)[0].values.to_numpy().astype(np.float64) for c in ("known", "base", "score"))
        for i, is_head in enumerate(has_rows):
            if not is_head:
                place = _items(group, "place", i)
                for sums, c in ((known, "known"), (base, "base"), (total, "score")):
                    sums[place] += group.column(c)[i].values.to_numpy()
        return pa.Table.from_arrays(
            [pa.array(docs_here, pa.int64()), pa.array(tokens, pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.full(len(tokens), model.tokens)), pa.array(base), pa.array(total)],
            names=[c.strip().split(" ")[0] for c in final.split(",")],
        )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    asked = numbered.mapInArrow(lean(ask), _ASKED)
    of_words = cells.drop("tables", *(name for name, _ in _kinds(_SENT)))
    known = of_words.unionByName(counts.drop("keys", "counts"), allowMissingColumns=True).unionByName(replies(cells, model), allowMissingColumns=True)
    answered = known.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, _ASKED)
    return answered.groupBy("chunk").applyInArrow(collect, final)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc("doc_id") % 7 == 2
    out = score(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
