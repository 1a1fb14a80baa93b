"""Merge-type piece vocabularies of the sentencepiece library: reading, splitting, exact encoding, decoding and counting.

A text is normalised as the model's identity rule does it: a space is put in front of a text that isn't empty and every space becomes the
mark U+2581. Symbols start as single characters; the adjacent pair whose joined piece has the highest score merges first, the leftmost
among equals. Characters that are no piece end as byte pieces.

Two engines share the vocabulary: `PrefixTable` (the unique last piece of every prefix, operator 5) and `HeapCounter` (heap and linked
list, operator 10).
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

MARK = "▁"
#: Field numbers and piece kinds of the library's public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(field number, value) of one message of the protocol buffer wire format."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """Pieces, scores and kinds of a model file, with what both engines need. Picklable."""

    def __init__(self, model: bytes):
        self.source = hashlib.sha256(model).hexdigest()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix = True
        model_type = 1
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models with the identity normaliser that keep extra white space are supported")
                self.dummy_prefix = bool(spec.get(3, 1))
        if model_type != 2:
            raise ValueError("only merge-type (BPE) models are supported")
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.byte_ids = [0] * 256
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
        self.ids = {p: i for i, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == NORMAL}
        #: rank of a piece: 0 merges first; equal scores share a rank.
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[self.scores[i]] for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds the space mark after other characters; texts can't be split at spaces")
        self.newline_alone = not any("\n" in p for p in self.ids if len(p) > 1)
        if not all(c in self.ids for p in self.ids for c in p):
            raise ValueError("a piece holds a character that is no piece itself")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())

    def char_ids(self, char: str) -> list[int]:
        """Ids of a character that no merge has taken up."""
        i = self.ids.get(char)
        return [i] if i is not None else [self.byte_ids[b] for b in char.encode("utf-8", "replace")]


class Memo(dict):
    """What an engine makes of a chunk, `prefix` put in front. Two generations of `most` chunks each: what is still in use moves on, so a full memo

    forgets rare chunks only, and memory doesn't grow with the corpus. Chunks of more than LONGEST characters aren't kept.
    """

    LONGEST = 64

    def __init__(self, make, prefix: str, most: int):
        self.make, self.prefix, self.most, self.old = make, prefix, most, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(self.prefix + word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


class Chunks:
    """Cut a text where no merge can reach across: before a run of spaces, and on both sides of a line feed.

    No piece has the space mark after another character, so a merge never joins a character with a following space. `spaced` and `bare` map a
    word that stands after one space, or after none, to what an engine makes of it; `run` does so for anything else.
    """

    def __init__(self, vocabulary: Vocabulary, make, most: int = 150_000):
        self.spaced, self.bare, self.run = Memo(make, MARK, most), Memo(make, "", most // 5), Memo(make, "", most // 5)
        self.newline_alone = vocabulary.newline_alone
        self.prefix = vocabulary.dummy_prefix

    def of(self, text: str) -> list:
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if self.prefix:
            text = " " + text
        if not self.newline_alone:
            return [self.run[c] for c in _cut(text)]
        out: list = []
        lines = text.split("\n")
        if "  " in text:
            for i, line in enumerate(lines):
                if i:
                    out.append(self.bare["\n"])
                if "  " in line:
                    out.extend(map(self.run.__getitem__, _cut(line)))
                elif line:
                    self._line(line, out)
            return out
        for i, line in enumerate(lines):
            if i:
                out.append(self.bare["\n"])
            if line:
                self._line(line, out)
        return out

    def _line(self, line: str, out: list) -> None:
        words = line.split(" ")
        if words[0]:
            out.append(self.bare[words[0]])
        del words[0]
        out.extend(map(self.spaced.__getitem__, words))


_RUNS = re.compile(" +[^ ]*|[^ ]+")


def _cut(line: str) -> list[str]:
    return [c.replace(" ", MARK) for c in _RUNS.findall(line)]


def merged(chunk: str, rank: dict[str, int]) -> tuple[list[str], int]:
    """The symbols left after all merges ('' where one was taken up), and the number of merges.

    Symbols stand in a linked list; joinable neighbours wait in a heap, lowest rank first and leftmost among equals. An entry of the heap
    is stale when one of its sides has merged otherwise meanwhile.
    """
    symbols: list[str] = list(chunk)
    n = len(symbols)
    heap = [(rank[x], i, x) for i in range(n - 1) if (x := symbols[i] + symbols[i + 1]) in rank]
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges, pop, push = 0, heapq.heappop, heapq.heappush
    while heap:
        _, i, joined = pop(heap)
        left, j = symbols[i], after[i]
        if not left or j >= n or left + symbols[j] != joined:
            continue
        merges += 1
        symbols[i], symbols[j] = joined, ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (x := joined + symbols[k]) in rank:
                push(heap, (rank[x], i, x))
        h = before[i]
        if h >= 0 and (x := symbols[h] + joined) in rank:
            push(heap, (rank[x], h, x))
    return symbols, merges


class HeapCounter:
    """Number of ids of a text: initial symbols minus merges, plus the bytes beyond one of each character that is no piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.rank, self.ids = vocabulary.rank, vocabulary.ids
        self.chunks = Chunks(vocabulary, self.chunk)

    def chunk(self, chunk: str) -> int:
        beyond = sum(len(c.encode("utf-8", "replace")) - 1 for c in chunk if c not in self.ids)
        return len(chunk) - (merged(chunk, self.rank)[1] if len(chunk) > 1 else 0) + beyond

    def count(self, text: str) -> int:
        return sum(self.chunks.of(text))


class PrefixTable:
    """The unique last piece of every prefix, from automaton matches and a test of neighbouring pieces; ids are read backwards.

    A piece sequence is the merge result exactly if each piece is its own merge result and no merge ever crosses between two neighbours: the
    first crossing merge in the whole text would also be the first in the two neighbours alone. So the last piece of a prefix is the one that
    ends there and is compatible with the last piece of what stands before it. Only runs of spaces hold pieces of equal rank, whose merges have
    no order of their own; a chunk that starts with two spaces or more is merged step by step.
    """

    #: Answers of the test of neighbours that are kept at once.
    PAIRS = 250_000

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v, self.rank, self.ids = vocabulary, vocabulary.rank, vocabulary.ids
        self.split: dict[str, tuple[str, str]] = {}
        #: first id << 20 | second id -> whether the two may stand side by side
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in sorted(self.ids, key=len):
            if len(piece) == 1 or self._last_merge(piece):
                self.automaton.add_word(piece, (len(piece), self.ids[piece]))
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in vocabulary.pieces]
        self.digits = [str(i) for i in range(len(vocabulary.pieces))]
        self.bytes = dict(zip(self.digits, Decoder(vocabulary).text))
        self.chunks = Chunks(vocabulary, self._memo)

    def _last_merge(self, piece: str) -> bool:
        """Note which two parts the last merge of a piece joins; false if merging its characters doesn't end in the piece."""
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if all(len(x) == 1 and x in self.ids or x in self.split and self.rank[x] <= self.rank[piece] for x in (a, b)) and self._apart(a, b, piece):
                self.split[piece] = (a, b)
                return True
        return False

    def _apart(self, a: str, b: str, whole: str | None = None) -> bool:
        """True if no merge crosses from a to b before both are complete (or before they merge into `whole`).

        Goes back in time: of the two symbols beside the border the one made last is undone, the right one among equals. While two symbols
        stand side by side, their own merge must not come before the next change of either.
        """
        rank, split, x, y = self.rank, self.split, a, b
        end, on_left = (rank[whole], True) if whole else (1 << 60, True)
        while True:
            joined = rank.get(x + y)
            if joined is not None and (joined < end or joined == end and not on_left):
                return False
            made_x, made_y = rank[x] if len(x) > 1 else -1, rank[y] if len(y) > 1 else -1
            if made_x < 0 and made_y < 0:
                return True
            if made_y >= made_x:
                end, on_left, y = made_y, False, split[y][0]
            else:
                end, on_left, x = made_x, True, split[x][1]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of one chunk; a character that is no piece ends as its bytes."""
        ids = self.ids
        if chunk.startswith(MARK + MARK):
            out = []
            for x in merged(chunk, self.rank)[0]:
                if x:
                    out.extend([ids[x]] if x in ids else self.v.char_ids(x))
            return out
        n = len(chunk)
        # id of the last piece of each prefix; -1 where no piece ends
        last = [-1] * (n + 1)
        pairs = self.pairs
        for at, (size, piece) in self.automaton.iter(chunk):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before >= 0:
                    key = before << 20 | piece
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= self.PAIRS:
                            pairs.clear()
                        ok = pairs[key] = self._apart(self.v.pieces[before], self.v.pieces[piece])
                    if not ok:
                        continue
                elif chunk[start - 1] in ids:
                    continue
                # else: after a character that is no piece anything may stand
            last[end] = piece
        out = []
        sizes = self.sizes
        while n:
            piece = last[n]
            if piece >= 0:
                out.append(piece)
                n -= sizes[piece]
            else:
                n -= 1
                out.extend(reversed(self.v.char_ids(chunk[n])))
        out.reverse()
        return out

    def _memo(self, chunk: str) -> str:
        return ",".join([self.digits[i] for i in self.chunk_ids(chunk)])

    def digits_of(self, text: str) -> str:
        """The ids as decimal numbers joined by commas."""
        return ",".join(self.chunks.of(text))

    def encode(self, text: str) -> list[int]:
        found = self.digits_of(text)
        return list(map(int, found.split(","))) if found else []

    def encode_and_decode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimal numbers joined by commas, and the text that decoding the ids gives."""
        found = self.digits_of(text)
        if not found:
            return 0, "", ""
        back = b"".join(map(self.bytes.__getitem__, found.split(",")))
        return found.count(",") + 1, found, finished(back, self.v.dummy_prefix)


class Decoder:
    """Text of a list of ids, as the library gives it: marks become spaces, the one in front that encoding put there goes, control ids are

    silent, byte pieces are put together to UTF-8 and every byte that is no part of a character becomes U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.prefix = vocabulary.dummy_prefix
        self.text: list[bytes] = []
        for piece, kind in zip(vocabulary.pieces, vocabulary.kinds):
            if kind == BYTE:
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                self.text.append(" \u2047 ".encode())
            else:
                self.text.append(b"" if kind == CONTROL else piece.replace(MARK, " ").encode())

    def decode(self, ids) -> str:
        return finished(b"".join(map(self.text.__getitem__, ids)), self.prefix)


def finished(out: bytes, prefix: bool) -> str:
    """Decoded text from the bytes of the pieces: without the space that encoding put in front, as UTF-8."""
    if prefix and out[:1] == b" ":
        out = out[1:]
    try:
        return out.decode()
    except UnicodeDecodeError:
        return _lenient(out)


def _lenient(data: bytes) -> str:
    """UTF-8 in which each byte outside a whole character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)
