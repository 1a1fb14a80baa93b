"""Operator 2: secrets by fixed patterns, and by probabilistic automata inferred from the credentials these find.

For each kind a prefix tree of labelled credentials (a bounded, documented sample of the distinct ones) is generalised by merging statistically
compatible states (Hoeffding bounds on the shares of endings and next symbols). Every run of credential characters of every text that is as long as a kind's
shortest credentials is then scored by that kind's automaton. A run as likely as nearly all labelled credentials of a kind, and far likelier as one than as
ordinary text, is a secret of kind "grammar". Ordinary text is what byte pairs of all texts say.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, blocks, lean, table, written

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Candidates are runs of these characters, without full stops at either end.
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Bound of the labelled sample, for each kind; significance of the merge test; share of labelled credentials that may score below the cut.
EXAMPLES, ALPHA, TAIL = 600, 0.05, 0.01
#: Bits by which a run must be likelier as a credential than as ordinary text: one chance run in 2 ** EVIDENCE.
EVIDENCE = 14.0

#: log2 of the chance of the rarest byte after another. A digit beside a letter, or a capital after a small letter, counts as this rare, however often
#: the credentials themselves have it.
RAREST = -10.0

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[list(TOKEN_CHARS.encode())] = True

#: Symbol classes of the automata; a class's probability is shared evenly by its characters.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_", "-", "=", ".")
SYMBOL = {c: i for i, cls in enumerate(CLASSES) for c in cls}
FLOOR = 1e-4


class Automaton:
    """A probabilistic automaton over symbol classes, inferred from examples."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.total, self.final, self.next = [0], [0], [{}]  # next: symbol -> [state, count]
        for x in examples:
            s = 0
            self.total[0] += 1
            for c in x:
                step = self.next[s].get(SYMBOL.get(c, len(CLASSES)))
                if step is None:
                    step = self.next[s][SYMBOL.get(c, len(CLASSES))] = [len(self.total), 0]
                    self.total.append(0)
                    self.final.append(0)
                    self.next.append({})
                step[1] += 1
                s = step[0]
                self.total[s] += 1
            self.final[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.cut = 0.0
        if examples:
            scores = sorted(self.score(x) for x in examples)
            self.cut = scores[int(TAIL * len(scores))]

    def _differ(self, fa: int, na: int, fb: int, nb: int) -> bool:
        return abs(fa / na - fb / nb) > self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self.total[a], self.total[b]
            if not na or not nb:
                continue
            if self._differ(self.final[a], na, self.final[b], nb):
                return False
            for symbol in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(symbol), self.next[b].get(symbol)
                if self._differ(x[1] if x else 0, na, y[1] if y else 0, nb):
                    return False
                if x and y:
                    stack.append((x[0], y[0]))
        return True

    def _merge(self) -> None:
        """States are kept (red) or merged into the first compatible kept one, in order of the prefix tree."""
        red, edges = [0], [(0, s) for s in sorted(self.next[0])]
        while edges:
            parent, symbol = edges.pop(0)
            child = self.next[parent][symbol][0]
            if child in red:
                continue
            into = next((r for r in red if self._compatible(r, child)), None)
            if into is None:
                red.append(child)
                edges += [(child, s) for s in sorted(self.next[child])]
            else:
                self.next[parent][symbol][0] = into
                self._fold(into, child)
                # folding may give kept states new children outside the kept ones
                seen = set(edges)
                edges += [(r, s) for r in red for s in sorted(self.next[r]) if self.next[r][s][0] not in red and (r, s) not in seen]

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.total[a] += self.total[b]
            self.final[a] += self.final[b]
            for symbol, (target, count) in self.next[b].items():
                step = self.next[a].get(symbol)
                if step is None:
                    self.next[a][symbol] = [target, count]
                else:
                    step[1] += count
                    stack.append((step[0], target))

    def states(self) -> int:
        seen, stack = {0}, [0]
        while stack:
            for target, _ in self.next[stack.pop()].values():
                if target not in seen:
                    seen.add(target)
                    stack.append(target)
        return len(seen)

    def score(self, text: str) -> float:
        """Mean log2 likelihood of the characters and the end."""
        s, out = 0, 0.0
        for c in text:
            symbol = SYMBOL.get(c, len(CLASSES))
            step = self.next[s].get(symbol)
            size = len(CLASSES[symbol]) if symbol < len(CLASSES) else 100
            out += math.log2(max(step[1] / self.total[s] if step else 0.0, FLOOR) / size)
            s = step[0] if step else 0
        end = self.final[s] / self.total[s] if self.total[s] else 0.0
        return (out + math.log2(max(end, FLOOR))) / (len(text) + 1)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What score() adds up, as arrays: log2 of each step and its target by state and symbol, and log2 of each state's end."""
        n, symbols = len(self.total), len(CLASSES) + 1
        sizes = np.array([*map(len, CLASSES), 100])
        step, target, total = np.zeros((n, symbols)), np.zeros((n, symbols), dtype=np.int32), np.maximum(np.array(self.total, dtype=np.float64), 1)
        for s, ways in enumerate(self.next):
            for symbol, (to, count) in ways.items():
                step[s, symbol], target[s, symbol] = count, to
        ends = np.array(self.final) / total
        return np.log2(np.maximum(step / total[:, None], FLOOR) / sizes), target, np.log2(np.maximum(ends, FLOOR))


_SYMBOL_OF = np.full(256, len(CLASSES), dtype=np.intp)
for _c, _i in SYMBOL.items():
    _SYMBOL_OF[ord(_c)] = _i


_byte = np.arange(256)
_digit, _small, _capital = ((_byte >= ord(a)) & (_byte <= ord(b)) for a, b in ("09", "az", "AZ"))
_letter = _small | _capital
_MIXED = (_digit[:, None] & _letter) | (_letter[:, None] & _digit) | (_small[:, None] & _capital)


class Grammar:
    """Automata by kind, and log2 of the chance of each byte after another in ordinary text."""

    def __init__(self, automata: dict[str, Automaton], pairs: np.ndarray):
        self.automata = automata
        self.cuts = {kind: (a.cut, LEAST[kind], *a.tables()) for kind, a in automata.items()}
        seen = np.where(_MIXED, 0, pairs.reshape(256, 256)) + 1.0
        self.ordinary = np.maximum(np.log2(seen / seen.sum(axis=1, keepdims=True)), RAREST)

    def accepted(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which of the runs (starts and sizes in data) are credentials of some kind."""
        out = np.zeros(len(starts), dtype=bool)
        if not len(starts):
            return out
        before = np.concatenate((np.array([32], dtype=np.uint8), data[:-1]))
        summed = np.concatenate(([0.0], np.cumsum(self.ordinary[before, data])))
        plain = summed[starts + sizes] - summed[starts]
        order = np.argsort(-sizes, kind="stable")
        at, length = starts[order], sizes[order]
        symbols = _SYMBOL_OF[data]
        for cut, least, step, target, end in self.cuts.values():
            n = int(np.searchsorted(-length, -least, side="right"))  # runs that are long enough
            if not n:
                continue
            state, total, held = np.zeros(n, dtype=np.intp), np.zeros(n), n
            for t in range(int(length[0])):
                held = int(np.searchsorted(-length[:held], -t, side="left"))  # runs that have a character here
                symbol = symbols[at[:held] + t]
                total[:held] += step[state[:held], symbol]
                state[:held] = target[state[:held], symbol]
            total += end[state]
            # a thousandth of a bit for sums in another order than score()'s
            good = (total / (length[:n] + 1) >= cut - 1e-3) & (total - plain[order[:n]] >= EVIDENCE)
            out[order[:n]] |= good
        return out


class Scanner:
    """Finds spans (start, end, kind) in code points, end exclusive. Without a grammar only the base kinds."""

    def __init__(self, grammar: Grammar | None = None):
        self.grammar = grammar

    def spans(self, texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """Spans of each text that has any, in order of start, then kind; kinds as indices into KINDS."""
        out: dict[int, list] = {}
        for begin, end in blocks(texts):
            self._block(texts, begin, end, out)
        return out

    def _block(self, texts: list[bytes], begin: int, end: int, out: dict) -> None:
        part = texts[begin:end]
        joined = b"\n".join(part)
        bounds = [0]
        for t in part:
            bounds.append(bounds[-1] + len(t) + 1)
        found: dict[int, list] = {}
        lowered = joined.lower()
        keyed = set()
        for word in KEYWORDS:
            at = lowered.find(word)
            while at >= 0:
                i = bisect_right(bounds, at) - 1
                keyed.add(i)
                at = lowered.find(word, bounds[i + 1])
        for i in keyed:
            hits = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(part[i].decode("utf-8", "replace")) if len(m[2]) >= LEAST["assign"]]
            if hits:
                found[i] = hits
        data = np.frombuffer(joined, dtype=np.uint8)
        stops = np.concatenate(([-1], np.flatnonzero(~_TOKEN[data]), [len(data)]))
        starts, sizes = stops[:-1] + 1, np.diff(stops) - 1
        for k in np.flatnonzero(sizes >= min(LEAST["access"], LEAST["hex"])).tolist():
            a, b = int(starts[k]), int(starts[k] + sizes[k])
            run = joined[a:b].decode()
            access = [m for m in ACCESS.finditer(run) if len(m[0]) >= LEAST["access"]] if "AKIA" in run else []
            hexes = [m for m in HEX.finditer(run) if len(m[0]) >= LEAST["hex"]]
            if access or hexes:
                i = bisect_right(bounds, a) - 1
                at = len(joined[bounds[i] : a].decode("utf-8", "replace"))
                found.setdefault(i, []).extend([(at + m.start(), at + m.end(), 1) for m in access] + [(at + m.start(), at + m.end(), 2) for m in hexes])
        if self.grammar and self.grammar.cuts:
            full = np.flatnonzero(sizes >= min(least for _, least, *_ in self.grammar.cuts.values()))
            starts, sizes = starts[full], sizes[full]
            stop = data == 46
            while True:  # full stops at either end are punctuation
                front, back = stop[starts] & (sizes > 0), stop[starts + np.maximum(sizes, 1) - 1] & (sizes > 0)
                if not (front | back).any():
                    break
                starts, sizes = starts + front, np.maximum(sizes - front - back, 0)
            for k in np.flatnonzero(self.grammar.accepted(data, starts, sizes)).tolist():
                a, b = int(starts[k]), int(starts[k] + sizes[k])
                i = bisect_right(bounds, a) - 1
                at = len(joined[bounds[i] : a].decode("utf-8", "replace"))
                # what one base span covers adds nothing
                if not any(s <= at and at + b - a <= e for s, e, _ in found.get(i, ())):
                    found.setdefault(i, []).append((at, at + b - a, 3))
        for i, spans in found.items():
            if spans:
                out[begin + i] = sorted(spans, key=lambda s: (s[0], s[2]))


def joined_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def learn(docs: DataFrame, text: str = "text") -> Grammar:
    """An automaton for each base kind from the distinct credentials in all texts, EXAMPLES of each at most, chosen by hash; and byte pairs of all texts.

    Null and empty texts teach nothing; repeated rows teach byte pairs each time and credentials once. Kinds without a credential have no automaton; an empty
    table gives a grammar that accepts nothing. Other columns play no part.
    """

    def run(batches):
        scanner, pairs = Scanner(), np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            kinds, values = [], []
            for i, spans in scanner.spans(texts).items():
                whole = texts[i].decode("utf-8", "replace")
                for s, e, k in spans:
                    m = ASSIGN.match(whole[s:e]) if k == 0 else None
                    kinds.append(KINDS[k])
                    values.append(m[2] if m else whole[s:e])
            for begin, end in blocks(texts):
                data = np.frombuffer(b" ".join(texts[begin:end]), dtype=np.uint8).astype(np.intp)
                pairs += np.bincount(data[:-1] << 8 | data[1:], minlength=1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array([1] * len(kinds), pa.int64())], names=["kind", "value", "n"])
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(at), pa.string()), pa.array(at.astype(str).tolist(), pa.string()), pa.array(pairs[at], pa.int64())], names=["kind", "value", "n"])

    # credentials, and at most 65,536 pairs from a task
    values = written(docs.select(F.col(text)).mapInArrow(lean(run), "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    pairs = np.zeros(1 << 16, dtype=np.int64)
    for r in values.where("kind = 'pair'").collect():
        pairs[int(r.value)] = r.n
    out = {}
    for kind in KINDS[:3]:
        sample = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(EXAMPLES).collect()
        if sample:
            out[kind] = Automaton([r.value for r in sample])
    return Grammar(out, pairs)


def scan(docs: DataFrame, grammar: Grammar | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, numbers of spans of each base kind, the digest of the base spans, all spans as text, and the number of grammar spans.

    A null or empty text has no spans: the digest of the empty string, spans ''. Rows are independent.
    """

    def run(batches):
        scanner = Scanner(grammar)
        for batch in batches:
            found = scanner.spans(as_bytes(batch.column(1)))
            rows = [found.get(i, []) for i in range(batch.num_rows)]
            count = lambda k: pa.array([sum(x[2] == k for x in r) for r in rows], pa.int64())
            base = [hashlib.sha256(joined_spans([x for x in r if x[2] < 3]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array([joined_spans(r) for r in rows], pa.string()), count(3)],
                names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"],
            )

    return docs.select(key, text).mapInArrow(lean(run), f"{key} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long")


def redact(docs: DataFrame, grammar: Grammar | None, text: str = "text", length: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, every span of the text replaced by the mark (overlapping spans by one). Texts without spans are untouched.

    Where a text changes, its number of characters is set anew in the column `length`, if there is one. A null text stays null; repeated rows and rows without
    an id are treated like all others.
    """

    def run(batches):
        scanner = Scanner(grammar)
        for batch in batches:
            at = batch.schema.names.index(text)
            texts = as_bytes(batch.column(at))
            found = scanner.spans(texts)
            if found:
                values = batch.column(at).to_pylist()
                for i, spans in found.items():
                    out, last = [], 0
                    for s, e, _ in spans:
                        if s >= last:
                            out += [values[i][last:s], mark]
                        last = max(last, e)
                    values[i] = "".join(out) + values[i][last:]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
                if length in batch.schema.names:
                    at = batch.schema.names.index(length)
                    sizes = batch.column(at).to_pylist()
                    for i in found:
                        sizes[i] = len(values[i])
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(lean(run), docs.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))
