"""String similarities of many pairs at once, in arrays: what `similarity` defines for one pair.

The longest common subsequence of a pair runs along the longer text with a word of 64 bits whose bits stand for the characters of the shorter one; the words of
all pairs of a batch are one array. All windows of `partial` are columns of the same array, so they share the masks of their pair. Shorter texts of more than
WORD characters are left to `similarity`, one by one. Equal pairs are computed once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np

from . import similarity as S

WORD = 64
#: Numbers in one array of masks or states.
CELLS = 1 << 21


def distinct(a: Sequence[str], b: Sequence[str]) -> tuple[list[tuple[str, str]], np.ndarray]:
    """The distinct pairs, and which of them each pair is."""
    index: dict[tuple[str, str], int] = {}
    at = [index.setdefault(p, len(index)) for p in zip(a, b)]
    return list(index), np.array(at, dtype=np.intp)


def _codes(texts: Sequence[str], width: int) -> np.ndarray:
    """Characters as numbers, a row for each text, filled up with 0."""
    data = np.zeros((len(texts), width), dtype=np.uint32)
    for i, t in enumerate(texts):
        data[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return data


def _masks(short: Sequence[str], long: Sequence[str], size: int, width: int) -> np.ndarray:
    """For each place of the longer texts the bits of the shorter ones' equal characters."""
    both = np.concatenate((_codes(short, size), _codes(long, width)), axis=1)
    values, places = np.unique(both, return_inverse=True)
    places = places.reshape(both.shape)
    if len(values) < 250:
        places = places.astype(np.uint8)
    x, y = places[:, :size], places[:, size:]
    filled = both != 0
    out = np.zeros((len(short), width), dtype=np.uint64)
    for k in range(size):
        hit = (y == x[:, k : k + 1]) & filled[:, size:] & filled[:, k : k + 1]
        out |= hit.astype(np.uint64) << np.uint64(k)
    return out


def _run(state: np.ndarray, masks: np.ndarray, full: np.ndarray) -> np.ndarray:
    hit = state & masks
    return ((state + hit) | (state - hit)) & full


def _parts(rows: list[int], cost: Callable[[int], int]):
    """Runs of rows whose arrays have about CELLS numbers."""
    part: list[int] = []
    held = 0
    for i in rows:
        if part and held + cost(i) > CELLS:
            yield part
            part, held = [], 0
        part.append(i)
        held += cost(i)
    if part:
        yield part


def _lcs(pairs: list[tuple[str, str]]) -> np.ndarray:
    out = np.zeros(len(pairs))
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    usual = []
    for i, (a, b) in enumerate(ordered):
        if a == b:
            out[i] = len(a)
        elif a and len(a) <= WORD:
            usual.append(i)
        elif a:
            out[i] = S.lcs(a, b)
    usual.sort(key=lambda i: (len(ordered[i][0]), len(ordered[i][1])))
    for part in _parts(usual, lambda i: len(ordered[i][1]) + 8):
        short, long = zip(*(ordered[i] for i in part))
        sizes = np.array([len(x) for x in short], dtype=np.uint64)
        masks = _masks(short, long, int(sizes.max()), max(map(len, long)))
        full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(WORD) - sizes)
        state = full.copy()
        for j in range(masks.shape[1]):
            state = _run(state, masks[:, j], full)
        out[part] = sizes - np.bitwise_count(state)
    return out


def _ratio(pairs: list[tuple[str, str]]) -> np.ndarray:
    total = np.array([len(a) + len(b) for a, b in pairs], dtype=np.float64)
    return np.where(total > 0, 200 * _lcs(pairs) / np.maximum(total, 1), 100.0)


def _windows(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Best ratio of the first text, which isn't longer, with a window of the second."""
    out = np.zeros(len(pairs))
    by_size = defaultdict(list)
    for i, (a, b) in enumerate(pairs):
        if not a:
            out[i] = 0.0 if b else 100.0
        elif a in b:
            out[i] = 100.0
        elif len(a) > WORD:
            out[i] = S.partial_ratio(a, b)
        else:
            by_size[len(a)].append(i)
    for m, rows in by_size.items():
        rows.sort(key=lambda i: len(pairs[i][1]))
        full = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(WORD - m)
        for part in _parts(rows, lambda i: len(pairs[i][1]) + 2 * m):  # noqa: B023
            short, long = zip(*(pairs[i] for i in part))
            sizes = np.array([len(x) for x in long])
            width = int(sizes.max())
            masks = np.pad(_masks(short, long, m, width), ((0, 0), (m - 1, m - 1)))
            begin = np.arange(-m + 1, width)
            state = np.full((len(part), len(begin)), full)
            for t in range(m):
                state = _run(state, masks[:, t : t + len(begin)], full)
            length = np.minimum(begin + m, sizes[:, None]) - np.maximum(begin, 0)
            score = np.where(length > 0, 200.0 * (m - np.bitwise_count(state).astype(np.float64)) / (m + np.maximum(length, 0)), 0.0)
            out[part] = score.max(axis=1)
    return out


def _partial(pairs: list[tuple[str, str]]) -> np.ndarray:
    out = _windows([(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs])
    same = [i for i, (a, b) in enumerate(pairs) if len(a) == len(b) and out[i] < 100]
    if same:
        out[same] = np.maximum(out[same], _windows([(pairs[i][1], pairs[i][0]) for i in same]))
    return out


def _sorted(x: str) -> str:
    return " ".join(sorted(x.split()))


def _token_sets(pairs: list[tuple[str, str]]) -> np.ndarray:
    out, full, at = np.zeros(len(pairs)), [], []
    for i, (a, b) in enumerate(pairs):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            continue
        both = x & y
        if both and (len(both) == len(x) or len(both) == len(y)):
            out[i] = 100.0
            continue
        shared, own_x, own_y = " ".join(sorted(both)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
        if shared:
            n = len(shared)
            # the shared words stand in front of either side's own, so all their characters are common
            out[i] = max(200.0 * n / (2 * n + 1 + len(own_x)), 200.0 * n / (2 * n + 1 + len(own_y)))
            own_x, own_y = f"{shared} {own_x}", f"{shared} {own_y}"
        full.append((own_x, own_y))
        at.append(i)
    if full:
        out[at] = np.maximum(out[at], _ratio(full))
    return out


def _over(measure: Callable, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    pairs, at = distinct(a, b)
    return measure(pairs)[at] if pairs else np.zeros(0)


def ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return _over(_ratio, a, b)


def partial_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return _over(_partial, a, b)


def token_sort_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return _over(lambda pairs: ratio(*zip(*((_sorted(x), _sorted(y)) for x, y in pairs))), a, b)


def token_set_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return _over(_token_sets, a, b)


def _weighted(pairs: list[tuple[str, str]]) -> np.ndarray:
    a, b = (np.array([len(p[k]) for p in pairs], dtype=np.float64) for k in (0, 1))
    present = (a > 0) & (b > 0)
    longer = np.maximum(a, b) / np.maximum(np.minimum(a, b), 1)
    out = _ratio(pairs)
    near, far = np.flatnonzero(present & (longer < 1.5)), np.flatnonzero(present & (longer >= 1.5))
    if len(near):
        x, y = zip(*(pairs[i] for i in near))
        out[near] = np.maximum(out[near], 0.95 * np.maximum(token_sort_ratio(x, y), token_set_ratio(x, y)))
    if len(far):
        chosen = [pairs[i] for i in far]
        part = np.where(longer[far] <= 8, 0.9, 0.6)
        tokens = [(set(x.split()), set(y.split())) for x, y in chosen]
        shared = np.array([bool(x & y) for x, y in tokens])
        own = partial_ratio(*zip(*((" ".join(sorted(x - y)), " ".join(sorted(y - x))) for x, y in tokens)))
        by_token = np.where(shared, 100.0, own)
        by_order = partial_ratio(*zip(*((_sorted(x), _sorted(y)) for x, y in chosen)))
        out[far] = np.maximum.reduce([out[far], part * partial_ratio(*zip(*chosen)), 0.95 * part * by_order, 0.95 * part * by_token])
    return np.where(present, out, 0.0)


def weighted_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return _over(_weighted, a, b)


def jaro_winkler(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return _over(lambda pairs: np.array([S.jaro_winkler(x, y) for x, y in pairs]), a, b)


#: The measures of `similarity` that have a form for many pairs.
MANY = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, weighted_ratio, jaro_winkler)}
