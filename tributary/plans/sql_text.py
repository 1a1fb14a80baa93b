"""String similarities as DuckDB SQL, for the queries' SQL: the definitions of `functions.similarity` in list functions."""

from __future__ import annotations

import itertools

_count = itertools.count()


def let(value: str, body) -> str:
    """body(name) with value bound to a name of its own."""
    name = f"v{next(_count)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def words(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '')"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: the last of the rows of the usual table, each made from the one before and a character of a."""
    codes = lambda x: f"list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)"
    step = f"lambda row, ch: list_transform(range(1, len(row) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN unicode({b}[k]) = ch[1] THEN coalesce(row[k - 1], 0) + 1 ELSE row[k] END)))"
    zeros = f"list_transform({codes(b)}, lambda z: 0::BIGINT)"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN length({a}) ELSE list_reduce(list_concat([{zeros}], list_transform({codes(a)}, lambda y: [y])), {step})[-1] END"


def ratio(a: str, b: str) -> str:
    return let(a, lambda p: let(b, lambda q: f"CASE WHEN length({p}) + length({q}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({lcs(p, q)}) / (length({p}) + length({q})) END"))


def in_order(text: str) -> str:
    return f"array_to_string(list_sort({words(text)}), ' ')"


def token_sort_ratio(a: str, b: str) -> str:
    return ratio(in_order(a), in_order(b))


def _sides(a: str, b: str, body) -> str:
    """body(x, y, shared, own_x, own_y): distinct words of both, and the shared and the own ones as sorted texts."""
    own = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda t: NOT list_contains({y}, t))), ' ')"
    return let(f"list_distinct({words(a)})", lambda x: let(f"list_distinct({words(b)})", lambda y: let(f"array_to_string(list_sort(list_intersect({x}, {y})), ' ')", lambda s: let(own(x, y), lambda p: let(own(y, x), lambda q: body(x, y, s, p, q))))))


def token_set_ratio(a: str, b: str) -> str:
    def of(x, y, s, p, q):
        full_p, full_q = f"{s} || ' ' || {p}", f"{s} || ' ' || {q}"
        return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE WHEN {s} <> '' AND ({p} = '' OR {q} = '') THEN 100.0::DOUBLE WHEN {s} = '' THEN {ratio(p, q)} ELSE greatest({ratio(full_p, full_q)}, {ratio(s, full_p)}, {ratio(s, full_q)}) END"

    return _sides(a, b, of)


def _windows(p: str, q: str) -> str:
    window = f"substr({q}, greatest(i, 0) + 1, least(i + length({p}), length({q})) - greatest(i, 0))"
    return f"list_max(list_transform(range(1 - length({p}), length({q})), lambda i: {ratio(p, window)}))"


def partial_ratio(a: str, b: str) -> str:
    shorter = lambda x, y: f"CASE WHEN length({x}) <= length({y}) THEN {x} ELSE {y} END"
    of = lambda p, q: f"CASE WHEN {p} = '' THEN CASE WHEN {q} = '' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END WHEN length({p}) = length({q}) THEN greatest({_windows(p, q)}, {_windows(q, p)}) ELSE {_windows(p, q)} END"
    longer = lambda x, y: f"CASE WHEN length({x}) <= length({y}) THEN {y} ELSE {x} END"
    return let(a, lambda x: let(b, lambda y: let(shorter(x, y), lambda p: let(longer(x, y), lambda q: of(p, q)))))


def weighted_ratio(a: str, b: str) -> str:
    longer = f"(greatest(length({a}), length({b}))::DOUBLE / least(length({a}), length({b})))"
    part = f"CASE WHEN {longer} <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END"
    own = _sides(a, b, lambda x, y, s, p, q: f"CASE WHEN {s} <> '' THEN 100.0::DOUBLE ELSE {partial_ratio(p, q)} END")
    near = f"greatest({ratio(a, b)}, 0.95::DOUBLE * {token_sort_ratio(a, b)}, 0.95::DOUBLE * {token_set_ratio(a, b)})"
    far = f"greatest({ratio(a, b)}, ({part}) * {partial_ratio(a, b)}, 0.95::DOUBLE * ({part}) * {partial_ratio(in_order(a), in_order(b))}, 0.95::DOUBLE * ({part}) * {own})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {longer} < 1.5 THEN {near} ELSE {far} END"


def fuzzy_in(token: str, pool: str) -> str:
    """Whether a pool of words has the token, a word like it, or one that begins with it or that it begins with."""
    like = f"(abs(length(u) - length({token})) <= 2 AND {ratio(token, 'u')} >= 80) OR (length({token}) >= 3 AND length(u) >= 3 AND (starts_with(u, {token}) OR starts_with({token}, u)))"
    return f"(list_contains({pool}, {token}) OR len(list_filter({pool}, lambda u: {like})) > 0)"
