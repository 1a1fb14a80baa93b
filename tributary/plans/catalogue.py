"""Named driver queries and the DuckDB SQL that gives the same rows.

Queries that SQL can't express (models, text vectors, native scripts) have no SQL; what holds for them is tested.
"""

from __future__ import annotations

import functools

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Counts and ranks that SQL gives as 64-bit integers.
LONG = """ce_rank s1_id_rank cand_id_rank s1_rank rank_fwd rank_rev rank blk_rank_fwd blk_rank_rev emb_rank_fwd emb_rank_rev
n_len1 n_len2 a_rawlen2 lg_n1 lg_n2""".split()


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def add(fn):
        def run(spark, sf_dir):
            df = fn(spark, sf_dir)
            return df.withColumns({c: df[c].cast("long") for c in df.columns if c in LONG})

        QUERIES[name] = functools.wraps(fn)(run)
        if sql:
            ORACLES[name] = sql
        return fn

    return add


from . import answer_queries, decision_queries, feature_queries, record_queries  # noqa: E402,F401
