"""Queries on sources, tables and answers: reading and writing records and id lists, lookups, statistics and checks of answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import models as M
from ..operators import profile as P
from ..sources import tables, tsv
from . import decision_queries as Q
from . import inputs as I
from .catalogue import ORACLES, query

six = Q.six


def _folder(spark, label: str) -> str:
    """A new path in the shared folder."""
    return f"{tables.shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# --- sources and tables -------------------------------------------------------------------------


@query("read_records", """SELECT 'S1' AS source, 'S1-' || s_suppkey AS entity_id, s_name AS business_name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '"' || s_suppkey || ' Main St' END AS business_address, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'S2', 'S2-' || c_custkey, c_name, c_mktsegment, '' FROM customer UNION ALL SELECT 'S3', 'S3-' || r_regionkey, r_name, '', r_name FROM region""")
def read_records(spark, sf_dir):
    """Three tab-separated sources, written and read by the split loader: quotes are literal, empty fields stay empty."""
    t = lambda n: I.table(spark, sf_dir, n)
    place = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit('"'), F.col("s_suppkey").cast("string"), F.lit(" Main St")))
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = {
        "S1": suppliers.select(F.concat(F.lit("S1-"), F.col("s_suppkey")), "s_name", place, "n_name"),
        "S2": t("customer").select(F.concat(F.lit("S2-"), F.col("c_custkey")), "c_name", "c_mktsegment", F.lit("")),
        "S3": t("region").select(F.concat(F.lit("S3-"), F.col("r_regionkey")), "r_name", F.lit(""), "r_name"),
    }
    paths = {}
    for source, df in rows.items():
        paths[source] = _folder(spark, source)
        tsv.write_records(df.toDF(*tsv.RECORD), paths[source])
    one, others = tsv.read_split(spark, paths)
    return one.unionByName(others)


@query("partitioned_table", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders")
def partitioned_table(spark, sf_dir):
    """A table written by partition, one partition of it replaced; made once, its manifest checked before it is read."""
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path, kept = _folder(spark, "by-priority"), _folder(spark, "manifest")
    tables.write_partitioned(orders, path, "o_orderpriority")
    tables.replace_partitions(orders.where("o_orderpriority = '5-LOW'").withColumn("o_totalprice", -F.col("o_totalprice")), path, "o_orderpriority")
    rows = tables.once(spark, path, lambda: orders)
    tables.write_manifest(rows, kept)
    tables.check_manifest(rows, kept)
    return rows.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("id_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def id_lookup(spark, sf_dir):
    """Names of parts from the dimension; an unknown or repeated key would end the query."""
    part = I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return D.lookup(rows, part, "l_partkey", "p_name").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name")


@query("locality_order", "SELECT p_partkey AS id, lower(p_name) AS core, string_split(lower(p_type), ' ')[-1] AS locality FROM part")
def locality_order(spark, sf_dir):
    """Records in ranges of their last address word and name, for batches of near twins."""
    rows = I.part_records(spark, sf_dir).select("id", "core", "toks")
    return D.by_locality(rows, "toks", "core", 8).select("id", "core", "locality")


@query("missing_rates", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS null_rate, round(avg(CASE WHEN CAST({c} AS VARCHAR) = '' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS empty_rate FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def missing_rates(spark, sf_dir):
    return six(P.missing_rates(I.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")), "null_rate", "empty_rate")


# --- answers ------------------------------------------------------------------------------------


@query("answer_file", ORACLES["build_lists"].replace("SELECT o_orderkey AS s1_id", "SELECT 'S1-' || o_orderkey AS s1_id").split(", count(DISTINCT l_partkey)")[0] + " FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def answer_file(spark, sf_dir):
    """Id lists written in entity order, empty ones too, and read again."""
    lists = Q.build_lists(spark, sf_dir).withColumn("place", F.col("s1_id")).withColumn("s1_id", F.concat(F.lit("S1-"), F.col("s1_id")))
    path = _folder(spark, "answer")
    tsv.write_id_lists(lists, path, order="place")
    return tsv.read_id_lists(spark, path)


@query("list_statistics", "WITH l AS (SELECT o_orderkey, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT count(*) AS n_lists, sum(n)::BIGINT AS n_ids, max(n) AS longest, round(avg(n), 6) AS mean, count(*) FILTER (n = 0) AS n_empty FROM l")
def list_statistics(spark, sf_dir):
    return six(D.list_statistics(Q.build_lists(spark, sf_dir)), "mean")


@query("matches_by_group", f"""WITH {I.SCORED}, {I.BEST}, {Q.SELECTED}, n AS (SELECT s1_id, count(*) AS n FROM selected GROUP BY 1)
SELECT o_orderpriority AS grp, count(*) AS n_entities, count(n) AS n_matched, coalesce(sum(n), 0)::BIGINT AS n_pairs, round(coalesce(sum(n), 0)::DOUBLE / count(*), 6) AS pairs_per_entity FROM orders LEFT JOIN n ON s1_id = o_orderkey GROUP BY 1""")
def matches_by_group(spark, sf_dir):
    return six(D.matches_by_group(_grouped(spark, sf_dir), Q._selected(spark, sf_dir), "grp"), "pairs_per_entity")


def _grouped(spark, sf_dir):
    return I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id"), F.col("o_orderpriority").alias("grp"))


@query("blocking_misses", f"""WITH {I.SCORED}, {I.TRUTH}, found AS (SELECT DISTINCT s1_id, cand_id FROM scored WHERE p >= 0.4)
SELECT o_orderpriority AS grp, count(*) AS n_true, count(*) FILTER (f.s1_id IS NULL) AS n_missed, round(count(*) FILTER (f.s1_id IS NULL)::DOUBLE / count(*), 6) AS miss_rate FROM truth t JOIN orders ON o_orderkey = t.s1_id LEFT JOIN found f ON f.s1_id = t.s1_id AND f.cand_id = t.cand_id GROUP BY 1""")
def blocking_misses(spark, sf_dir):
    found = I.scored(spark, sf_dir).where("p >= 0.4")
    return six(E.misses(I.truth(spark, sf_dir), found, _grouped(spark, sf_dir), "grp"), "miss_rate")


_POLICY = {"1-URGENT": ("a", 0.9), "2-HIGH": ("b", 0.8), "3-MEDIUM": ("a", 0.7), "4-NOT SPECIFIED": ("b", 0.5), "5-LOW": ("a", 0.5)}


def _policy_sql(name: str, table: str, p: str) -> str:
    mine = {g: t for g, (n, t) in _POLICY.items() if n == name}
    cases = " ".join(f"WHEN '{g}' THEN {t}" for g, t in mine.items())
    groups = ", ".join(f"'{g}'" for g in mine)
    return f"SELECT s1_id, cand_id, p FROM (SELECT s.s1_id, cand_id, {p} AS p, o_orderpriority AS g, row_number() OVER (PARTITION BY cand_id ORDER BY round({p}, 9) DESC, s.s1_id) AS n FROM {table} s JOIN orders ON o_orderkey = s.s1_id WHERE o_orderpriority IN ({groups})) WHERE n = 1 AND p >= CASE g {cases} END"


@query("policy_scores", f"WITH {I.SCORED}, {I.OTHER_SCORES} {_policy_sql('a', 'scored', 'p')} UNION ALL {_policy_sql('b', 'rescored', 'p2')}")
def policy_scores(spark, sf_dir):
    """Each group of entities by its own score table and threshold."""
    scores = {"a": I.scored(spark, sf_dir), "b": I.rescored(spark, sf_dir).withColumnRenamed("p2", "p")}
    return D.select_by_scores(scores, _POLICY, _grouped(spark, sf_dir), "grp").select("s1_id", "cand_id", "p")


_CONSTANTS = {"S2": (0.94, 0.75), "S3": (1.07, 0.88)}


@query("true_share", f"SELECT source, n, r, round((CASE source WHEN 'S2' THEN 0.94 ELSE 1.07 END::DOUBLE - r) / (CASE source WHEN 'S2' THEN 0.94::DOUBLE - 0.75::DOUBLE ELSE 1.07::DOUBLE - 0.88::DOUBLE END), 4) AS share FROM ({ORACLES['count_signature']})")
def true_share(spark, sf_dir):
    out = E.true_share(Q.count_signature(spark, sf_dir), _CONSTANTS)
    return out.withColumn("share", F.round("share", 4))


def _expected_sql(power: float, least: float) -> str:
    return Q.EXPECTED_F.replace("least(greatest(p, 1e-6), 1 - 1e-6) AS q", f"pow(least(greatest(p, 1e-6), 1 - 1e-6), {power}) AS q").replace("q >= 0.05", f"q >= {least}").split("SELECT s1_id, cand_id, p FROM scored")[0]


_MODES = {"thr 0.5": None, "thr 0.7": None, "expf 1.0": (1.0, 0.05), "expf 1.2": (1.2, 0.05), "expf 1.0 from 0.3": (1.0, 0.3)}
_ALL = " UNION ALL ".join(f"SELECT '{name}' AS mode, s1_id, cand_id FROM " + (f"({_expected_sql(*spec)})" if spec else f"(WITH {I.SCORED}, {I.BEST} SELECT * FROM best WHERE p >= {name.split()[1]})") for name, spec in _MODES.items())


@query("mode_sweep", f"""WITH {I.TRUTH}, {I.ENTITIES}, chosen AS ({_ALL}), modes AS (SELECT unnest({list(_MODES)}) AS mode),
pred AS (SELECT mode, c.s1_id, count(*) AS n_pred, count(t.cand_id) AS tp FROM chosen c LEFT JOIN truth t ON c.s1_id = t.s1_id AND c.cand_id = t.cand_id GROUP BY ALL),
r AS (SELECT m.mode, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM modes m CROSS JOIN entities e LEFT JOIN pred p ON p.mode = m.mode AND p.s1_id = e.s1_id LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1) t ON t.s1_id = e.s1_id)
SELECT mode, round(avg({Q.F05}), 6) AS f05, sum(n_pred)::BIGINT AS n_selected FROM r GROUP BY 1""")
def mode_sweep(spark, sf_dir):
    """Thresholds and the expected-F rule in several settings."""
    competed = D.compete(I.scored(spark, sf_dir), 2.0)
    modes = {name: D.select_expected_f(competed, spec[1], spec[0]) if spec else D.select_threshold(I.scored(spark, sf_dir), float(name.split()[1])) for name, spec in _MODES.items()}
    return six(E.mode_sweep(modes, I.truth(spark, sf_dir), I.entities(spark, sf_dir)), "f05")


_ANSWER = Q.VALIDATE.replace("SELECT rule, count(*) AS n, min(x) AS example FROM found GROUP BY 1", """, named AS (SELECT rule, x FROM found WHERE rule <> 'unknown ids' UNION ALL SELECT 'unknown ids', x FROM found WHERE rule = 'unknown ids' UNION ALL SELECT 'lines without a tab', n_name FROM nation)
SELECT 'matches' AS file, rule, count(*) AS n, min(x) AS example, 'error' AS severity FROM named GROUP BY ALL UNION ALL SELECT 'answer', 'no candidate file', 1, '', 'warning'""")


@query("validate_answer", _ANSWER)
def validate_answer(spark, sf_dir):
    """A written answer with faults of every kind, and lines without a tab, through the validator's driver."""
    lists, required, known = Q.faulty_lists(spark, sf_dir)
    lines = lists.select(F.concat_ws("\t", "s1_id", "ids").alias("value")).unionByName(I.table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")))
    header = spark.createDataFrame([("source1_entity_id\tmatched_entity_ids",)], "value string")
    path = _folder(spark, "faulty")
    header.unionByName(lines).coalesce(1).write.text(path)
    return E.validate_answer(spark, path, required, known).where("n > 0")


@query("stage2_features", f"WITH {I.SCORED}, kept AS (SELECT * FROM scored WHERE p >= 0.003) SELECT s1_id, cand_id, round(max(p) OVER w, 6) AS s1_max, count(*) FILTER (p >= 0.9) OVER w AS s1_n_hi, c_no_addr, sib_n FROM kept k JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS c_no_addr FROM part) ON p_partkey = cand_id JOIN (SELECT s.s1_id AS a, s.cand_id AS b, count(o.cand_id) AS sib_n FROM scored s LEFT JOIN scored o ON o.s1_id = s.s1_id AND o.cand_id <> s.cand_id AND o.p >= 0.9 GROUP BY ALL) ON a = s1_id AND b = cand_id WINDOW w AS (PARTITION BY s1_id)")
def stage2_features(spark, sf_dir):
    """The base group of second-stage columns, put together by its name; four of them are shown."""
    scored = I.scored(spark, sf_dir)
    rows = M.attach(X.context(scored), X.siblings(scored, I.part_vectors(spark, sf_dir), records=I.part_texts(spark, sf_dir)), "")
    return six(rows.select("s1_id", "cand_id", *M.feature_set([])), "s1_max").select("s1_id", "cand_id", "s1_max", "s1_n_hi", "c_no_addr", "sib_n")
