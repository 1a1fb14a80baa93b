"""Queries on scored pairs: competition, selection, rules, corrections and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import features as X
from . import inputs as I
from . import sql_text as Q
from .catalogue import query

SCORED, TRUTH, ENTITIES, BEST = I.SCORED, I.TRUTH, I.ENTITIES, I.BEST
COMPETED = "competed AS (SELECT s1_id, cand_id, o / (1 + o + 2.0::DOUBLE * (sum(o) OVER (PARTITION BY cand_id) - o)) AS p FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)) AS o FROM scored))"


_SOME = " WHERE (l_orderkey * 7 + l_partkey) % 2003 <> 0"
FULL_SCORES = "full_scores AS (SELECT l_orderkey AS s1_id, l_partkey AS cand_id, max((CAST(round(l_extendedprice * 100) AS BIGINT) % 9973)::DOUBLE / 9973.0::DOUBLE) AS p2 FROM lineitem WHERE (l_orderkey * 7 + l_partkey) % 2003 <> 0 GROUP BY 1, 2)"


def _full_scores(spark, sf_dir, some=None):
    """Another model's score of all pairs but about one in two thousand, or of those that `some` picks."""
    p = (F.round(F.col("l_extendedprice") * 100).cast("long") % 9973).cast("double") / F.lit(9973.0)
    rows = I.table(spark, sf_dir, "lineitem").where((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 2003 != 0 if some is None else some)
    return rows.groupBy(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("cand_id")).agg(F.max(p).alias("p"))


def six(df, *columns):
    """Rounded to six places for comparison between engines."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("compete", f"WITH {SCORED}, {COMPETED} SELECT s1_id, cand_id, round(p, 6) AS p FROM competed")
def compete(spark, sf_dir):
    return six(D.compete(I.scored(spark, sf_dir), 2.0), "p")


@query("best_owner", f"WITH {SCORED}, {BEST} SELECT * FROM best")
def best_owner(spark, sf_dir):
    return D.best_owner(I.scored(spark, sf_dir))


@query("select_threshold", f"WITH {SCORED}, {BEST} SELECT * FROM best WHERE pow(least(greatest(p, 1e-6), 1 - 1e-6), 1.5) >= 0.7")
def select_threshold(spark, sf_dir):
    return D.select_threshold(I.scored(spark, sf_dir), 0.7, 1.5)


EXPECTED_F = f"""WITH {SCORED}, {COMPETED}, best AS (
  SELECT s1_id, cand_id, p, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY round(p, 9) DESC, s1_id) AS n FROM competed) WHERE n = 1
), ranked AS (
  SELECT *, row_number() OVER w AS k, 1.25::DOUBLE * sum(q) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (0.25::DOUBLE * sum(q) OVER (PARTITION BY s1_id) + row_number() OVER w) AS ef,
    exp(sum(ln(1 - q)) OVER (PARTITION BY s1_id)) AS none
  FROM best WINDOW w AS (PARTITION BY s1_id ORDER BY round(q, 9) DESC, cand_id)
), most AS (SELECT *, max(ef) OVER (PARTITION BY s1_id) AS most FROM ranked
), stop AS (SELECT *, min(CASE WHEN ef >= most - 1e-12 THEN k END) OVER (PARTITION BY s1_id) AS stop FROM most)
SELECT s1_id, cand_id, round(p, 6) AS p FROM stop WHERE most > none AND k <= stop AND q >= 0.05"""


@query("select_expected_f", EXPECTED_F)
def select_expected_f(spark, sf_dir):
    return six(D.select_expected_f(D.compete(I.scored(spark, sf_dir), 2.0), 0.05), "p")


POLICY = {"1-URGENT": 0.9, "2-HIGH": 0.8, "3-MEDIUM": 0.7, "5-LOW": 0.5}


@query("policy_threshold", f"""WITH {SCORED}, {BEST}, policy AS (SELECT unnest({list(POLICY)}) AS grp, unnest({[float(x) for x in POLICY.values()]}::DOUBLE[]) AS threshold)
SELECT o_orderpriority AS grp, s1_id, cand_id, p FROM (SELECT s.*, o_orderpriority, row_number() OVER (PARTITION BY cand_id ORDER BY round(p, 9) DESC, s1_id) AS n FROM scored s JOIN orders ON s1_id = o_orderkey) JOIN policy ON grp = o_orderpriority WHERE n = 1 AND p >= threshold""")
def policy_threshold(spark, sf_dir):
    groups = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id"), F.col("o_orderpriority").alias("grp"))
    policy = spark.createDataFrame(list(POLICY.items()), "grp string, threshold double")
    return D.select_by_policy(I.scored(spark, sf_dir).join(groups, "s1_id"), policy, "grp")


SELECTED = "selected AS (SELECT s1_id, cand_id FROM best WHERE p >= 0.8)"


def _selected(spark, sf_dir, least=0.8):
    return D.best_owner(I.scored(spark, sf_dir)).where(F.col("p") >= least)


@query("fill_empty", f"""WITH {SCORED}, {BEST}, {SELECTED} SELECT s1_id, cand_id FROM (
  SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(p, 9) DESC, cand_id) AS n FROM best WHERE s1_id NOT IN (SELECT s1_id FROM selected)) WHERE n = 1 AND p >= 0.2""")
def fill_empty(spark, sf_dir):
    best = D.best_owner(I.scored(spark, sf_dir))
    return D.fill_empty(best, _selected(spark, sf_dir).select("s1_id", "cand_id"), 0.2)


@query("append_unclaimed", f"""WITH {SCORED}, {BEST}, {SELECTED}, more AS (SELECT s1_id, cand_id FROM scored WHERE p >= 0.75)
SELECT * FROM selected UNION ALL SELECT * FROM more WHERE (s1_id, cand_id) NOT IN (SELECT (s1_id, cand_id) FROM selected) AND cand_id NOT IN (SELECT cand_id FROM selected)""")
def append_unclaimed(spark, sf_dir):
    more = I.scored(spark, sf_dir).where("p >= 0.75")
    return D.append_unclaimed(_selected(spark, sf_dir), more)


@query("cap_per_source", f"""WITH {SCORED}, src AS (SELECT *, CASE WHEN cand_id % 2 = 0 THEN 'S2' ELSE 'S3' END AS source FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id, source ORDER BY round(p, 9) DESC, cand_id) AS n FROM src)
SELECT s1_id, cand_id, p, source FROM ranked WHERE n <= CASE source WHEN 'S2' THEN 1 ELSE 2 END""")
def cap_per_source(spark, sf_dir):
    return D.cap_per_source(I.scored(spark, sf_dir).withColumn("source", _source()), {"S2": 1, "S3": 2})


def _source():
    return F.when(F.col("cand_id") % 2 == 0, "S2").otherwise("S3")


@query("prune_candidates", f"""WITH {SCORED}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(p, 9) DESC, cand_id) AS n FROM scored WHERE p >= 0.002) WHERE n <= 3)
SELECT e.s1_id, coalesce(string_agg(CAST(cand_id AS VARCHAR), ',' ORDER BY round(p, 9) DESC, cand_id), '') AS ids, count(cand_id) AS n_ids FROM (SELECT o_orderkey AS s1_id FROM orders) e LEFT JOIN kept k ON e.s1_id = k.s1_id GROUP BY 1""")
def prune_candidates(spark, sf_dir):
    kept = D.prune(I.scored(spark, sf_dir), 0.002, 3)
    return D.id_lists(I.entities(spark, sf_dir), kept, -F.round("p", 9)).withColumn("n_ids", F.col("n_ids").cast("long"))


@query("unique_claims", f"WITH {SCORED}, high AS (SELECT * FROM scored WHERE p >= 0.95) SELECT * FROM high WHERE cand_id IN (SELECT cand_id FROM high GROUP BY 1 HAVING count(*) = 1)")
def unique_claims(spark, sf_dir):
    return D.unique_claims(I.scored(spark, sf_dir).where("p >= 0.95"))


@query("pseudo_pairs", f"""WITH {SCORED}, {I.OTHER_SCORES}, both_high AS (SELECT s1_id, cand_id, p, p2 FROM scored JOIN rescored USING (s1_id, cand_id) WHERE p >= 0.5 AND p2 >= 0.6)
SELECT * FROM both_high WHERE cand_id IN (SELECT cand_id FROM both_high GROUP BY 1 HAVING count(*) = 1)""")
def pseudo_pairs(spark, sf_dir):
    """Self-training positives: sure in both models, claimed once."""
    both = I.scored(spark, sf_dir).join(I.rescored(spark, sf_dir), ["s1_id", "cand_id"]).where("p >= 0.5 AND p2 >= 0.6")
    return D.unique_claims(both)


@query("hard_negatives", f"""WITH {SCORED}, {TRUTH}, {FULL_SCORES}, ranked AS (SELECT s.s1_id, s.cand_id, row_number() OVER (PARTITION BY s.s1_id ORDER BY round(p, 9) DESC, s.cand_id) AS n, row_number() OVER (PARTITION BY s.s1_id ORDER BY round(p2, 9) DESC NULLS LAST, s.cand_id) AS m FROM scored s LEFT JOIN full_scores r ON s.s1_id = r.s1_id AND s.cand_id = r.cand_id)
SELECT r.s1_id, r.cand_id, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM ranked r LEFT JOIN truth t ON r.s1_id = t.s1_id AND r.cand_id = t.cand_id WHERE {I.sql_role('CAST(r.s1_id AS VARCHAR)')} = 'fit' AND (n <= 2 OR m <= 2 OR t.s1_id IS NOT NULL)""")
def hard_negatives(spark, sf_dir):
    """Training pairs of the entities of role fit: all positives, and the best negatives by either of two measures."""
    from ..functions.normalize import role

    pairs = X.attach_score(I.scored(spark, sf_dir), _full_scores(spark, sf_dir), "ce")
    chosen = D.hard_pairs(pairs, I.truth(spark, sf_dir), ["p", "ce"], 2)
    return chosen.where(role(F.col("s1_id").cast("string")) == "fit").select("s1_id", "cand_id", "label")


@query("exclusive_negatives", f"""WITH {SCORED}, {TRUTH} SELECT s.s1_id, s.cand_id, s.p, t.s1_id AS owner FROM scored s JOIN truth t ON s.cand_id = t.cand_id AND s.s1_id <> t.s1_id WHERE s.p >= 0.9""")
def exclusive_negatives(spark, sf_dir):
    """Pairs of a record with others than its owner."""
    owners = I.truth(spark, sf_dir).select(F.col("s1_id").alias("owner"), "cand_id")
    return I.scored(spark, sf_dir).where("p >= 0.9").join(owners, "cand_id").where("s1_id <> owner").select("s1_id", "cand_id", "p", "owner")


@query("global_topn", f"WITH {SCORED} SELECT * FROM scored ORDER BY round(p, 9) DESC, s1_id, cand_id LIMIT 500")
def global_topn(spark, sf_dir):
    """The 500 hardest pairs: a top-k report."""
    return I.scored(spark, sf_dir).orderBy(F.round("p", 9).desc(), "s1_id", "cand_id").limit(500)


@query("subsample", f"WITH {SCORED} SELECT * FROM scored ORDER BY md5(CAST(s1_id AS VARCHAR) || '|' || CAST(cand_id AS VARCHAR)), s1_id, cand_id LIMIT 1000")
def subsample(spark, sf_dir):
    """A reproducible sample of exactly 1,000 pairs, by hash order: a sampling operator."""
    return I.scored(spark, sf_dir).orderBy(F.md5(F.concat_ws("|", F.col("s1_id").cast("string"), F.col("cand_id").cast("string"))), "s1_id", "cand_id").limit(1000)


@query("label_pairs", f"WITH {SCORED}, {TRUTH} SELECT s.*, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM scored s LEFT JOIN truth t USING (s1_id, cand_id)")
def label_pairs(spark, sf_dir):
    return E.label_pairs(I.scored(spark, sf_dir), I.truth(spark, sf_dir))


@query("attach_score", f"""WITH {SCORED}, {FULL_SCORES}, best AS (SELECT s.s1_id, s.cand_id, s.p, r.p2 AS ce FROM scored s LEFT JOIN full_scores r ON s.s1_id = r.s1_id AND s.cand_id = r.cand_id)
SELECT s1_id, cand_id, p, ce, row_number() OVER (PARTITION BY s1_id ORDER BY round(ce, 9) DESC NULLS LAST, cand_id) AS ce_rank, round(ce - max(ce) OVER (PARTITION BY s1_id), 6) AS ce_gap FROM best""")
def attach_score(spark, sf_dir):
    return six(X.attach_score(I.scored(spark, sf_dir), _full_scores(spark, sf_dir), "ce"), "ce_gap")


@query("overlay_score", f"WITH {SCORED}, {I.OTHER_SCORES} SELECT s1_id, cand_id, coalesce(p2, p) AS p FROM scored LEFT JOIN rescored USING (s1_id, cand_id)")
def overlay_score(spark, sf_dir):
    return D.overlay(I.scored(spark, sf_dir), I.rescored(spark, sf_dir))


@query("blend_scores", f"WITH {SCORED}, {FULL_SCORES.replace(_SOME, '')} SELECT s1_id, cand_id, round((p + p2) / 2, 6) AS p FROM scored JOIN full_scores USING (s1_id, cand_id)")
def blend_scores(spark, sf_dir):
    return six(D.blend(I.scored(spark, sf_dir), _full_scores(spark, sf_dir, F.lit(True))), "p")


def _competition_sql(key: str) -> str:
    return f"""WITH {SCORED}, named AS (SELECT *, abs(p - 0.5) AS q FROM scored), w AS (SELECT *, count(*) OVER k AS n, max(p) OVER k AS m, max(q) OVER k AS mq, rank() OVER (PARTITION BY {key} ORDER BY p DESC) AS r, row_number() OVER (PARTITION BY {key} ORDER BY p DESC) AS i FROM named WINDOW k AS (PARTITION BY {key})),
s AS (SELECT *, max(CASE WHEN i = 2 THEN p END) OVER (PARTITION BY {key}) AS second FROM w)
SELECT s1_id, cand_id, n AS {key}_n, round(p - m, 6) AS {key}_p_gap, round(q - mq, 6) AS {key}_q_gap, r AS {key}_rank, round(CASE WHEN p = m THEN p - coalesce(second, -1000.0::DOUBLE) ELSE p - m END, 6) AS {key}_lead FROM s"""


def _competition(spark, sf_dir, key):
    pairs = I.scored(spark, sf_dir).withColumn("q", F.abs(F.col("p") - 0.5))
    return six(X.competition(pairs, key, {"p": "p", "q": "q"}, "p").drop("p", "q"), f"{key}_p_gap", f"{key}_q_gap", f"{key}_lead")


@query("competition_features_s1", _competition_sql("s1_id"))
def competition_features_s1(spark, sf_dir):
    return _competition(spark, sf_dir, "s1_id")


@query("competition_features_cand", _competition_sql("cand_id"))
def competition_features_cand(spark, sf_dir):
    return _competition(spark, sf_dir, "cand_id")


@query("context_features", f"""WITH {SCORED}, kept AS (SELECT * FROM scored WHERE p >= 0.003)
SELECT s1_id, cand_id, p, round(max(p) OVER w, 6) AS s1_max, round(sum(p) OVER w, 6) AS s1_sum, row_number() OVER (PARTITION BY s1_id ORDER BY round(p, 9) DESC, cand_id) AS s1_rank, round(p - max(p) OVER w, 6) AS p_gap,
 count(*) FILTER (p >= 0.9) OVER w AS s1_n_hi, count(*) FILTER (p >= 0.3) OVER w AS s1_n_mid FROM kept WINDOW w AS (PARTITION BY s1_id)""")
def context_features(spark, sf_dir):
    return six(X.context(I.scored(spark, sf_dir)), "s1_max", "s1_sum", "p_gap")


_SIBLINGS = f"""WITH {SCORED}, numbered AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings), texts AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(p_name) END AS name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS raw FROM part),
r AS (SELECT t.*, embedding AS v FROM texts t JOIN numbered ON i = p_partkey % (SELECT count(*) FROM embeddings)),
met AS (SELECT a.s1_id, a.cand_id, {I.sql_dot('x.v', 'y.v')} / (sqrt({I.sql_dot('x.v', 'x.v')}) * sqrt({I.sql_dot('y.v', 'y.v')}) + 1e-6) AS c, CASE WHEN x.raw <> '' AND y.raw <> '' AND lower(x.raw) = lower(y.raw) THEN 1.0 ELSE 0.0 END::DOUBLE AS ae, CASE WHEN x.name <> '' AND x.name = y.name THEN 1.0 ELSE 0.0 END::DOUBLE AS ne,
 CASE WHEN x.raw <> '' AND y.raw <> '' THEN {Q.token_set_ratio('lower(x.raw)', 'lower(y.raw)')} END AS asim, {Q.token_set_ratio('x.name', 'y.name')} AS nsim
 FROM scored a JOIN scored b ON a.s1_id = b.s1_id AND a.cand_id <> b.cand_id AND b.p >= 0.9 JOIN r x ON x.p_partkey = a.cand_id JOIN r y ON y.p_partkey = b.cand_id),
agg AS (SELECT s1_id, cand_id, count(*) AS n, max(c) AS m, avg(c) AS a, max(ae) AS ae, max(ne) AS ne, max(asim) AS asim, max(nsim) AS nsim FROM met GROUP BY ALL)
SELECT s.s1_id, s.cand_id, CASE WHEN t.raw IS NULL OR t.raw = '' THEN 1.0 ELSE 0.0 END::DOUBLE AS c_no_addr, coalesce(n, 0) AS sib_n, round(m, 6) AS sib_cos_max, round(a, 6) AS sib_cos_mean, round(asim, 6) AS sib_addr_max, round(nsim, 6) AS sib_name_max, ae AS sib_addr_eq, ne AS sib_name_eq
FROM scored s LEFT JOIN agg ON s.s1_id = agg.s1_id AND s.cand_id = agg.cand_id LEFT JOIN texts t ON t.p_partkey = s.cand_id"""


@query("sibling_features", _SIBLINGS)
def sibling_features(spark, sf_dir):
    """Every scored pair against the other sure records of its entity, by vector, name and address."""
    scored = I.scored(spark, sf_dir)
    out = X.siblings(scored, I.part_vectors(spark, sf_dir), records=I.part_texts(spark, sf_dir))
    return six(out, "sib_cos_max", "sib_cos_mean", "sib_addr_max", "sib_name_max")


CORRECTIONS = "log AS (SELECT l_orderkey * 100000 + l_suppkey AS seq, l_orderkey AS s1_id, l_partkey AS cand_id, CASE WHEN l_suppkey % 3 = 0 THEN 'add' ELSE 'remove' END AS action FROM lineitem WHERE l_linenumber = 2)"


def _log(spark, sf_dir):
    """A log with faults: its order is that of orders, then suppliers."""
    rows = I.table(spark, sf_dir, "lineitem").where("l_linenumber = 2")
    return rows.select((F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("seq"), F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("cand_id"), F.when(F.col("l_suppkey") % 3 == 0, "add").otherwise("remove").alias("action"))


def _sound_log(spark, sf_dir, selected):
    """A log without faults: every third record leaves its entity, and half of these go to their true owner."""
    gone = selected.where("cand_id % 3 = 0").select((F.col("cand_id") * 2).alias("seq"), "s1_id", "cand_id", F.lit("remove").alias("action"))
    back = selected.where("cand_id % 6 = 0").select("cand_id").join(I.truth(spark, sf_dir), "cand_id").select((F.col("cand_id") * 2 + 1).alias("seq"), "s1_id", "cand_id", F.lit("add").alias("action"))
    return gone.unionByName(back)


@query("apply_corrections", f"""WITH {SCORED}, {BEST}, {SELECTED}, {TRUTH} SELECT * FROM selected WHERE cand_id % 3 <> 0 UNION ALL SELECT t.s1_id, t.cand_id FROM truth t JOIN selected s ON s.cand_id = t.cand_id WHERE t.cand_id % 6 = 0""")
def apply_corrections(spark, sf_dir):
    selected = _selected(spark, sf_dir).select("s1_id", "cand_id")
    return D.apply_corrections(selected, _sound_log(spark, sf_dir, selected)).select("s1_id", "cand_id")


@query("correction_faults", f"""WITH {SCORED}, {BEST}, {SELECTED}, {CORRECTIONS}, history AS (SELECT -1 AS seq, s1_id, cand_id, 'add' AS action FROM selected UNION ALL SELECT seq, s1_id, cand_id, action FROM log),
state AS (SELECT *, lag(action) OVER w AS last, lag(s1_id) OVER w AS owner FROM history WINDOW w AS (PARTITION BY cand_id ORDER BY seq))
SELECT seq, CASE WHEN action = 'remove' THEN 'remove of a pair that is absent' ELSE 'add of an owned record' END AS fault FROM state
WHERE seq >= 0 AND ((action = 'remove' AND NOT (coalesce(last, '') = 'add' AND owner = s1_id)) OR (action = 'add' AND coalesce(last, '') = 'add'))""")
def correction_faults(spark, sf_dir):
    return D.correction_faults(_selected(spark, sf_dir), _log(spark, sf_dir))


F05 = "CASE WHEN 0.25 * n_true + n_pred > 0 THEN 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) ELSE 1 END"
COUNTS = """counts AS (SELECT e.s1_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp FROM (SELECT DISTINCT s1_id FROM entities) e
 LEFT JOIN (SELECT s.s1_id, count(*) AS n_pred, count(t.cand_id) AS tp FROM selected s LEFT JOIN truth t ON s.s1_id = t.s1_id AND s.cand_id = t.cand_id GROUP BY 1) p ON e.s1_id = p.s1_id
 LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1) t ON e.s1_id = t.s1_id)"""


@query("macro_f05", f"""WITH {SCORED}, {BEST}, {SELECTED}, {TRUTH}, {ENTITIES}, {COUNTS}, f AS (SELECT *, {F05} AS f FROM counts)
SELECT round(avg(f), 6) AS f05, round(avg(CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred END), 6) AS precision_macro, round(avg(CASE WHEN n_true > 0 THEN tp::DOUBLE / n_true END), 6) AS recall_macro,
 round(avg(CASE WHEN n_true = 0 THEN f END), 6) AS f05_singletons, round(avg(CASE WHEN n_true > 0 THEN f END), 6) AS f05_nonsingletons, count(*) AS n_entities,
 round(sum(tp)::DOUBLE / greatest(sum(n_pred), 1), 6) AS micro_precision, round(sum(tp)::DOUBLE / greatest(sum(n_true), 1), 6) AS micro_recall FROM f""")
def macro_f05(spark, sf_dir):
    out = E.macro_f05(_selected(spark, sf_dir), I.truth(spark, sf_dir), I.entities(spark, sf_dir))
    return six(out, *(c for c in out.columns if c != "n_entities"))


@query("blocking_recall", f"""WITH {SCORED}, {TRUTH}, {ENTITIES}, cands AS (SELECT s1_id, cand_id FROM scored WHERE p >= 0.4)
SELECT round((SELECT count(*) FROM truth JOIN cands USING (s1_id, cand_id))::DOUBLE / (SELECT count(*) FROM truth), 6) AS pair_recall, (SELECT count(*) FROM cands) AS pairs, round((SELECT count(*) FROM cands)::DOUBLE / (SELECT count(DISTINCT s1_id) FROM entities), 6) AS pairs_per_s1""")
def blocking_recall(spark, sf_dir):
    candidates = I.scored(spark, sf_dir).where("p >= 0.4")
    return six(E.blocking_recall(candidates, I.truth(spark, sf_dir), I.entities(spark, sf_dir)), "pair_recall", "pairs_per_s1")


OWNERS = f"""owners AS (SELECT p_partkey AS cand_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE t.s1_id END AS owner, CASE WHEN p_partkey % 5 = 0 OR t.s1_id IS NULL THEN 'none' ELSE {I.sql_role('CAST(t.s1_id AS VARCHAR)')} END AS owner_role FROM part LEFT JOIN truth t ON t.cand_id = p_partkey),
valid AS (SELECT o_orderkey AS s1_id FROM orders WHERE {I.sql_role('CAST(o_orderkey AS VARCHAR)')} = 'valid')"""


@query("testlike_f05", f"""WITH {SCORED}, {BEST}, {SELECTED}, {TRUTH}, {OWNERS}, pred AS (SELECT s.s1_id, sum(CASE WHEN o.owner = s.s1_id THEN 1.0::DOUBLE WHEN owner_role = 'valid' THEN 1.0 WHEN coalesce(owner_role, 'none') = 'none' THEN 1.94 ELSE 0.0 END) AS n_pred, sum(CASE WHEN o.owner = s.s1_id THEN 1 ELSE 0 END)::BIGINT AS tp
 FROM selected s JOIN valid USING (s1_id) LEFT JOIN owners o ON o.cand_id = s.cand_id GROUP BY 1), tr AS (SELECT owner AS s1_id, count(*) AS n_true FROM owners WHERE owner IS NOT NULL GROUP BY 1),
r AS (SELECT v.s1_id, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM valid v LEFT JOIN pred ON v.s1_id = pred.s1_id LEFT JOIN tr ON v.s1_id = tr.s1_id)
SELECT round(avg({F05}), 6) AS f05, round(sum(tp) / greatest(sum(n_pred), 1e-9), 6) AS precision, round(sum(tp)::DOUBLE / greatest(sum(n_true), 1), 6) AS recall FROM r""")
def testlike_f05(spark, sf_dir):
    from ..functions.normalize import role

    true = I.truth(spark, sf_dir).withColumnRenamed("s1_id", "owner")
    parts = I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id")).join(true, "cand_id", "left")
    owner = F.when(F.col("cand_id") % 5 != 0, F.col("owner"))
    owners = parts.select("cand_id", owner.alias("owner"), F.when(owner.isNull(), "none").otherwise(role(F.col("owner").cast("string"))).alias("owner_role"))
    valid = I.entities(spark, sf_dir).where(role(F.col("s1_id").cast("string")) == "valid")
    return six(E.weighted_f05(_selected(spark, sf_dir).select("s1_id", "cand_id"), owners, valid), "f05", "precision", "recall")


@query("threshold_sweep", f"""WITH {SCORED}, {BEST}, {TRUTH}, {ENTITIES}, grid AS (SELECT unnest([0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS threshold),
pred AS (SELECT threshold, b.s1_id, count(*) AS n_pred, count(t.cand_id) AS tp FROM best b JOIN grid ON b.p >= threshold LEFT JOIN truth t ON b.s1_id = t.s1_id AND b.cand_id = t.cand_id GROUP BY ALL),
r AS (SELECT g.threshold, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM grid g CROSS JOIN entities e LEFT JOIN pred p ON p.threshold = g.threshold AND p.s1_id = e.s1_id LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1) t ON t.s1_id = e.s1_id)
SELECT threshold, round(avg({F05}), 6) AS f05, sum(n_pred)::BIGINT AS n_selected FROM r GROUP BY 1""")
def threshold_sweep(spark, sf_dir):
    best = D.best_owner(I.scored(spark, sf_dir))
    return six(E.threshold_sweep(best, I.truth(spark, sf_dir), I.entities(spark, sf_dir), [0.3, 0.5, 0.7, 0.9]), "f05")


@query("count_signature", f"""WITH {SCORED}, src AS (SELECT *, CASE WHEN cand_id % 2 = 0 THEN 'S2' ELSE 'S3' END AS source FROM scored WHERE p >= 0.4),
w AS (SELECT source, count(*) OVER (PARTITION BY s1_id, source) - 1 AS same, count(*) OVER (PARTITION BY s1_id) - count(*) OVER (PARTITION BY s1_id, source) AS other FROM src)
SELECT source, count(*) AS n, round(avg(same) / avg(other), 6) AS r FROM w GROUP BY 1""")
def count_signature(spark, sf_dir):
    return six(E.count_signature(I.scored(spark, sf_dir).where("p >= 0.4").withColumn("source", _source())), "r")


VALIDATE = f"""WITH lists AS (SELECT 'S1-' || o_orderkey AS s1_id, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'S2-1,S2-1' WHEN o_orderkey % 13 = 0 THEN 'S1-5' WHEN o_orderkey % 17 = 0 THEN 'X9' ELSE 'S2-' || o_custkey || ',S3-' || (o_custkey + 100) END AS ids FROM orders WHERE o_orderkey % 19 <> 0
 UNION ALL SELECT 'S1-' || o_orderkey, '' FROM orders WHERE o_orderkey % 23 = 0 AND o_orderkey % 19 <> 0 UNION ALL SELECT 'S1-x' || n_nationkey, '' FROM nation),
rows AS (SELECT s1_id, {I.sql_split("replace(ids, ',', ' ')")} AS ids FROM lists), ids AS (SELECT DISTINCT unnest(ids) AS id FROM rows), required AS (SELECT 'S1-' || o_orderkey AS s1_id FROM orders), known AS (SELECT 'S2-' || c_custkey AS id FROM customer),
found AS (SELECT 'duplicate rows' AS rule, s1_id AS x FROM rows GROUP BY s1_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'duplicate ids in a list', s1_id FROM rows WHERE len(ids) <> len(list_distinct(ids))
 UNION ALL SELECT 'ids of source 1', id FROM ids WHERE starts_with(id, 'S1-') UNION ALL SELECT 'ids with a wrong prefix', id FROM ids WHERE NOT starts_with(id, 'S1-') AND NOT starts_with(id, 'S2-') AND NOT starts_with(id, 'S3-')
 UNION ALL SELECT 'unknown ids', id FROM ids WHERE (starts_with(id, 'S2-') OR starts_with(id, 'S3-')) AND id NOT IN (SELECT id FROM known) UNION ALL SELECT 'missing entities', s1_id FROM required WHERE s1_id NOT IN (SELECT s1_id FROM rows)
 UNION ALL SELECT DISTINCT 'extra entities', s1_id FROM rows WHERE s1_id NOT IN (SELECT s1_id FROM required))
SELECT rule, count(*) AS n, min(x) AS example FROM found GROUP BY 1"""


def faulty_lists(spark, sf_dir):
    """Id lists with faults of every kind put in on purpose, the entities that need one, and the known ids."""
    orders = I.table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ids = F.when(key % 11 == 0, "").when(key % 7 == 0, "S2-1,S2-1").when(key % 13 == 0, "S1-5").when(key % 17 == 0, "X9").otherwise(F.concat(F.lit("S2-"), cust, F.lit(",S3-"), cust + 100))
    name = F.concat(F.lit("S1-"), key)
    lists = orders.where(key % 19 != 0).select(name.alias("s1_id"), ids.alias("ids"))
    lists = lists.unionByName(orders.where((key % 23 == 0) & (key % 19 != 0)).select(name.alias("s1_id"), F.lit("").alias("ids")))
    lists = lists.unionByName(I.table(spark, sf_dir, "nation").select(F.concat(F.lit("S1-x"), F.col("n_nationkey")).alias("s1_id"), F.lit("").alias("ids")))
    known = I.table(spark, sf_dir, "customer").select(F.concat(F.lit("S2-"), F.col("c_custkey")).alias("cand_id"))
    return lists, orders.select(name.alias("s1_id")), known


@query("validate_output", VALIDATE)
def validate_output(spark, sf_dir):
    return E.validate(*faulty_lists(spark, sf_dir))


@query("matches_in_candidates", f"WITH {SCORED}, {BEST}, {SELECTED} SELECT * FROM selected WHERE (s1_id, cand_id) NOT IN (SELECT (s1_id, cand_id) FROM scored WHERE p < 0.95)")
def matches_in_candidates(spark, sf_dir):
    return E.not_contained(_selected(spark, sf_dir), I.scored(spark, sf_dir).where("p < 0.95"))


@query("build_lists", """SELECT o_orderkey AS s1_id, coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'R'), '') AS ids, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS n_ids
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def build_lists(spark, sf_dir):
    pairs = I.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").cast("string").alias("cand_id"))
    return D.id_lists(I.entities(spark, sf_dir), pairs).withColumn("n_ids", F.col("n_ids").cast("long"))


@query("explode_lists", "SELECT DISTINCT l_orderkey AS s1_id, CAST(l_partkey AS VARCHAR) AS cand_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def explode_lists(spark, sf_dir):
    return D.explode_lists(build_lists(spark, sf_dir))


@query("replace_partition", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def replace_partition(spark, sf_dir):
    base = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return D.replace_groups(base, base.withColumn("o_totalprice", F.col("o_totalprice") * 2), "o_orderpriority", ["1-URGENT", "5-LOW"])


_ASSEMBLE = f"""WITH {SCORED}, {COMPETED}, {TRUTH}, best AS (SELECT s1_id, cand_id, p FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY round(p, 9) DESC, s1_id) AS n FROM competed) WHERE n = 1),
chosen AS (SELECT s1_id, cand_id FROM best WHERE p >= 0.5), filled AS (SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(p, 9) DESC, cand_id) AS n FROM best WHERE s1_id NOT IN (SELECT s1_id FROM chosen)) WHERE n = 1 AND p >= 0.2),
selected AS (SELECT * FROM chosen UNION ALL SELECT * FROM filled WHERE cand_id NOT IN (SELECT cand_id FROM chosen)), corrected AS (SELECT * FROM selected WHERE cand_id % 3 <> 0 UNION ALL SELECT t.s1_id, t.cand_id FROM truth t JOIN selected s ON s.cand_id = t.cand_id WHERE t.cand_id % 6 = 0),
capped AS (SELECT * FROM (SELECT c.s1_id, c.cand_id, row_number() OVER (PARTITION BY c.s1_id, c.cand_id % 2 ORDER BY round(coalesce(p, 1), 9) DESC, c.cand_id) AS n FROM corrected c LEFT JOIN competed k ON c.s1_id = k.s1_id AND c.cand_id = k.cand_id) WHERE n <= CASE WHEN cand_id % 2 = 0 THEN 5 ELSE 6 END)
SELECT o_orderkey AS s1_id, coalesce(string_agg(CAST(cand_id AS VARCHAR), ',' ORDER BY cand_id), '') AS ids, count(cand_id)::INT AS n_ids FROM orders LEFT JOIN capped ON s1_id = o_orderkey GROUP BY 1"""


@query("assemble", _ASSEMBLE)
def assemble(spark, sf_dir):
    """The whole chain: compete, threshold, first match, unclaimed additions, corrections, caps, id lists."""
    competed = D.compete(I.scored(spark, sf_dir), 2.0)
    best = D.best_owner(competed)
    chosen = best.where("p >= 0.5").select("s1_id", "cand_id")
    chosen = D.append_unclaimed(chosen, D.fill_empty(best, chosen, 0.2))
    chosen = D.apply_corrections(chosen, _sound_log(spark, sf_dir, chosen)).select("s1_id", "cand_id")
    capped = D.cap_per_source(chosen.join(competed, ["s1_id", "cand_id"], "left").withColumn("source", _source()), {"S2": 5, "S3": 6})
    return D.id_lists(I.entities(spark, sf_dir), capped)
