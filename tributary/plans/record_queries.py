"""Queries on records and texts: normalising, tokens, retrieval, vectors, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import tables as T
from ..functions import translit
from ..operators import blocking as B
from ..operators import decide as D
from ..operators import profile as P
from ..sources.tables import materialised
from . import inputs as I
from .catalogue import query
from .decision_queries import six

LEET_SQL = "CASE WHEN NOT regexp_full_match(t, '(\\p{L}+|\\p{Nd}+)') AND length(regexp_replace(t, '[^\\p{L}]', '', 'g')) >= 2 AND length(regexp_replace(t, '[^\\p{L}]', '', 'g')) >= length(t) - 2 THEN translate(t, '0134578', 'oleastb') ELSE t END"


def canon_sql(values: dict[str, str], token: str = "t") -> str:
    return f"coalesce({I.sql_map(values)}[{token}], {token})"


@query("tok_normalize", f"""WITH toks AS (SELECT doc_id, list_transform({I.sql_words(I.sql_strip("lower(text)"))}, lambda t: {LEET_SQL}) AS w FROM documents),
canon AS (SELECT doc_id, list_transform(w, lambda t: {canon_sql(T.LEGAL_CANON)}) AS w FROM toks)
SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5, array_to_string(list_transform(flatten(list_transform(w, lambda t: regexp_extract_all(t, '[0-9]+'))), lambda n: regexp_replace(n, '^0+([0-9])', '\\1')), ' ') AS nums FROM canon""")
def tok_normalize(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    tokens = F.transform(F.transform(N.word_tokens(N.basic_clean(F.col("text"))), N.fix_leet), lambda t: N.canonical(t, T.LEGAL_CANON))
    out = N.let(tokens, lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("tokens_md5"), F.array_join(N.numbers(w), " ").alias("nums")))
    return docs.select("doc_id", out.alias("o")).select("doc_id", "o.*")


@query("typed_tokens", f"""WITH {I.PART_RECORDS}, tagged AS (SELECT id, list_concat(list_transform({I.sql_split("core || ' ' || alt")}, lambda t: 'n:' || t),
 list_transform(list_filter({I.sql_split("core || ' ' || alt")}, lambda t: length(t) >= 4), lambda t: 'p:' || substr(t, 1, 4)), CASE WHEN length(concat) >= 5 THEN ['c:' || substr(concat, 1, 7)] ELSE [] END,
 CASE WHEN concat <> '' THEN ['k:' || concat] ELSE [] END, list_transform({I.sql_split('toks')}, lambda t: 'a:' || t), list_transform({I.sql_split('nums')}, lambda t: '#:' || t)) AS tokens FROM parts)
SELECT id, array_to_string(list_sort(list_distinct(tokens)), ' ') AS tokens FROM tagged""")
def typed_tokens(spark, sf_dir):
    tokens = N.typed_tokens(*(F.col(c) for c in ("core", "concat", "alt", "toks", "nums")))
    return I.part_records(spark, sf_dir).select("id", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


def _junk_sql(text: str) -> str:
    for pattern, by in T.NAME_JUNK:
        text = f"regexp_replace({text}, {I.quote(pattern)}, {I.quote(by)}, 'g')"
    return text


def _name_tokens_sql(text: str) -> str:
    words = I.sql_split(f"translate(regexp_replace({_junk_sql(text)}, '[^\\p{{L}}\\p{{N}}_ऀ-ൿ]+', ' ', 'g'), '_', ' ')")
    return f"list_transform({words}, lambda t: {canon_sql(T.LEGAL_CANON, '(' + LEET_SQL + ')')})"


_NOT_STOP = f"lambda t: NOT list_contains({I.sql_list(T.NAME_STOP)}, t)"


@query("name_struct", f"""WITH raw AS (SELECT p_partkey AS id, lower({I.RAW_NAME}) AS s FROM part), parts AS (SELECT id, s, string_split_regex(' ' || s || ' ', {I.quote(T.OTHER_NAME)}) AS p FROM raw),
toks AS (SELECT id, len(p) AS n, {_name_tokens_sql('s')} AS t, list_filter({_name_tokens_sql('p[1]')}, {_NOT_STOP}) AS a, list_filter({_name_tokens_sql('p[-1]')}, {_NOT_STOP}) AS z FROM parts),
core AS (SELECT *, CASE WHEN n > 1 AND len(a) > 0 THEN a WHEN len(list_filter(t, {_NOT_STOP})) > 0 THEN list_filter(t, {_NOT_STOP}) ELSE t END AS c FROM toks)
SELECT id, array_to_string(t, ' ') AS name, array_to_string(c, ' ') AS core, array_to_string(c, '') AS concat, CASE WHEN n > 1 THEN array_to_string(z, ' ') ELSE '' END AS alt FROM core""")
def name_struct(spark, sf_dir):
    raw = I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(I.RAW_NAME.replace("VARCHAR", "STRING")).alias("raw"))
    return raw.select("id", N.norm_name(F.col("raw")).alias("n")).select("id", "n.*")


_STATE_RE = I.quote(rf"\b({N.STATE_PATTERN})\b")
_ADDRESS_SQL = f"""WITH raw AS (SELECT c_custkey AS id, trim(regexp_replace(lower({I.RAW_ADDRESS}), '[^\\p{{L}}\\p{{N}}ऀ-ൿ]+', ' ', 'g')) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
parts AS (SELECT id, string_split(regexp_replace(s, {_STATE_RE}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM raw),
named AS (SELECT id, CASE WHEN len(p) > 1 THEN {I.sql_map(T.STATES)}[p[(len(p) // 2) * 2]] ELSE '' END AS named, array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN ' st8_' || {I.sql_map(T.STATES)}[x] || ' ' ELSE x END), '') AS s FROM parts),
toks AS (SELECT id, named, list_transform({I.sql_split('s')}, lambda t: CASE WHEN starts_with(t, 'st8_') THEN t ELSE {canon_sql(T.ADDRESS_CANON)} END) AS toks FROM named),
st AS (SELECT *, CASE WHEN named <> '' THEN named ELSE coalesce(list_filter(list_reverse(toks)[1:3], lambda t: length(t) = 2 AND list_contains({I.sql_list(N.STATE_CODES)}, t))[1], '') END AS state, list_filter(toks, lambda t: NOT starts_with(t, 'st8_')) AS plain FROM toks),
words AS (SELECT *, list_transform(list_filter(plain, lambda t: NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains({I.sql_list(T.ADDRESS_STOP)}, t)), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+(st|nd|rd|th)') THEN t ELSE regexp_replace(t, '[0-9]+', '', 'g') END) AS w FROM st)
SELECT id, array_to_string(toks, ' ') AS addr, array_to_string(list_filter(w, lambda t: length(t) >= 2 AND NOT list_contains({I.sql_list(T.ADDRESS_STOP)}, t) AND t <> state), ' ') AS toks,
 array_to_string(list_transform(flatten(list_transform(plain, lambda t: regexp_extract_all(t, '[0-9]+'))), lambda n: regexp_replace(n, '^0+([0-9])', '\\1')), ' ') AS nums, state FROM words"""


@query("addr_struct", _ADDRESS_SQL)
def addr_struct(spark, sf_dir):
    rows = I.table(spark, sf_dir, "customer").join(I.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), N.norm_address(F.expr(I.RAW_ADDRESS.replace("VARCHAR", "STRING"))).alias("a")).select("id", "a.*")


@query("department_regions", f"""WITH raw AS (SELECT n_nationkey AS id, n_name || ', Nord,Paris, Haute-Vienne ,Loire Atlantique' || CASE WHEN n_nationkey % 2 = 0 THEN ',Gironde' ELSE '' END AS s FROM nation)
SELECT id, array_to_string(list_transform(string_split(s, ','), lambda p: coalesce(' ' || {I.sql_map(T.DEPARTMENTS)}[trim(regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))], p)), ',') AS address FROM raw""")
def department_regions(spark, sf_dir):
    raw = F.concat(F.col("n_name"), F.lit(", Nord,Paris, Haute-Vienne ,Loire Atlantique"), F.when(F.col("n_nationkey") % 2 == 0, ",Gironde").otherwise(""))
    return I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), N.departments(raw).alias("address"))


@query("role_split", f"SELECT doc_id, {I.sql_role('CAST(doc_id AS VARCHAR)')} AS role, CASE WHEN source LIKE 'src1%' THEN 1 ELSE 0 END AS is_s3 FROM documents")
def role_split(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", N.role(F.col("doc_id").cast("string")).alias("role"), F.col("source").startswith("src1").cast("int").alias("is_s3"))


@query("ghost_removal", f"SELECT doc_id, lang FROM documents WHERE {I.sql_role('CAST(doc_id AS VARCHAR)')} <> 'ghost' AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 0)")
def ghost_removal(spark, sf_dir):
    owned = I.table(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("doc_id"))
    return I.table(spark, sf_dir, "documents").select("doc_id", "lang").where(N.role(F.col("doc_id").cast("string")) != "ghost").join(owned, "doc_id", "left_anti")


@query("strip_accents", f"SELECT doc_id, md5({I.sql_strip('lower(text)')}) AS plain_md5, length({I.sql_strip('lower(text)')}) AS n FROM documents")
def strip_accents(spark, sf_dir):
    plain = N.strip_accents(F.lower("text"))
    return I.table(spark, sf_dir, "documents").select("doc_id", F.md5(plain).alias("plain_md5"), F.length(plain).cast("long").alias("n"))


@query("record_text", """SELECT p_partkey AS id, lower(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' ' || lower(p_brand) ELSE '' END || ' | ' || lower(p_type) AS embed_text,
 CASE WHEN p_partkey % 4 = 0 THEN 'no name' ELSE lower(p_name) END || ' | ' || CASE WHEN p_partkey % 5 = 0 THEN 'no address' ELSE lower(p_type) END AS pair_text FROM part""")
def record_text(spark, sf_dir):
    key = F.col("p_partkey")
    alt = F.when(key % 3 == 0, F.lower("p_brand")).otherwise("")
    name, addr = F.when(key % 4 == 0, "").otherwise(F.lower("p_name")), F.when(key % 5 == 0, "").otherwise(F.lower("p_type"))
    return I.table(spark, sf_dir, "part").select(key.alias("id"), N.embed_text(F.lower("p_name"), alt, F.lower("p_type")).alias("embed_text"), N.pair_text(name, addr).alias("pair_text"))


# --- retrieval ----------------------------------------------------------------------------------


@query("df_table", f"WITH {I.DOC_TOKENS} SELECT part, token, count(*) AS df FROM doc_tokens GROUP BY ALL")
def df_table(spark, sf_dir):
    return B.token_frequency(*I.document_sides(spark, sf_dir))


@query("idf_capped", f"WITH {I.TOKEN_WEIGHTS} SELECT part, id, side, token, round(weight, 6) AS weight FROM weights")
def idf_capped(spark, sf_dir):
    a, b = B.token_weights(*I.document_sides(spark, sf_dir), I.MAX_DF)
    return six(a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2))), "weight")


def _ranked_sql(key: str, other: str, k: int, name: str) -> str:
    return f"SELECT id_1, id_2, score, n - 1 AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, {other}) AS n FROM pairs) WHERE n <= {k}"


_FWD, _REV = _ranked_sql("id_1", "id_2", I.FORWARD, "rank_fwd"), _ranked_sql("id_2", "id_1", I.REVERSE, "rank_rev")


def _bags(spark, sf_dir, max_df=None):
    """Weighted token bags of all documents, tokenised once and written, since both directions read them."""
    records = materialised(I.document_records(spark, sf_dir), "token-records")
    return materialised(B.token_bags(records, max_df or I.MAX_DF), "token-bags")


def _forward(bags, rank="rank_fwd"):
    return B.nearest_tokens(bags, I.FORWARD, rank=rank)


def _reverse(bags, rank="rank_rev"):
    return B.nearest_tokens(bags, I.REVERSE, left=2, rank=rank).select(F.col("id_2").alias("id_1"), F.col("id_1").alias("id_2"), "score", rank)


def _both(bags):
    f, r = _forward(bags), _reverse(bags).withColumnRenamed("score", "score_r")
    missing = F.lit(B.NOT_FOUND)
    return f.join(r, ["id_1", "id_2"], "full_outer").select("id_1", "id_2", F.coalesce("score", "score_r").alias("score"), F.coalesce("rank_fwd", missing).alias("rank_fwd"), F.coalesce("rank_rev", missing).alias("rank_rev"))


@query("token_block_fwd", f"WITH {I.TOKEN_PAIRS} SELECT id_1, id_2, round(score, 6) AS score, rank_fwd FROM ({_FWD})")
def token_block_fwd(spark, sf_dir):
    return six(_forward(_bags(spark, sf_dir)), "score")


@query("token_block_rev", f"WITH {I.TOKEN_PAIRS} SELECT id_1, id_2, round(score, 6) AS score, rank_rev FROM ({_REV})")
def token_block_rev(spark, sf_dir):
    return six(_reverse(_bags(spark, sf_dir)), "score")


@query("partitioned_block", f"""WITH {I.TOKEN_PAIRS}, f AS ({_FWD}), r AS ({_REV})
SELECT id_1, id_2, round(coalesce(f.score, r.score), 6) AS score, coalesce(rank_fwd, 99) AS rank_fwd, coalesce(rank_rev, 99) AS rank_rev FROM f FULL JOIN r USING (id_1, id_2)""")
def partitioned_block(spark, sf_dir):
    return six(_both(_bags(spark, sf_dir)), "score")


_NEAR = f"{I.VECTORS}, pairs AS (SELECT a.id AS id_1, b.id AS id_2, round({I.sql_dot('a.embedding', 'b.embedding')}, 9) AS score FROM vectors a JOIN vectors b ON a.part = b.part AND a.ghost AND NOT b.ghost)"
_VF, _VR = _ranked_sql("id_1", "id_2", 20, "rank_fwd"), _ranked_sql("id_2", "id_1", 5, "rank_rev")


@query("vector_knn_fwd", f"WITH {_NEAR} SELECT id_1, id_2, round(score, 6) AS score, rank_fwd FROM ({_VF})")
def vector_knn_fwd(spark, sf_dir):
    return six(B.nearest(*I.vector_sides(spark, sf_dir), 20, rank="rank_fwd"), "score")


@query("vector_knn_rev", f"WITH {_NEAR} SELECT id_1, id_2, round(score, 6) AS score, rank_rev FROM ({_VR})")
def vector_knn_rev(spark, sf_dir):
    a, b = I.vector_sides(spark, sf_dir)
    found = B.nearest(b, a, 5, rank="rank_rev")
    return six(found.select(F.col("id_2").alias("id_1"), F.col("id_1").alias("id_2"), "score", "rank_rev"), "score")


@query("vector_union", f"WITH {_NEAR}, f AS ({_VF}), r AS ({_VR}) SELECT id_1, id_2, round(coalesce(f.score, r.score), 6) AS score, coalesce(rank_fwd, 99) AS rank_fwd, coalesce(rank_rev, 99) AS rank_rev FROM f FULL JOIN r USING (id_1, id_2)")
def vector_union(spark, sf_dir):
    return six(B.nearest_both(*I.vector_sides(spark, sf_dir), 20, 5), "score")


@query("self_knn", f"WITH {I.VECTORS}, pairs AS (SELECT a.id AS id_1, b.id AS id_2, round({I.sql_dot('a.embedding', 'b.embedding')}, 9) AS score FROM vectors a JOIN vectors b ON a.part = b.part AND a.id <> b.id) SELECT id_1, id_2, round(score, 6) AS score, rank FROM ({_ranked_sql('id_1', 'id_2', 3, 'rank')})")
def self_knn(spark, sf_dir):
    rows = I.table(spark, sf_dir, "embeddings").select(F.col("label").alias("part"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return six(B.nearest(rows, rows, 3), "score")


@query("block_union", f"""WITH {I.TOKEN_PAIRS}, tf AS ({_FWD}), tr AS ({_REV}), a AS (SELECT id_1, id_2, coalesce(tf.score, tr.score) AS score, coalesce(rank_fwd, 99) AS rank_fwd, coalesce(rank_rev, 99) AS rank_rev FROM tf FULL JOIN tr USING (id_1, id_2)),
vectors AS (SELECT vec_id AS id, label AS part, embedding, {I.sql_role('CAST(vec_id AS VARCHAR)')} = 'ghost' AS ghost FROM embeddings), vpairs AS (SELECT a.id AS id_1, b.id AS id_2, round({I.sql_dot('a.embedding', 'b.embedding')}, 9) AS score FROM vectors a JOIN vectors b ON a.part = b.part AND a.ghost AND NOT b.ghost),
vf AS ({_VF.replace('FROM pairs)', 'FROM vpairs)')}), vr AS ({_VR.replace('FROM pairs)', 'FROM vpairs)')}), b AS (SELECT id_1, id_2, coalesce(vf.score, vr.score) AS score, coalesce(rank_fwd, 99) AS rank_fwd, coalesce(rank_rev, 99) AS rank_rev FROM vf FULL JOIN vr USING (id_1, id_2))
SELECT coalesce(a.id_1, b.id_1) AS id_1, coalesce(a.id_2, b.id_2) AS id_2, round(coalesce(a.score, 0), 6) AS blk_score, coalesce(a.rank_fwd, 99) AS blk_rank_fwd, coalesce(a.rank_rev, 99) AS blk_rank_rev, CASE WHEN a.id_1 IS NULL THEN 0 ELSE 1 END AS found_blk,
 round(coalesce(b.score, 0), 6) AS emb_score, coalesce(b.rank_fwd, 99) AS emb_rank_fwd, coalesce(b.rank_rev, 99) AS emb_rank_rev, CASE WHEN b.id_1 IS NULL THEN 0 ELSE 1 END AS found_emb FROM a FULL JOIN b ON a.id_1 = b.id_1 AND a.id_2 = b.id_2""")
def block_union(spark, sf_dir):
    return six(B.union_passes(_both(_bags(spark, sf_dir)), B.nearest_both(*I.vector_sides(spark, sf_dir), 20, 5)), "blk_score", "emb_score")


_LINK_SQL = f"""WITH {I.TOKEN_PAIRS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_1 ORDER BY round(score, 9) DESC, id_2) AS n FROM pairs) WHERE n <= {I.FORWARD}),
own AS (SELECT * FROM (SELECT id_1, id_2, score, row_number() OVER (PARTITION BY id_2 ORDER BY round(score, 9) DESC, id_1) AS o FROM best) WHERE o = 1 AND round(score, 9) >= 0.5), left_side AS (SELECT doc_id AS s1_id FROM documents WHERE {I.sql_role('CAST(doc_id AS VARCHAR)')} = 'ghost')
SELECT s1_id, coalesce(string_agg(CAST(id_2 AS VARCHAR), ',' ORDER BY id_2), '') AS ids, count(id_2) AS n_ids FROM left_side LEFT JOIN own ON s1_id = id_1 GROUP BY 1"""


@query("link_documents", _LINK_SQL)
def link_documents(spark, sf_dir):
    """Flagship: normalise, cut into tokens, retrieve by rare tokens, best owner, threshold, id lists."""
    return _linked(spark, sf_dir, _forward(_bags(spark, sf_dir), "rank"))


@query("link_documents_whole")
def link_documents_whole(spark, sf_dir):
    """link_documents in both directions; documents whose words are all above the cap meet by equal texts."""
    return _linked(spark, sf_dir, whole_pairs(spark, sf_dir))


def whole_pairs(spark, sf_dir, max_df=None):
    """(id_1, id_2, score): the best candidates of each document in both directions, by tokens, and by equal texts where no token is below the cap."""
    bags = _bags(spark, sf_dir, max_df)
    one, two = I.texts_without(spark, sf_dir, bags)
    forward = _forward(bags, "rank").unionByName(B.equal_texts(one, two, I.FORWARD))
    reverse = B.nearest_tokens(bags, I.REVERSE, left=2).unionByName(B.equal_texts(two, one, I.REVERSE))
    pairs = forward.select("id_1", "id_2", "score").unionAll(reverse.select("id_2", "id_1", "score"))
    return pairs.groupBy("id_1", "id_2").agg(F.max("score").alias("score"))


def _linked(spark, sf_dir, pairs):
    scored = pairs.select(F.col("id_1").alias("s1_id"), F.col("id_2").alias("cand_id"), F.col("score").alias("p"))
    chosen = D.best_owner(scored).where(F.round("p", 9) >= 0.5)
    sides = I.table(spark, sf_dir, "documents").where(N.role(F.col("doc_id").cast("string")) == "ghost").select(F.col("doc_id").alias("s1_id"))
    return D.id_lists(sides, chosen).withColumn("n_ids", F.col("n_ids").cast("long"))


@query("exact_dup_groups", "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("containment_pairs", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def containment_pairs(spark, sf_dir):
    """Items whose text stands word for word in a document: documents and items meet by four words from inside the item, then texts are compared."""
    items = I.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    return P.contained(docs, items)


@query("blocking_report", f"""WITH {I.TOKEN_PAIRS}, f AS ({_FWD}), dup AS (SELECT a.doc_id AS id_1, b.doc_id AS id_2 FROM documents a JOIN documents b ON a.text = b.text AND a.lang = b.lang AND {I.sql_role('CAST(a.doc_id AS VARCHAR)')} = 'ghost' AND {I.sql_role('CAST(b.doc_id AS VARCHAR)')} <> 'ghost')
SELECT k, round(count(DISTINCT (dup.id_1, dup.id_2)) FILTER (f.id_1 IS NOT NULL)::DOUBLE / greatest(count(DISTINCT (dup.id_1, dup.id_2)), 1), 6) AS recall FROM (SELECT unnest([1, 5, 30]) AS k) CROSS JOIN dup LEFT JOIN f ON f.id_1 = dup.id_1 AND f.id_2 = dup.id_2 AND f.rank_fwd < k GROUP BY 1""")
def blocking_report(spark, sf_dir):
    """Recall of equal texts by how many candidates are kept."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("m"), N.role(F.col("doc_id").cast("string")).alias("role"))
    a, b = docs.where("role = 'ghost'").select(F.col("doc_id").alias("id_1"), "lang", "m"), docs.where("role <> 'ghost'").select(F.col("doc_id").alias("id_2"), "lang", "m")
    same = a.join(b, ["lang", "m"]).select("id_1", "id_2")
    found = _forward(_bags(spark, sf_dir), "rank")
    ranked = same.join(found.select("id_1", "id_2", "rank"), ["id_1", "id_2"], "left")
    grid = F.explode(F.array(F.lit(1), F.lit(5), F.lit(30)))
    return ranked.select(grid.alias("k"), "rank").groupBy("k").agg(F.round(F.count_if(F.col("rank") < F.col("k")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("recall"))


# --- sources and profiles -----------------------------------------------------------------------


@query("scan_split", "SELECT s_suppkey AS id, s_name AS name, 'S2' AS source FROM supplier UNION ALL SELECT c_custkey, c_name, 'S3' FROM customer WHERE c_acctbal > 0")
def scan_split(spark, sf_dir):
    two = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("S2").alias("source"))
    three = I.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("S3").alias("source"))
    return two.unionByName(three)


@query("union_sources", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION SELECT r_regionkey, r_name FROM region UNION SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def union_sources(spark, sf_dir):
    nation = I.table(spark, sf_dir, "nation")
    both = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(I.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    return both.unionByName(nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).distinct()


@query("profile_source", "SELECT lang, source, count(*) AS n, count(*) FILTER (text = '') AS n_empty, round(avg(length(text)), 6) AS mean_chars, max(length(text)) AS max_chars, count(DISTINCT md5(text)) AS n_texts FROM documents GROUP BY ALL")
def profile_source(spark, sf_dir):
    return P.profile_texts(I.table(spark, sf_dir, "documents"), ["lang", "source"])


@query("profile_matches", "WITH n AS (SELECT o_orderkey, count(l_orderkey) AS matches FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT matches, count(*) AS n FROM n GROUP BY 1")
def profile_matches(spark, sf_dir):
    return P.matches_histogram(I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id")), I.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s1_id")))


@query("top_tokens", f"WITH {I.DOC_TOKENS} SELECT part, token, n FROM (SELECT part, token, count(*) AS n, row_number() OVER (PARTITION BY part ORDER BY count(*) DESC, token) AS r FROM doc_tokens GROUP BY part, token) WHERE r <= 25")
def top_tokens(spark, sf_dir):
    """The 25 commonest words of each language: a top-k report."""
    return P.top_tokens(B.token_frequency(*I.document_sides(spark, sf_dir)), 25)


@query("key_collisions", "SELECT count(*) AS n_keys, max(n) AS largest, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.9), 6) AS p90, round(corr(n, length(p_name)), 6) AS corr_length FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def key_collisions(spark, sf_dir):
    groups = I.table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("n_keys"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", F.lit(0.9)), 6).alias("p90"), F.round(F.corr("n", F.length("p_name")), 6).alias("corr_length"))


_LETTERS = {"latin": r"[^\p{Latin}]", "cyrillic": r"[^\p{Cyrillic}]", "arabic": r"[^\p{Arabic}]", "native": "[^ऀ-ൿ]", "han": r"[^\p{Han}]"}
_COUNTS = ", ".join(f"length(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '{p}', '', 'g')) AS {s}" for s, p in _LETTERS.items())


@query("script_profile", f"""WITH c AS (SELECT lang, {_COUNTS} FROM documents), m AS (SELECT *, greatest(latin, cyrillic, arabic, native, han) AS m FROM c)
SELECT lang, CASE WHEN m = 0 THEN 'none' WHEN m = latin THEN 'latin' WHEN m = cyrillic THEN 'cyrillic' WHEN m = arabic THEN 'arabic' WHEN m = native THEN 'native' ELSE 'han' END AS script, count(*) AS n FROM m GROUP BY ALL""")
def script_profile(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    return docs.groupBy("lang", N.dominant_script(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


#: One word in each of nine scripts, dotted legal forms, and full-width letters, put before the names of nations.
SAMPLES = ["नमस्ते दुनिया", "বাংলা ভাষা", "ਪੰਜਾਬੀ ਬੋਲੀ", "ગુજરાતી ભાષા", "ଓଡ଼ିଆ ଭାଷା", "தமிழ் மொழி", "తెలుగు భాష", "ಕನ್ನಡ ನುಡಿ", "മലയാളം ഭാഷ", "Foo S.A.R.L. Lyon", "S.A. Ｗｉｄｅ", "e.u.r.l. Ｙ"]


@query("translit_words")
def translit_words(spark, sf_dir):
    """The transliterator, NFKC cleaning and dotted forms on the names of all nations, each with a sample in front of it."""
    samples = F.get(F.array(*(F.lit(x) for x in SAMPLES)), (F.col("n_nationkey") % len(SAMPLES)).cast("int"))
    rows = I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(samples, F.lit(" "), F.col("n_name")).alias("raw"))
    clean = N.basic_clean(F.col("raw"), nfkc=True)
    return rows.select("id", "raw", translit.translit(clean).alias("latin"), N.undot(clean).alias("undotted"), N.norm_name(F.col("raw"), translit.translit, dotted=True, nfkc=True)["core"].alias("core"))
