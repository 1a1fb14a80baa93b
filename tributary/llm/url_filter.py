"""Operator 8 [native]: URL filters by list rules and by association rules mined with FP-growth.

List rules decide first: a rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest wins. For other
urls, rules "token combination -> block" are mined from labelled urls with Spark's FP-growth, pruned by support, confidence, significance and redundancy, and
found through an inverted index on each rule's rarest token. A url that fits a mined rule is blocked, every other one is allowed.

Tokens that stand in exactly the same labelled urls are one item, so a long url that repeats doesn't make each combination of its tokens an itemset.

DataFrame functions and Spark ML only: no Python, pandas, Arrow or RDD code runs on rows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: A rule needs this share of the labelled urls and this many, and this confidence.
MIN_SUPPORT, MIN_URLS, MIN_CONFIDENCE = 0.002, 5, 0.6
#: Chance that labels which don't depend on urls give any rule at all.
ERROR = 0.01
#: The class item; tokens have a tag in front of the sign, so none is like it.
BLOCK = "=block"
#: Mined rules are broadcast only if they are counted and no more than this; else the index is joined by a shuffle.
BROADCAST_ROWS = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased. Path: from there up to ? # or end. Both empty without :// or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def list_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later and longer ones take over
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, host, its last label and its last two, path words, names in the query."""
    words = F.filter(F.split(path, "[/._-]"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^([^=]*)", 1)))
    tagged = lambda tag, items: F.transform(items, lambda x: F.concat(F.lit(tag), x))
    last = lambda n: F.substring_index(host, ".", -n)
    fixed = F.array(F.concat(F.lit("scheme="), F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]*):", 1)), F.concat(F.lit("host="), host), F.concat(F.lit("domain="), last(2)), F.concat(F.lit("top="), last(1)))
    return F.array_distinct(F.concat(fixed, tagged("path=", words), names))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, support, confidence) "tokens -> block" from (tokens, blocked), and (token, item): the item that stands for a token in rules.

    support is a share of the labelled urls. A rule stays if its urls are blocked more often than all are, beyond what chance gives among all itemsets that were
    looked at (a bound on the binomial tail), and if no more general rule is as sure. Null and empty token lists, and rows with a null label, teach nothing; repeated
    rows count each.
    """
    rows = labelled.where((F.size("tokens") > 0) & F.col("blocked").isNotNull()).select("tokens", "blocked", F.xxhash64(F.array_sort("tokens"), "blocked").alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "url-baskets")
    n, n_blocked = rows.agg(F.count("*"), F.count_if("blocked")).first()
    least = max(min_urls, math.ceil(min_support * n))
    each = rows.select("row", "blocked", "h", F.explode(F.array_distinct("tokens")).alias("token"))
    # only tokens of enough blocked urls can be in a rule; equal sets of urls have equal counts, sums and exclusive ors of hashes
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 40))).alias("s")).where(F.col("b") >= least)
    items = counts.groupBy("n", "b", "x", "s").agg(F.min("token").alias("item"))
    items = written(counts.join(items, ["n", "b", "x", "s"]).select("token", "item"), "url-items")
    nothing = rows.sparkSession.createDataFrame([], "tokens array<string>, support double, confidence double")
    if not n_blocked or items.isEmpty():
        return nothing, items
    few = items.count() <= BROADCAST_ROWS
    baskets = each.join(F.broadcast(items) if few else items, "token").groupBy("row").agg(F.collect_set("item").alias("items"), F.first("blocked").alias("blocked"))
    baskets = written(baskets.select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items")), "url-baskets")
    n_baskets = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_baskets, minConfidence=min_confidence).fit(baskets)
    looked_at = model.freqItemsets.count()
    base = n_blocked / n
    urls = F.col("support") * n_baskets / F.col("confidence")
    c = F.least(F.col("confidence"), F.lit(1 - 1e-12))
    divergence = c * F.log(c / base) + (1 - c) * F.log((1 - c) / max(1 - base, 1e-12))
    found = model.associationRules.where((F.size("consequent") == 1) & F.array_contains("consequent", BLOCK) & (F.col("confidence") > base))
    found = found.where(urls * divergence >= math.log(looked_at / ERROR))
    rules = written(found.select(F.array_sort("antecedent").alias("tokens"), (F.col("support") * n_baskets / n).alias("support"), "confidence"), "url-rules")
    general = rules.select(F.col("tokens").alias("g"), F.col("confidence").alias("g_confidence"), F.element_at("tokens", 1).alias("first"))
    # a more general rule's first token is one of this rule's tokens: an equality join, not all pairs
    exploded = rules.select("tokens", "confidence", F.explode("tokens").alias("first"))
    worse = exploded.join(general, "first").where((F.size("g") < F.size("tokens")) & (F.size(F.array_except("g", "tokens")) == 0) & (F.col("g_confidence") >= F.col("confidence"))).select("tokens").distinct()
    return rules.join(worse, "tokens", "left_anti"), items


def blocked_urls(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct urls (url, tokens) that fit a mined rule, by the items of their tokens. The index holds each rule under its rarest item among these urls."""
    used = items.join(rules.select(F.explode("tokens").alias("item")).distinct(), "item", "left_semi")
    used = F.broadcast(used) if used.count() <= BROADCAST_ROWS else used
    hits = urls.select("url", F.explode("tokens").alias("token")).join(used, "token")
    per_url = hits.groupBy("url").agg(F.collect_set("item").alias("tokens"))
    per_url = per_url.select("url", "tokens", F.explode("tokens").alias("token"))
    wanted = rules.select(F.col("tokens").alias("rule"), F.explode("tokens").alias("token"))
    wanted = F.broadcast(wanted) if rules.count() <= BROADCAST_ROWS else wanted
    seen = per_url.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = wanted.join(seen, "token", "left").groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = F.broadcast(index) if rules.count() <= BROADCAST_ROWS else index
    return per_url.join(index, "token").where(F.size(F.array_except("rule", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (list rule or null), verdict.

    Labels mark page_id by doc_id; quality 0 or toxic 1 is a label to block; a null page_id has no label. A null url has empty host and path and is allowed;
    repeated rows stay. Without labels, or without a rule that they bear out, what no list rule decides is allowed.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = list_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "listed": verdict})
    with_tokens = rows.where("url IS NOT NULL").withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("blocked"))
    labelled = written(with_tokens.join(marks, "page_id").select("tokens", (F.coalesce("blocked", F.lit(0)) == 1).alias("blocked")), "url-labelled")
    if labelled.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"))
    mined, items = mine(labelled)
    open_urls = with_tokens.where("rule IS NULL").groupBy("url").agg(F.first("tokens").alias("tokens"))
    bad = blocked_urls(open_urls, mined, items).withColumn("bad", F.lit(True))
    judged = rows.join(bad, "url", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
