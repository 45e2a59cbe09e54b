"""Filtering of URLs by a list and by association rules.

The list decides first: an entry (host, path, verdict) fits its host and all subdomains where the URL's path begins with its own, and the
longest one wins. The URLs that it decides are labelled ones. From these Spark's FP-growth mines which combinations of URL tokens go
with which verdict; rules below a support or a confidence go, and so does a rule that is no surer than one without one of its tokens.
An inverted index holds each rule under its rarest token: a URL's tokens find the rules whose tokens it has in full, and the surest
of them decides where the list says nothing. Where no rule matches, the verdict is `allow`.

A URL has one token of each of ten kinds at most, so it has at most 1,024 combinations, and there are never more than 1,024 / MIN_SUPPORT
rules: the index is broadcast with that bound. All listed URLs are mined, none is sampled.

A null URL or one without :// has an empty host and path and no tokens. Repeated rows are judged each by itself; of rules alike in
confidence and support `block` comes before `allow`. Very long URLs are taken whole. Without listed URLs there are no rules; an
empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE = 0.02, 0.8
Entry = tuple[str, str, str]
# The list of the query.
LIST: list[Entry] = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, entries: Sequence[Entry]) -> Column:
    """struct<rule, verdict> of the longest entry that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own, begins, verdict in sorted(entries, key=lambda e: len(e[0] + e[1])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(begins))
        out = F.when(fits, F.struct(F.lit(own + begins).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """array<string>: kind=value, a token of each kind at most."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))))
    last = F.element_at(parts, -1)
    each = [
        ("scheme", F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*(?=://)", 0))),
        ("tld", F.element_at(labels, -1)),
        ("site", F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2)))),
        ("host", F.when(F.size(labels) > 2, host)),
        ("sub", F.when(F.size(labels) > 2, F.element_at(labels, 1))),
        ("dir", F.when(F.size(parts) > 1, F.element_at(parts, 1))),
        ("page", F.when(F.size(parts) > 0, F.regexp_replace(last, "[0-9]+", "#"))),
        ("depth", F.size(parts).cast("string")),
        ("query", F.when(query != "", F.array_join(names, "&"))),
        ("fragment", F.when(F.contains(url, F.lit("#")), "yes")),
    ]
    made = F.array(*(F.when(value != "", F.concat(F.lit(f"{kind}="), value)) for kind, value in each))
    return F.when(host != "", F.array_compact(made)).otherwise(F.array().cast("array<string>"))


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """tokens, verdict of labelled URLs -> antecedent (sorted tokens), verdict, confidence, support: the rules that stay. Staged."""
    spark = labelled.sparkSession
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if labelled.limit(1).isEmpty():
        return spark.createDataFrame([], schema)
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    told = model.associationRules.filter(F.startswith(F.element_at("consequent", 1), F.lit("=")))
    rules = staged(told.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), 2, 100).alias("verdict"), "confidence", "support"))
    shorter = rules.select("antecedent", "verdict", F.col("confidence").alias("known"))
    fewer = F.transform("antecedent", lambda x: F.array_remove(F.col("antecedent"), x))
    each = rules.select("*", F.explode(fewer).alias("part"))
    surer = each.join(shorter.withColumnRenamed("antecedent", "part"), ["part", "verdict"]).filter("known >= confidence").select("antecedent", "verdict").distinct()
    return staged(rules.join(surer, ["antecedent", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "support"))


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules under the token of theirs that the fewest labelled URLs have."""
    used = rules.select(F.explode("antecedent").alias("token")).distinct()
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(used, "token")
    each = rules.select("*", F.explode("antecedent").alias("token")).join(counts, "token")
    rarest = each.groupBy("antecedent", "verdict").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return rules.join(rarest, ["antecedent", "verdict"])


def judged(pages: DataFrame, entries: Sequence[Entry] = LIST, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, url -> page_id, host, path, rule, verdict; and, where a mined rule decides, its tokens (reason) and its confidence."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = urls.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = urls.select("page_id", "host", "path", listed(F.col("host"), F.col("path"), entries).alias("listed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    labelled = staged(urls.filter("listed is not null").select("tokens", F.col("listed.verdict").alias("verdict")))
    rules = staged(indexed(mined(labelled, min_support, min_confidence), labelled))
    # No more than 1,024 / min_support rules.
    index = F.broadcast(rules.select("token", "antecedent", F.struct("confidence", "support", "verdict", F.array_join("antecedent", " ").alias("reason")).alias("told")))
    rows = urls.withColumn("row", F.monotonically_increasing_id())
    open_tokens = F.when(F.col("listed").isNull(), F.col("tokens"))
    each = rows.select("row", "page_id", "host", "path", "listed", open_tokens.alias("tokens"), F.explode_outer(open_tokens).alias("token"))
    found = each.join(index, "token", "left")
    whole = F.when(F.size(F.array_except("antecedent", "tokens")) == 0, F.col("told"))
    best = found.groupBy("row", "page_id", "host", "path", "listed").agg(F.max(whole).alias("told"))
    return best.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", "told.verdict", F.lit("allow")).alias("verdict"), F.col("told.reason").alias("reason"), F.col("told.confidence").alias("confidence"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def _sql_listed() -> str:
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(h, p, v)}'" for h, p, v in sorted(LIST, key=lambda e: -len(e[0] + e[1]))) + " END"
    return f"{case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS listed"


ORACLE_OP12 = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, r, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM u),
l AS (SELECT *, {_sql_listed()}, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM h),
t AS (SELECT page_id, r, host, path, rule, listed, CASE WHEN host = '' THEN [] ELSE list_filter([
  'scheme=' || lower(nullif(CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) END, '')),
  'tld=' || nullif(labels[-1], ''), CASE WHEN len(labels) > 1 THEN 'site=' || labels[-2] || '.' || labels[-1] END,
  CASE WHEN len(labels) > 2 THEN 'host=' || host END, CASE WHEN len(labels) > 2 THEN 'sub=' || nullif(labels[1], '') END,
  CASE WHEN len(parts) > 1 THEN 'dir=' || parts[1] END, CASE WHEN len(parts) > 0 THEN 'page=' || regexp_replace(parts[-1], '[0-9]+', '#', 'g') END, 'depth=' || len(parts),
  CASE WHEN query <> '' THEN 'query=' || nullif(array_to_string(list_sort(list_distinct(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^[^=]*', 0)))), '&'), '') END,
  CASE WHEN contains(url, '#') THEN 'fragment=yes' END], lambda x: x IS NOT NULL) END AS tokens FROM l),
m AS (SELECT row_number() OVER () AS k, list_append(tokens, '=' || listed) AS items FROM t WHERE rule IS NOT NULL),
least_n AS (SELECT ceil({MIN_SUPPORT}::DOUBLE * count(*)) AS n FROM m),
often AS (SELECT x FROM (SELECT unnest(items) AS x FROM m) GROUP BY x HAVING count(*) >= (SELECT n FROM least_n)),
kept AS MATERIALIZED (SELECT k, list(x ORDER BY x) AS items FROM (SELECT k, unnest(items) AS x FROM m) JOIN often USING (x) GROUP BY k),
sets AS (SELECT s, count(*) AS n FROM (SELECT list_filter(items, lambda x, i: (b >> (i - 1)) & 1 = 1) AS s FROM kept, range(1, 2048) g(b) WHERE b < (1::BIGINT << len(items))) GROUP BY s HAVING count(*) >= (SELECT n FROM least_n)),
pairs AS (SELECT list_filter(s, lambda x: x[1] <> '=') AS a, substr(list_filter(s, lambda x: x[1] = '=')[1], 2) AS verdict, n FROM sets WHERE len(list_filter(s, lambda x: x[1] = '=')) = 1 AND len(s) > 1),
rules AS MATERIALIZED (SELECT a, verdict, p.n::DOUBLE / sets.n AS confidence, p.n::DOUBLE / (SELECT count(*) FROM m) AS support FROM pairs p JOIN sets ON sets.s = p.a WHERE p.n::DOUBLE / sets.n >= {MIN_CONFIDENCE}),
worse AS (SELECT DISTINCT e.a, e.verdict FROM (SELECT a, verdict, confidence, unnest(list_transform(a, lambda x: list_filter(a, lambda y: y <> x))) AS part FROM rules) e JOIN rules o ON o.a = e.part AND o.verdict = e.verdict AND o.confidence >= e.confidence),
stay AS (SELECT * FROM rules WHERE NOT EXISTS (SELECT 1 FROM worse w WHERE w.a = rules.a AND w.verdict = rules.verdict)),
best AS (SELECT t.r, max(struct_pack(confidence := confidence, support := support, verdict := verdict, reason := array_to_string(a, ' '))) AS told FROM t JOIN stay ON list_has_all(t.tokens, stay.a) WHERE t.rule IS NULL GROUP BY t.r)
SELECT page_id, host, path, rule, coalesce(listed, told.verdict, 'allow') AS verdict, told.reason AS reason, told.confidence AS confidence FROM t LEFT JOIN best USING (r)
"""
