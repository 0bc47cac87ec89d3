"""URL filters: fixed host and path rules, and association rules mined by FP-growth.

Every URL becomes a set of tokens: the suffixes of its host, the segments of its path (digits as
#), its file ending and the keys of its query.  From labelled URLs, Spark's FP-growth mines the
token combinations that imply ``block``; rules below the support or the confidence are pruned, and so is a rule of which a part
is as confident.  A rule is indexed under its rarest token; a URL meets only the rules
of its own tokens and fires those of which it has all tokens.  A fixed rule, where one fits, decides
before the mined ones; without any the URL is allowed.

Tokens that occur in exactly the same labelled URLs are mined as one class, so long runs of tokens that always
come together do not multiply the combinations.  A rule needs any one token of each of its classes, as if a rule
had been mined for every member, and is indexed under all members of its rarest class.  The rules are few by construction: their number is
bounded by the support; no broadcast is forced.

Defined results: null or non-URL strings have empty host and path and no tokens, so they are allowed unless
a fixed rule fits; a URL of any length is read whole; of equally sure mined rules the one of more tokens is reported, then the
last in the order of its tokens (the verdict is the same); without blocked labels there are no mined rules; repeated rows each get
their verdict; an empty table gives no rows; other columns are never read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreplane.llm.common import stored

MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.8
MIN_ROWS = 20  # blocked URLs that a rule needs however few are labelled
BLOCK = "=block"
Rule = tuple[str, str, str]  # verdict, host, path

AFTER = "SUBSTRING(`{0}`, INSTR(`{0}`, '://') + 3)"
HOST = ("IF(COALESCE(INSTR(`{0}`, '://'), 0) = 0, '', TRANSLATE(REGEXP_EXTRACT(" + AFTER + ", '^[^/?#]*', 0),"
        " 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))")
PATH = "IF(COALESCE(INSTR(`{0}`, '://'), 0) = 0, '', REGEXP_EXTRACT(" + AFTER + ", '^[^/?#]*([^?#]*)', 1))"
TOKENS = r"""ARRAY_DISTINCT(CONCAT(
  TRANSFORM(FILTER(SEQUENCE(1, SIZE(SPLIT(host, '[.]'))), i -> host <> ''),
            i -> CONCAT('h:', ARRAY_JOIN(SLICE(SPLIT(host, '[.]'), i, SIZE(SPLIT(host, '[.]'))), '.'))),
  TRANSFORM(FILTER(SPLIT(path, '/'), s -> s <> ''), s -> CONCAT('p:', REGEXP_REPLACE(LOWER(s), '[0-9]+', '#'))),
  IF(path RLIKE '[.][A-Za-z0-9]+$', ARRAY(CONCAT('e:', LOWER(REGEXP_EXTRACT(path, '[.]([A-Za-z0-9]+)$', 1)))), ARRAY()),
  TRANSFORM(REGEXP_EXTRACT_ALL(query, '(?:^|&)([^&=]+)', 1), k -> CONCAT('q:', LOWER(k)))))"""
QUERY = "REGEXP_EXTRACT(COALESCE(`{0}`, ''), '[?]([^#]*)', 1)"


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, query of every row."""
    return pages.select(F.col(f"`{key}`").alias("key"), F.expr(HOST.format(url)).alias("host"),
                        F.expr(PATH.format(url)).alias("path"), F.expr(QUERY.format(url)).alias("query"))


def fixed_rule(rules: Sequence[Rule]) -> str:
    """SQL for the longest fitting fixed rule as struct(rule, verdict), null where none fits."""
    sql = ""
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        h, p = host.replace("'", "\\'"), path.replace("'", "\\'")
        sql += (f" WHEN (host = '{h}' OR ENDSWITH(host, '.{h}')) AND STARTSWITH(path, '{p}')"
                f" THEN NAMED_STRUCT('rule', '{h}{p}', 'verdict', '{verdict}')")
    return f"CASE{sql} END" if sql else "CAST(NULL AS STRUCT<rule: STRING, verdict: STRING>)"


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, confidence, rarest, classes) from labelled rows (tokens, blocked).

    ``tokens`` are the first ones of their classes; ``classes`` hold all tokens of each, in the order of ``tokens``."""
    spark = labelled.sparkSession
    rows = stored(labelled.where("blocked IS NOT NULL").select(F.monotonically_increasing_id().alias("u"), "tokens", "blocked"),
                  "labelled-urls")
    n = rows.count()
    empty = spark.createDataFrame([], "rule_id bigint, tokens array<string>, confidence double, rarest string,"
                                  " classes array<array<string>>")
    if not n:
        return empty
    least = max(MIN_ROWS, min_support * n)
    seen = rows.selectExpr("u", "EXPLODE(tokens) AS token").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.expr("BIT_XOR(XXHASH64(u))").alias("x"), F.expr("BIT_XOR(HASH(u))").alias("y"))
    seen = seen.where(F.col("n") >= least)
    same = Window.partitionBy("n", "x", "y")  # tokens of exactly the same URLs
    classed = stored(seen.select("token", "n", F.min("token").over(same).alias("first")), "url-classes")
    kept = stored(classed.where("token = first").select("token", "n"), "url-tokens")
    baskets = rows.selectExpr("u", "blocked", "EXPLODE(tokens) AS token").join(kept.select("token"), "token", "left_semi").groupBy(
        "u").agg(F.collect_set("token").alias("items"), F.max("blocked").alias("blocked"))
    baskets = stored(baskets.selectExpr(f"IF(blocked, CONCAT(items, ARRAY('{BLOCK}')), items) AS items"), "baskets")
    # a rule needs that many blocked rows; only those can hold one, so the combinations are counted there first
    blocked = baskets.where(f"ARRAY_CONTAINS(items, '{BLOCK}')")
    m = blocked.count()
    if m < least:
        return empty
    growth = FPGrowth(itemsCol="items", minSupport=least / m, minConfidence=1.0)
    sets = growth.fit(blocked).freqItemsets.where(f"ARRAY_CONTAINS(items, '{BLOCK}') AND SIZE(items) > 1").selectExpr(
        f"ARRAY_SORT(FILTER(items, i -> i <> '{BLOCK}')) AS tokens", "freq")
    sets = stored(sets.select(F.monotonically_increasing_id().alias("rule_id"), "tokens", "freq"), "url-itemsets")
    by = sets.selectExpr("rule_id", "tokens", "EXPLODE(tokens) AS token").join(kept, "token")
    rare = by.groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("r")).selectExpr("rule_id", "r.token AS rarest")
    index = stored(sets.join(rare, "rule_id"), "url-index")
    fired = fire(baskets.select(F.monotonically_increasing_id().alias("key"), F.col("items").alias("tokens")),
                 index.select("rule_id", "tokens", "rarest"))
    support = fired.groupBy("rule_id").agg(F.count(F.lit(1)).alias("all"))
    rules = stored(index.join(support, "rule_id").selectExpr("rule_id", "tokens", "rarest", "freq / all AS confidence").where(
        F.col("confidence") >= min_confidence), "url-rules")
    # a rule that holds all tokens of a shorter, equally confident one adds nothing
    whole = rules.selectExpr("rule_id AS big", "tokens AS big_tokens", "confidence AS big_confidence")
    covered = whole.selectExpr("*", "EXPLODE(big_tokens) AS token").join(rules.withColumnRenamed("rarest", "token"), "token").where(
        "big <> rule_id AND SIZE(tokens) < SIZE(big_tokens) AND SIZE(ARRAY_EXCEPT(tokens, big_tokens)) = 0"
        " AND confidence >= big_confidence").select(F.col("big").alias("rule_id")).distinct()
    rules = stored(rules.join(covered, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "rarest"), "url-pruned")
    members = classed.groupBy("first").agg(F.array_sort(F.collect_list("token")).alias("members"))
    classes = rules.selectExpr("rule_id", "EXPLODE(tokens) AS first").join(members, "first").groupBy("rule_id").agg(
        F.array_sort(F.collect_list(F.struct("first", "members"))).alias("c")).selectExpr("rule_id", "c.members AS classes")
    return stored(rules.join(classes, "rule_id"), "url-rule-classes")


def fire_classes(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, confidence, mined) for every rule of which a URL has a token of each class; mined are the URL's own tokens."""
    entries = rules.selectExpr("classes", "confidence", "EXPLODE(classes[ARRAY_POSITION(tokens, rarest) - 1]) AS token")
    met = urls.selectExpr("key", "tokens", "EXPLODE(tokens) AS token").join(entries, "token")
    return met.where("FORALL(classes, c -> ARRAYS_OVERLAP(c, tokens))").selectExpr(
        "key", "confidence", "TRANSFORM(classes, c -> ARRAY_MIN(ARRAY_INTERSECT(c, tokens))) AS mined")


def fire(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(key, rule columns) for every rule of which a URL has all tokens, by the index on the rarest token."""
    entries = index.withColumnRenamed("tokens", "rule_tokens").withColumnRenamed("rarest", "token")
    met = urls.selectExpr("key", "tokens", "EXPLODE(tokens) AS token").join(entries, "token")
    return met.where("SIZE(ARRAY_EXCEPT(rule_tokens, tokens)) = 0").drop("token", "tokens")


def verdicts(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url",
             min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, mined (tokens of the mined rule that decided), confidence.

    ``labels`` has (key, blocked); a page that a fixed rule decides is labelled by that rule."""
    rows = parsed(pages, key, url).selectExpr("key", "host", "path", f"{fixed_rule(rules)} AS fixed", f"{TOKENS} AS tokens")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("u"), "*"), "urls")
    known = labels.where("key IS NOT NULL").groupBy("key").agg(F.max("blocked").alias("told"))
    labelled = rows.join(known, "key", "left").selectExpr(
        "tokens", "COALESCE(fixed.verdict = 'block', told) AS blocked")
    index = mined_rules(labelled, min_support, min_confidence)
    hits = fire_classes(rows.where("fixed IS NULL").selectExpr("u AS key", "tokens"), index)
    best = hits.groupBy(F.col("key").alias("u")).agg(F.max(F.struct(
        "confidence", F.expr("SIZE(mined) AS n"), F.expr("ARRAY_JOIN(mined, ' ') AS mined"))).alias("best"))
    return rows.join(best, "u", "left").selectExpr(
        "key", "host", "path", "fixed.rule AS rule",
        "COALESCE(fixed.verdict, IF(best IS NULL, 'allow', 'block')) AS verdict", "best.mined AS mined",
        "best.confidence AS confidence")
