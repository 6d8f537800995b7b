"""URL filters: explicit host and path rules first, then association rules mined from the pages that those rules label."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: (verdict, rule): the rule's text up to its first "/" is the host it fits with all subdomains, the rest starts the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 4))
    host = F.coalesce(F.regexp_extract(after, r"\A([^/?#]*+)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.substr(after, F.length(host) + 1), r"\A([^?#]*+)", 1), F.lit(""))
    return F.translate(host, _UP, _LOW), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. ``rules`` is a short list given by the user; of
    rules that are equally long and fit, the last in it counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_items(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: host labels but "www", the first label, path words, suffix, query keys, fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(F.lower(path), r"[/_.\-]+"), lambda x: (x != "") & ~x.rlike(r"\A[0-9]+\z"))
    query = F.filter(F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: F.lower(F.substring_index(x, "=", 1))), lambda x: x != "")
    tag = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    first = F.when(F.size(labels) > 2, F.array(F.concat(F.lit("s:"), labels[0]))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tag("h:", labels), first, tag("p:", words), tag("q:", query),
                                     F.when(F.endswith(path, F.lit("/")), F.array(F.lit("/end"))).otherwise(F.array().cast("array<string>"))))


def _frequent(labelled: DataFrame, min_support: float, longest: int) -> tuple[DataFrame, int]:
    """(items, n, hits) of all combinations of up to ``longest`` tokens that enough blocked URLs have, but those which have a
    part that as many URLs have, or that only blocked URLs have, and no rule of their own to add; and the number of URLs.

    Pattern growth over tables: equal token sets are one row; of each combination the tokens that may follow it, with
    counts, are its conditional pattern base, from which the combinations with one token more come.
    """
    rows = labelled.select(F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))).alias("rest"), (F.col("verdict") == "block").cast("int").alias("hits"))
    rows = cut(rows.groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, math.ceil(min_support * total))
    often = rows.select(F.explode("rest").alias("t"), "hits").groupBy("t").agg(F.sum("hits").alias("h")).where(F.col("h") >= least).select("t")
    base = rows.select("rest", "n", "hits", F.explode("rest").alias("t")).join(often, "t").groupBy("rest").agg(F.first("n").alias("n"), F.first("hits").alias("hits"), F.array_sort(F.collect_list("t")).alias("few"))
    base = base.groupBy(F.col("few").alias("rest")).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).withColumn("items", F.array().cast("array<string>"))
    out = before = None
    for k in range(1, longest + 1):
        grown = base.select("items", "rest", "n", "hits", F.posexplode("rest").alias("at", "t"))
        grown = grown.select(F.concat("items", F.array("t")).alias("items"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "n", "hits")
        base = cut(grown.groupBy("items", "rest").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")))
        found = cut(base.groupBy("items").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where(F.col("hits") >= least))
        out = found if out is None else out.unionByName(found)
        alive = found.where("n > hits")
        if before is not None:
            parts = alive.select("items", "n", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"))
            alive = alive.join(parts.join(before.select(F.col("items").alias("part"), "n"), ["part", "n"]).select("items").distinct(), "items", "left_anti")
        alive = cut(alive.select("items"))
        if k == longest or not alive.limit(1).count():
            break
        base, before = base.where(F.size("rest") > 0).join(alive, "items", "left_semi"), found
    return out, total


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.85, longest: int = 4) -> DataFrame:
    """Association rules items -> block: ``labelled`` has (items array<string>, verdict). Returns (items, confidence, support).

    Pattern growth finds the token combinations that enough blocked URLs have; rules under ``min_confidence`` are dropped,
    then every rule that has a subset with at least its confidence, so of rules that tie the shortest stay. Combinations of
    more than ``longest`` tokens make no rule; all tokens of a URL take part, however many it has. A combination of which
    a part occurs as often, or that only blocked URLs have, is not grown: what it would become ties with something shorter.
    A rule is compared with its own subsets only (an inverted look-up, at most 2**longest a rule), never with all others.
    """
    found, n = _frequent(labelled, min_support, longest)
    made = cut(found.select("items", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / F.lit(max(n, 1))).alias("support")).where(F.col("confidence") >= min_confidence))
    parts = F.expr("transform(sequence(1, shiftleft(1, size(items)) - 2), m -> filter(items, (x, i) -> (shiftright(m, i) & 1) = 1))")
    asked = made.where(F.size("items") > 1).select("items", "confidence", F.explode(parts).alias("part"))
    weaker = (asked.join(made.select(F.col("items").alias("part"), F.col("confidence").alias("c")), "part").where(F.col("c") >= F.col("confidence"))
              .select("items").distinct())
    return made.join(weaker, "items", "left_anti")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
               min_support: float = 0.005, min_confidence: float = 0.85) -> DataFrame:
    """Verdict on every URL: (page_id, host, path, rule, verdict).

    A URL that a rule fits has the rule's verdict. Those URLs are the labels from which token combinations are mined.
    Another URL is blocked if a mined rule's tokens are all among its own, else allowed. Mined rules are matched by an
    inverted index: each is listed under its rarest token, a URL looks up its tokens and verifies what it finds.

    Null and malformed URLs have empty host and path, no tokens and verdict allow. Verdicts depend on the URL alone, so
    rows may repeat and ids may be null. Without labelled URLs, or without blocked ones, nothing is mined. An empty table
    gives an empty result. Only the two named columns are read.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", verdict).withColumn("items", url_items(F.col("host"), F.col("path"), F.col("url")))
    mined = cut(mine_rules(rows.where(F.col("said").isNotNull()).select("items", F.col("said").alias("verdict")), min_support, min_confidence))
    # the rarest token of a rule, by its number of labelled URLs
    df = rows.where(F.col("said").isNotNull()).select(F.explode("items").alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    index = (mined.select("items", F.explode("items").alias("_t")).join(df, "_t")
             .withColumn("_r", F.row_number().over(Window.partitionBy("items").orderBy("_n", "_t"))).where("_r = 1")
             .select(F.col("items").alias("_rule"), F.col("_t")))
    # undecided URLs by their token set: as many look-ups as there are different sets
    asked = rows.where(F.col("said").isNull() & (F.size("items") > 0)).select(F.array_sort("items").alias("_set")).distinct()
    hit = (asked.select("_set", F.explode("_set").alias("_t")).join(index, "_t")
           .where(F.size(F.array_except("_rule", "_set")) == 0).select("_set").distinct().withColumn("_hit", F.lit(True)))
    return (rows.withColumn("_set", F.array_sort("items")).join(hit, "_set", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("said", F.when(F.col("said").isNull() & F.col("_hit"), F.lit("block")), F.lit("allow")).alias("verdict")))


def op8_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_url_rules(spark, sf_dir):
    """The explicit rules alone: (page_id, host, path, rule)."""
    host, path = url_parts(F.col("url"))
    rule, _ = rule_of(F.col("host"), F.col("path"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule)


OP8_RULES_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, rest FROM p),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
r(rule, h, p) AS (VALUES ('com/', 'com', '/'), ('example.com/en/', 'example.com', '/en/'), ('www.example.com/en/', 'www.example.com', '/en/'), ('net/es/', 'net', '/es/'), ('net/fr/', 'net', '/fr/'))
SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM r WHERE (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p)) AS rule FROM q
"""
