"""Mixing sources to target weights: hash-random order, distributed prefix sums of sizes, exact cuts, repeated epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, counted_cut, cut, table


def target_sizes(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets of sources: ``sizes`` has one row a source (skey, source, source_size).

    Sources in code-point order (null last) weigh ``weights``, repeating. Targets share the sum of all sizes by weight;
    none exceeds ``cap`` times its source's size, and what lies above is shared again by weight. With ratios
    ``cap * size / weight`` in ascending order the capped sources are a prefix, so one pass over the list of sources
    (a row each, however many documents there are) finds the level of the others.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    level = Window.orderBy("ratio", "skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    every = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("lev", (F.sum("source_size").over(every) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
                      / F.sum("weight").over(after))
         .withColumn("lev", F.min(F.when(F.col("lev") <= F.col("ratio"), F.struct("ratio", "skey", "lev"))).over(every)["lev"]))
    return s.select("skey", F.least(F.coalesce(F.col("lev") * F.col("weight"), F.lit(float("inf"))),
                                    F.lit(float(cap)) * F.col("source_size")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix", in_range: int = 1_000, whole: bool = False) -> DataFrame:
    """How many words of each document the mixture takes: (doc_id, size, source_size, target, taken), and with ``whole``
    a struct ``row`` of all columns of ``docs``.

    Documents of a source are put in a random but repeatable order by the md5 of their id and ``seed`` (without an id,
    of their text). A source takes whole epochs while its target allows, then documents in that order until the rest is
    used up; the last document is taken in part. The order is cut into ranges of the key, of ``in_range`` rows on
    average, whose sizes are summed before any row is sorted: a source that holds a third of all rows is spread over all
    ranges, and each range needs only its base. Bases are summed in two steps, over up to 4,096 ranges each and then over
    those groups, so the ranges of a source do not meet in one task. Words are counted once, and ids and sizes written.

    Null text or text without words: size 0, taken 0. Null source: a source of its own, last. Repeated ids share a key
    and are ordered by size; equal rows are interchangeable. An empty table gives an empty result. Only the named columns
    are read (without ``whole``), and other columns may have any name.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))), F.lit(f"|{seed}")))
    source = F.col(source_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("_src"), key.alias("_key"), size.alias("size"),
                       F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source)).alias("skey"), *([F.struct("*").alias("row")] if whole else []))
    slim, n = counted_cut(rows.drop("row", "doc_id") if whole else rows)
    digits = 1
    while 16**digits * in_range < n:
        digits += 1
    rows, slim = (x.withColumn("_b", F.substring("_key", 1, digits)) for x in (rows if whole else slim, slim))
    ranges = cut(slim.groupBy("skey", "_b").agg(F.sum("size").alias("n"), F.first("_src").alias("source")))
    per = ranges.groupBy("skey").agg(F.sum("n").alias("source_size"), F.first("source").alias("source"))
    before = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_top", F.substring("_b", 1, max(0, digits - 3)))
    tops = ranges.groupBy("skey", "_top").agg(F.sum("n").alias("of_top")).withColumn("top_base", before("of_top", ["skey"], "_top")).drop("of_top")
    plan = (ranges.withColumn("base", before("n", ["skey", "_top"], "_b")).join(tops, ["skey", "_top"]).withColumn("base", F.col("base") + F.col("top_base"))
            .join(per.drop("source").join(target_sizes(per, weights, cap), "skey"), "skey")
            .select("skey", "_b", "base", "source_size", "target"))
    inside = Window.partitionBy("skey", "_b").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = (rows.join(plan, ["skey", "_b"])
           .withColumn("_start", F.col("base") + F.sum("size").over(inside) - F.col("size"))
           .withColumn("_epochs", epochs)
           .withColumn("_rest", F.floor("target") - F.col("_epochs") * F.col("source_size")))
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start")))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if whole else []))


def draw(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The mixture itself: each document as often as its epochs say, then once more, cut after its last taken word, if
    the source's budget ends inside it. Returns the columns of ``docs``, whatever their names; n_chars, if there is one,
    is that of the text returned. Documents without words (null, empty or white space) are nothing of any mixture and
    are not in it."""
    m = mix_sources(docs, text_col=text_col, whole=True, **kw)
    text = F.col(f"row.`{text_col}`")
    m = m.where("taken > 0").withColumn("times", F.floor(F.col("taken") / F.col("size")).cast("int"))
    m = m.withColumn("part", (F.col("taken") - F.col("times") * F.col("size")).cast("int"))
    # the first `part` words: the text is split after its words, which keeps the white space between them
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    last = F.when(F.col("part") > 0, F.array(F.array_join(F.slice(pieces, F.lit(1), F.col("part")), ""))).otherwise(F.array().cast("array<string>"))
    out = m.withColumn("now", F.explode(F.concat(F.array_repeat(text, F.col("times")), last)))
    new = {text_col: F.col("now"), "n_chars": F.length("now").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_mix_sources(spark, sf_dir):
    """Words that the mixture of sources takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS skey,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || '|mix') AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight FROM per),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - 3.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                / sum(weight) OVER (ORDER BY ratio, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
f AS (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, skey LIMIT 1),
t AS (SELECT skey, source_size, least((SELECT lev FROM f) * weight, 3.0::DOUBLE * source_size) AS target FROM r),
s AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             sum(size) OVER (PARTITION BY d.skey ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS start,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
      FROM d JOIN t USING (skey))
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken
FROM s
"""
