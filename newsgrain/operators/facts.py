"""Facts that mean the same: a join by custom equality over inverted indexes, and what only one source of a story reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_fact, spelling_ratio
from ..storage import cut

_GRAM = 5  # shortest key that another may contain


def _rarest(grams: DataFrame, block: str, many: Column) -> DataFrame:
    """(block, key, ..., gram) with only the ``many`` grams of a key that fewest keys of its block have."""
    df = grams.groupBy(block, "gram").agg(F.count(F.lit(1)).alias("_df"))
    w = Window.partitionBy(block, "key").orderBy("_df", "gram")
    return grams.join(df, [block, "gram"]).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= many).drop("_rn", "_df")


def _runs_in(a: str, b: str) -> Column:
    """How many of the runs of three letters of ``a`` lie in ``b``."""
    return F.size(F.filter(F.transform(F.sequence(F.lit(1), F.length(a) - 2), lambda i: F.substring(a, i, F.lit(3))), lambda g: F.contains(F.col(b), g)))


def equal_facts(keys: DataFrame, block: str, ratio: float = 0.90, least: int = _GRAM, spelling: bool = True, few: int = 24) -> DataFrame:
    """(block, item, other, tier): pairs of different keys of a block that state the same fact.

    ``keys`` has the block, ``key`` (of ``normalize_fact``) and a boolean ``asked``: an item is a key that asks, the other is any.
    Tiers as in ``functions.text.match_facts``, the first that holds: contained, subset (of words), spelling.

    Blocks of up to ``few`` keys are compared whole: no key meets more than these, and spelling is left to pairs that have as
    many runs of three letters in common as it takes. In larger ones no pairs are made to look
    for equal facts, and the result is the same. There a key that is contained in another has its rarest run of five
    letters there; one whose words are among another's has its rarest word there: so each key is looked up once in the
    lists of grams and of words. Keys alike in spelling share so many runs of three letters that the rarest of both, as
    many as may be missing and one more, have one in common. What is found is verified; spelling last, of pairs that do
    share as many runs.
    """
    k = keys.where(F.length("key") >= least).groupBy(block, "key").agg(F.max("asked").alias("asked"))
    asking = k.groupBy(block).agg(F.bool_or("asked").alias("_some"), F.count(F.lit(1)).alias("_n")).where("_some and _n > 1").select(block, "_n")
    every = cut(k.join(asking, block))
    k, small_blocks = every.where(F.col("_n") > few).drop("_n"), every.where(F.col("_n") <= few).drop("_n")
    may_be_spelt = (2 * F.least(F.length("item"), F.length("other")) >= ratio * (F.length("item") + F.length("other"))) & ~F.concat("item", "other").rlike(r"\d")
    met = small_blocks.where("asked").select(block, F.col("key").alias("item")).join(small_blocks.select(block, F.col("key").alias("other")), block).where("item <> other")
    x, y = F.split("item", " "), F.split("other", " ")
    met = met.withColumn("tier", F.when(F.contains("item", "other") | F.contains("other", "item"), "contained").when((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0), "subset"))
    # keys of n and n' letters, of which m are matched in r pieces: 2m >= ratio * (n + n'), and r <= n + n' - 2m + 1, so
    # m - 2r runs of three letters are common
    common = lambda both: F.ceil(both * (2.5 * ratio - 2) - 2 - 1e-9)
    met = met.where(F.col("tier").isNotNull() | (may_be_spelt & (_runs_in("item", "other") >= common(F.length("item") + F.length("other")))) if spelling else F.col("tier").isNotNull())
    if spelling:
        met = cut(met)
        open_ = met.where("tier is null").where(spelling_ratio(F.col("item"), F.col("other")) >= ratio).withColumn("tier", F.lit("spelling"))
        met = met.where("tier is not null").unionByName(open_)
    if not k.limit(1).count():
        return met
    grams = k.select(block, "key", "asked", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - (least - 1)), lambda i: F.substring("key", i, least)))).alias("gram"))
    words = k.select(block, "key", "asked", F.explode(F.array_distinct(F.split("key", " "))).alias("gram"))

    def holding(listed: DataFrame) -> DataFrame:
        df = listed.groupBy(block, "gram").agg(F.count(F.lit(1)).alias("_df"))
        small = listed.join(df, [block, "gram"]).groupBy(block, "key", "asked").agg(F.min(F.struct("_df", "gram")).alias("_x")).select(block, F.col("key").alias("small"), F.col("asked").alias("_a"), "_x.gram")
        met = small.join(listed.select(block, F.col("key").alias("large"), F.col("asked").alias("_b"), "gram"), [block, "gram"])
        return met.where((F.col("small") != F.col("large")) & (F.col("_a") | F.col("_b"))).select(block, "small", "large", "_a", "_b")

    contained = holding(grams).where(F.contains("large", "small")).withColumn("tier", F.lit("contained"))
    subset = holding(words).where(F.size(F.array_except(F.split("small", " "), F.split("large", " "))) == 0).withColumn("tier", F.lit("subset"))
    both = contained.unionByName(subset)
    out = both.where("_a").select(block, F.col("small").alias("item"), F.col("large").alias("other"), "tier").unionByName(both.where("_b").select(block, F.col("large").alias("item"), F.col("small").alias("other"), "tier"))
    if spelling:
        out = cut(out)
        n = F.length("key")
        # the common runs of three letters are fewest for the shortest partner, where n + n' = 2n / (2 - ratio)
        three = k.where(~F.col("key").rlike(r"\d")).select(block, "key", "asked", (n - 1 - F.greatest(F.lit(0), common(2 * n / (2 - ratio)))).alias("_many"),
                                                           F.posexplode(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring("key", i, 3))).alias("_at", "gram"))
        again = F.row_number().over(Window.partitionBy(block, "key", "gram").orderBy("_at"))  # a run that comes twice is two
        three = cut(three.withColumn("gram", F.concat("gram", again.cast("string"))).drop("_at"))
        head = cut(_rarest(three, block, F.col("_many")))
        near = head.where("asked").select(block, F.col("key").alias("item"), "gram").join(head.select(block, F.col("key").alias("other"), "gram"), [block, "gram"])
        near = near.where("item <> other").where(may_be_spelt).select(block, "item", "other").distinct().join(out.select(block, "item", "other"), [block, "item", "other"], "left_anti")
        lists = cut(three.groupBy(block, "key").agg(F.collect_list("gram").alias("_g")))
        near = near.join(lists.select(block, F.col("key").alias("item"), F.col("_g").alias("_x")), [block, "item"]).join(lists.select(block, F.col("key").alias("other"), F.col("_g").alias("_y")), [block, "other"])
        near = cut(near.where(F.size(F.array_intersect("_x", "_y")) >= common(F.length("item") + F.length("other"))).select(block, "item", "other"))
        out = out.unionByName(near.where(spelling_ratio(F.col("item"), F.col("other")) >= ratio).withColumn("tier", F.lit("spelling")))
    return met.unionByName(out.groupBy(block, "item", "other").agg(F.min("tier").alias("tier")))  # in the order of the alphabet, as it happens


def unique_facts(df: DataFrame, story: str, source: str, fact: str, resolver: DataFrame | None = None, spelling: bool = True) -> DataFrame:
    """(story, source, fact): facts of a source that no other source of the story states.

    ``resolver`` (surface, canonical; optionally the story) names entities: two facts that resolve to one entity are the same.
    Then facts with equal keys are, then those that ``equal_facts`` finds. Of several entities of one surface the least
    counts. Facts with an empty key are like no other. Facts are returned in the source's own words; nulls are left out.
    """
    f = cut(df.select(story, source, F.col(fact).alias("_f")).where("_f is not null").distinct().withColumn("key", normalize_fact(F.col("_f"))))
    if resolver is not None:
        on = ["key", story] if story in resolver.columns else ["key"]
        names = resolver.select(*[c for c in on if c != "key"], normalize_fact(F.col("surface")).alias("key"), "canonical").where("key <> '' and canonical is not null")
        f = f.join(names.groupBy(*on).agg(F.min("canonical").alias("_c")), on, "left")
        known = f.where("_c is not null").groupBy(story, "_c").agg(F.count_distinct(source).alias("_n")).where("_n > 1").select(story, "_c")
        f = f.join(known.withColumn("_same", F.lit(True)), [story, "_c"], "left").withColumn("_same", F.coalesce("_same", F.lit(False)))
    else:
        f = f.withColumn("_same", F.lit(False))
    of_key = f.groupBy(story, "key").agg(F.min(source).alias("_low"), F.max(source).alias("_high"), F.bool_or(~F.col("_same")).alias("_open"))
    of_key = cut(of_key).withColumn("asked", (F.col("_low") == F.col("_high")) & F.col("_open"))
    alike = equal_facts(of_key.where("key <> ''"), story, spelling=spelling)
    where = of_key.select(story, F.col("key").alias("other"), "_low", "_high")
    mine = of_key.where("asked").select(story, F.col("key").alias("item"), F.col("_low").alias("_own"))
    elsewhere = alike.join(mine, [story, "item"]).join(where, [story, "other"]).where((F.col("_low") != F.col("_own")) | (F.col("_high") != F.col("_own")))
    gone = elsewhere.select(story, F.col("item").alias("key")).distinct()
    lone = of_key.where("_low = _high").select(story, "key")
    left = f.where(~F.col("_same")).join(lone.unionByName(of_key.where("key = ''").select(story, "key")).distinct(), [story, "key"], "left_semi")
    return left.join(gone, [story, "key"], "left_anti").select(story, source, F.col("_f").alias(fact)).distinct()
