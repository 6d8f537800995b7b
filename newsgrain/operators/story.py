"""Stories: cards, cohesion, centroids, timelines, graph tables and nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, dot


def story_cards(stories: DataFrame, members: DataFrame, sources: DataFrame, story: str, source: str, logo: str, logos: int = 5) -> DataFrame:
    """Article count, distinct sources and the first few logos of each story."""
    m = members.join(sources, source)
    c = m.groupBy(story).agg(F.count(F.lit(1)).alias("articles"), F.count_distinct(source).alias("sources"), F.slice(F.array_sort(F.collect_set(logo)), 1, logos).alias("logos"))
    return stories.join(c, story, "left").select(*stories.columns, F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("sources", F.lit(0)).alias("sources"), "logos")


def centroid(members: DataFrame, story: str, vec: str) -> DataFrame:
    """Mean vector of a story, of length one; null where the mean is zero. Sums are taken by position, not by gathering vectors."""
    p = members.select(story, F.posexplode(vec).alias("pos", "x")).groupBy(story, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = p.groupBy(story).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("v"))
    n = F.sqrt(dot(F.col("v"), F.col("v")))
    return v.select(story, F.when(n > 0, F.transform("v", lambda e: e / n)).alias("centroid"))


def cohesion(members: DataFrame, story: str, key: str, vec: str) -> DataFrame:
    """Mean and least pairwise cosine within a story; 1 where it has one member.

    The mean of unit vectors follows from the sum of vectors; only the least needs the pairs within a story.
    """
    a, b = members.select(story, F.col(key).alias("_a"), F.col(vec).alias("_x")), members.select(story, F.col(key).alias("_b"), F.col(vec).alias("_y"))
    least = a.join(b, story).where("_a < _b").groupBy(story).agg(F.min(cosine(F.col("_x"), F.col("_y"))).alias("least"))
    n = members.groupBy(story).agg(F.count(F.lit(1)).alias("n"))
    s = (members.select(story, F.posexplode(vec).alias("pos", "x")).groupBy(story, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
         .groupBy(story).agg(F.sum(F.col("x") * F.col("x")).alias("sq")))
    out = n.join(s, story).join(least, story, "left")
    return out.select(story, "n", F.when(F.col("n") > 1, (F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("mean_cosine"), F.coalesce("least", F.lit(1.0)).alias("least_cosine"))


def facts_by_source(df: DataFrame, story: str, source: str, fact: str, number: str, order: str) -> DataFrame:
    """Set of facts and first number of each source in a story."""
    return df.groupBy(story, source).agg(F.array_sort(F.collect_set(fact)).alias("facts"), F.min_by(number, order).alias("first_number"))


def timeline(events: DataFrame, story: str, when: Column, entry: Column, key: str) -> DataFrame:
    """Entries of a story's events in order of time."""
    e = events.select(story, F.struct(when.alias("at"), F.col(key).alias("key"), entry.alias("entry")).alias("e"))
    return e.groupBy(story).agg(F.array_sort(F.collect_list("e")).alias("timeline"))


def seed_anchor(members: DataFrame, entities: DataFrame, story: str, title: str, when: str, entity: str, most: int = 25) -> DataFrame:
    """Newest member's title as headline, and up to ``most`` entities."""
    head = members.groupBy(story).agg(F.max_by(title, when).alias("headline"))
    w = Window.partitionBy(story).orderBy(entity)
    e = entities.select(story, entity).distinct().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).groupBy(story).agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    return head.join(e, story, "left")


def story_tags(groups: DataFrame, existing: DataFrame, story: str, name: str, tag: str, most: int = 5, longest: int = 30) -> DataFrame:
    """New tags of a story: short representative names that it has not, as many as are missing to ``most``."""
    have = existing.groupBy(story).agg(F.count(F.lit(1)).alias("_have"))
    n = groups.select(story, F.lower(name).alias(tag)).where(F.length(tag) < longest).distinct().join(existing.select(story, tag), [story, tag], "left_anti").join(have, story, "left")
    w = Window.partitionBy(story).orderBy(tag)
    return n.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most - F.coalesce("_have", F.lit(0))).select(story, tag)


def time_conflict(events: DataFrame, story: str, raw: Column) -> DataFrame:
    """Whether a story's events name more than one time."""
    return events.groupBy(story).agg((F.count_distinct(F.when(F.trim(raw) != "", F.trim(raw))) > 1).alias("conflict"))


def story_detail(stories: DataFrame, story: str, children: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """A row a story with each child table nested as a sorted array; children are gathered before they are joined."""
    out = stories
    for name, (child, cols) in children.items():
        n = child.groupBy(story).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(n, story, "left")
    return out


def article_lineage(articles: DataFrame, article: str, story: str, own: dict[str, tuple[DataFrame, Sequence[str]]], of_story: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """A row an article with its own spans, and the spans and calls of the story it is in, each a sorted array."""
    return story_detail(story_detail(articles, article, own), story, of_story)


def story_inspector(stories: DataFrame, story: str, children: dict[str, tuple[DataFrame, str, str]], costs: dict[str, str], latest: int = 3) -> DataFrame:
    """Stories with the keys of the latest rows of each child table (table, time, key), newest first, and the sum of the costs
    (child to column) of all of them."""
    out = stories
    total = F.lit(0.0)
    for name, (child, when, key) in children.items():
        w = Window.partitionBy(story).orderBy(F.desc(when), F.desc(key))
        last = child.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= latest).groupBy(story).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", key))), lambda x: x[key]).alias(f"latest_{name}"))
        out = out.join(last, story, "left")
        if name in costs:
            out = out.join(child.groupBy(story).agg(F.sum(costs[name]).alias(f"_cost_{name}")), story, "left")
            total = total + F.coalesce(f"_cost_{name}", F.lit(0.0))
    return out.withColumn("cost", F.round(total, 2)).drop(*[f"_cost_{n}" for n in costs])
