"""Lists, feeds and windows that readers and administrators see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(df: DataFrame, owner: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each owner, with their rank."""
    w = Window.partitionBy(owner).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def unclustered(articles: DataFrame, links: DataFrame, key: str, link: str) -> DataFrame:
    return articles.join(links.select(F.col(link).alias(key)), key, "left_anti")


def personal_feed(users: DataFrame, stories: DataFrame, user: str, category: str, order: Sequence[Column | str], k: int, country: str | None = None) -> DataFrame:
    """Best ``k`` stories of each user, with their ``rank``: of the preferred categories and, with ``country``, of the preferred
    countries; where a user prefers none, of all.

    Users have pref_<category> and pref_<country>: a value or an array of them; null and empty prefer none. The best
    stories of each category, of each country, of each two of them and of all are found first, so users only meet those.
    """
    facets = [c for c in (category, country) if c is not None]
    s = stories.select("*", *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(facets)])
    every = None
    for wild in range(1 << len(facets)):
        x = s.withColumns({f"_{i}": F.lit("*") if wild >> i & 1 else F.concat(F.lit("="), f"_{i}") for i in range(len(facets))})
        best = x.where(" and ".join(f"_{i} is not null" for i in range(len(facets)))).withColumn("_rn", F.row_number().over(Window.partitionBy(*[f"_{i}" for i in range(len(facets))]).orderBy(*order))).where(F.col("_rn") <= k)
        every = best if every is None else every.unionByName(best)
    out = users
    for i, c in enumerate(facets):
        have = users.schema[f"pref_{c}"].dataType
        wanted = F.col(f"pref_{c}") if have.typeName() == "array" else F.when(F.col(f"pref_{c}").isNotNull(), F.array(f"pref_{c}"))
        wanted = F.array_compact(F.array_distinct(F.transform(wanted, lambda v: F.concat(F.lit("="), v.cast("string")))))
        out = out.withColumn(f"_{i}", F.explode(F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, wanted).otherwise(F.array(F.lit("*")))))
    met = out.join(every.drop("_rn"), [f"_{i}" for i in range(len(facets))]).drop(*[f"_{i}" for i in range(len(facets))])
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("rank") <= k)


def digests(users: DataFrame, stories: DataFrame, user: str, wanted: str, category: str, order: Sequence[Column | str], most: int = 10) -> DataFrame:
    """Each user's own number of stories: of the preferred category, or the latest of all where it has none."""
    w = Window.partitionBy(category).orderBy(*order)
    best = stories.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    top = stories.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    has = best.select(F.col(category).alias(f"pref_{category}")).distinct().withColumn("_has", F.lit(True))
    u = users.join(has, f"pref_{category}", "left").withColumn("_c", F.when(F.col("_has"), F.col(f"pref_{category}").cast("string")).otherwise("*"))
    every = best.withColumn("_c", F.col(category).cast("string")).unionByName(top.withColumn("_c", F.lit("*")))
    return u.join(every, "_c").where(F.col("rank") <= F.col(wanted)).drop("_c", "_has")


def digests_due(subs: DataFrame, hour: Column, edition: str, at: str, now_hour: int, sunday: bool, defaults: dict[str, int]) -> DataFrame:
    """Subscriptions due this hour; weekly ones on Sundays only."""
    fallback = F.coalesce(*[F.when(F.col(edition) == k, v) for k, v in defaults.items()], F.lit(8))
    due = F.coalesce(F.element_at(F.split(F.col(at), ":"), 1).try_cast("int"), fallback) == now_hour
    return subs.where(due & ((F.col(edition) != "weekly") | F.lit(sunday)))


def entity_timeline(links: DataFrame, stories: DataFrame, entity: str, story: str, when: str, n: int) -> DataFrame:
    """Newest ``n`` stories of each entity."""
    return recent(links.select(entity, story).distinct().join(stories, story), entity, [F.desc(when), F.col(story)], n)


def reading_history(events: DataFrame, stories: DataFrame, user: str, story: str, when: str, now: Column, n: int = 100) -> DataFrame:
    """Last ``n`` views of each user with the story."""
    v = recent(events, user, [F.desc(when), F.desc("event_id")], n)
    return v.join(stories, story, "left").withColumn("is_today", F.to_date(when) == F.to_date(now))


def velocity(df: DataFrame, key: str, ts: str, order: str, seconds: int = 21600) -> DataFrame:
    """Rows of the same key in the last hours before and at each row."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("velocity", F.count(F.lit(1)).over(w))


def worst_attempts(spans: DataFrame, keys: Sequence[str], severity: Column, when: str, key: str) -> DataFrame:
    """The worst row of each stage, the latest where several are as bad."""
    w = Window.partitionBy(*keys).orderBy(severity.desc(), F.desc(when), F.desc(key))
    return spans.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def next_version(versions: DataFrame, story: str, version: str, cost: str) -> DataFrame:
    return versions.groupBy(story).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"), F.round(F.sum(cost), 2).alias("cost"))


def as_of_version(artifacts: DataFrame, story: str, version: str, kind: str, payload: str, kinds: Sequence[str], n: int) -> DataFrame:
    """Each story's artifacts at a version, one column a kind: the last at or before it."""
    a = artifacts.where(F.col(version) <= n)
    return a.groupBy(story).agg(*[F.max_by(F.when(F.col(kind) == k, F.col(payload)), F.when(F.col(kind) == k, F.col(version))).alias(k) for k in kinds])


def export_users(users: DataFrame, user: str, children: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One JSON document a user with all that is kept of them."""
    out = users
    for name, (child, cols) in children.items():
        out = out.join(child.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), user, "left")
    return out.select(user, F.to_json(F.struct(*[F.col(c) for c in out.columns])).alias("document"))


def bookmarked(stories: DataFrame, bookmarks: DataFrame, keys: list[str]) -> DataFrame:
    """Stories that the given users have bookmarked: one row a bookmark."""
    return stories.join(bookmarks.select(*keys).distinct(), keys)
