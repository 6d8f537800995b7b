"""Filters, gates and orders of articles, pages and search results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_set_ratio
from ..functions.vector import jaccard


def publishable(df: DataFrame, headline: str, summary: str, status: str, wanted: str = "active") -> DataFrame:
    """Rows with a real headline and a summary, in the wanted status."""
    return df.where((F.coalesce(headline, F.lit("")) != "") & ~F.startswith(F.col(headline), F.lit("[Mock]")) & (F.coalesce(summary, F.lit("")) != "") & (F.col(status) == wanted))


def facet(stories: DataFrame, categories: DataFrame, key: str, slug: str, wanted: str | None = None, **places: str | None) -> DataFrame:
    """Stories of the category with the wanted slug, and with the wanted values in the columns that ``places`` names (country,
    state, city); what is not wanted is not tested."""
    for column, value in places.items():
        if value is not None:
            stories = stories.where(F.col(column) == value)
    return stories if wanted is None else stories.join(categories.where(F.col(slug) == wanted), key)


def after(df: DataFrame, ts: str, since: Column, zone: str = "UTC") -> DataFrame:
    """Rows at or after ``since``, a wall-clock time in ``zone``."""
    return df.where(F.col(ts) >= F.to_utc_timestamp(since, zone).cast("timestamp_ntz"))


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def keyword_search(df: DataFrame, query: str, cols: Sequence[str], order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """Rows of which a column holds ``query``, whatever the case; % and _ stand for themselves."""
    low = F.lower(F.lit(query))
    hit = reduce(lambda a, c: a | F.coalesce(F.contains(F.lower(F.col(c)), low), F.lit(False)), cols, F.lit(False))
    return page(df.where(hit), order, limit, offset)


def eligible(df: DataFrame, ts: str, now: Column, hours: int = 72, limit: int | None = None, order: Sequence[Column | str] = ()) -> DataFrame:
    out = df.where((F.col(ts) >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= now))
    return out.orderBy(*order).limit(limit) if limit else out


def drop_redirect_hosts(df: DataFrame, url: str, hosts: Sequence[str]) -> DataFrame:
    from ..functions.url import host_of

    h = host_of(F.col(url))
    return df.where(~reduce(lambda a, x: a | (h == x) | F.endswith(h, F.lit("." + x)), hosts, F.lit(False)))


def crawl_tier(host: Column, first: Sequence[str], second: Sequence[str]) -> Column:
    inside = lambda xs: reduce(lambda a, x: a | (host == x) | F.endswith(host, F.lit("." + x)), xs, F.lit(False))
    return F.when(inside(first), 1).when(inside(second), 2).otherwise(3)


def identical_summaries(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    return df.where((F.col(a) == F.col(b)) & (F.col(b) == F.col(c)))


def known_urls(feed: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """``feed`` with whether an article has its key."""
    return feed.join(articles.select(key).distinct().withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def route_domains(policies: DataFrame, attempts: str, local: str, paid: Sequence[str], least: int = 8, local_most: float = 0.05, paid_least: float = 0.20, probe: str | None = None) -> DataFrame:
    """``policies`` with skip_local: enough attempts, no local success to speak of, and a paid provider that works.
    ``probe`` names a key of which a steady 5 % are tried locally nevertheless."""
    skip = (F.col(attempts) >= least) & (F.col(local) < local_most) & (F.greatest(*paid, F.lit(0.0)) > paid_least)
    if probe:
        skip = skip & (F.pmod(F.xxhash64(probe), F.lit(100)) >= 5)
    return policies.withColumn("skip_local", F.coalesce(skip, F.lit(False)))


def check_embedding_space(vecs: DataFrame, model: Column, vec: str) -> DataFrame:
    """(model, dims, n): more than one row means that vectors must not be compared."""
    return vecs.groupBy(model.alias("model"), F.size(vec).alias("dims")).agg(F.count(F.lit(1)).alias("n"))


def list_failures(df: DataFrame, filters: dict[str, object], order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page of the rows that meet the given filters, each with the number of all of them."""
    out = reduce(lambda x, kv: x.where(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), ((k, v) for k, v in filters.items() if v is not None), df)
    total = out.agg(F.count(F.lit(1)).alias("total"))
    return page(out, order, limit, offset).join(F.broadcast(total))  # one row


def entities_by_rule(df: DataFrame, id_col: str, text: str, states: Sequence[str], agreements: Sequence[str], org_words: Sequence[str], party_words: Sequence[str]) -> DataFrame:
    """(id, value, kind, confidence) of runs of capitalised words; a single word is none unless a list names it."""
    v = df.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0)))).alias("value")).where(F.length("value") >= 3)
    low, n = F.lower("value"), F.size(F.split("value", r"\s+"))
    any_of = lambda ws: reduce(lambda a, w: a | F.contains(low, F.lit(w)), ws, F.lit(False))
    names = lambda xs: low.isin(*[x.lower() for x in xs])
    kind = (F.when(names(states), "STATE").when(names(agreements), "AGREEMENT").when(any_of(org_words), "ORG").when(any_of(party_words), "POLITICAL_PARTY").when(n >= 3, "ORG").when(n == 2, "PERSON"))
    sure = F.when(names(states), 0.7).when(names(agreements) | any_of(org_words), 0.6).when(any_of(party_words), 0.5).otherwise(0.3)
    return v.withColumn("kind", kind).withColumn("confidence", sure).where(F.col("kind").isNotNull())


def normalize_entities(df: DataFrame, id_col: str, states: Sequence[str], agreements: Sequence[str]) -> DataFrame:
    """Trimmed names of two characters or more, one a lower-case name (the first by value), kinds overridden by the lists."""
    x = df.withColumn("value", F.trim("value")).where(F.length("value") >= 2).withColumn("_l", F.lower("value"))
    x = x.groupBy(id_col, "_l").agg(F.min_by(F.struct("value", "kind", "confidence"), "value").alias("e")).select(id_col, "_l", "e.*")
    kind = F.when(F.col("_l").isin(*states), "STATE").when(F.col("_l").isin(*agreements), "AGREEMENT").otherwise(F.col("kind"))
    return x.select(id_col, "value", kind.alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"))


def search_docs(stories: DataFrame, tags: DataFrame, key: str, tag: str) -> DataFrame:
    """One flat JSON document a story, with its distinct tags in order."""
    t = tags.groupBy(key).agg(F.array_sort(F.collect_set(tag)).alias("tags"))
    return stories.join(t, key, "left").select(key, F.to_json(F.struct(*[F.col(c) for c in stories.columns], F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))).alias("document"))


def diverse_topk(df: DataFrame, domain: str, score: Sequence[str], key: str, k: int) -> DataFrame:
    """The best row of each domain (rows without one all stay), and of these the best ``k``."""
    order = [*[F.desc(s) for s in score], F.col(key)]
    w = Window.partitionBy(domain).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") == 1) | (F.coalesce(domain, F.lit("")) == "")).drop("_rn").orderBy(*order).limit(k)


def rank_results(results: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Best ``k`` results a seed by 40 word Jaccard + 40 token-set ratio + 20, of results that share a rare word with it."""
    toks = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) > 8))
    s = seeds.select("item_id", "seed", toks(F.col("seed")).alias("sw"))
    r = results.select("doc_id", "title", toks(F.col("title")).alias("rw"))
    pairs = s.select("item_id", F.explode("sw").alias("w")).join(r.select("doc_id", F.explode("rw").alias("w")), "w").select("item_id", "doc_id").distinct()
    x = pairs.join(s, "item_id").join(r, "doc_id").withColumn("j", jaccard(F.col("sw"), F.col("rw")))
    x = x.withColumn("score", F.round(40 * F.col("j") + 0.4 * token_set_ratio(F.lower(F.col("seed")), F.lower(F.col("title"))), 4))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "doc_id", "score", "rank")


def crawl_order(df: DataFrame, tier: str, host: str, key: str) -> DataFrame:
    """Turn of each URL within its host and the host's place: sorted by tier, turn, place, hosts take turns in each tier."""
    w = Window.partitionBy(tier, host)
    return df.withColumn("turn", F.row_number().over(w.orderBy(key))).withColumn("place", F.min(key).over(w)).orderBy(tier, "turn", "place")


def inject_seeds(found: DataFrame, seeds: DataFrame, host: str) -> DataFrame:
    """Found rows, and seeds whose host was not found."""
    extra = seeds.join(found.select(host).distinct(), host, "left_anti").select(*found.columns)
    return found.withColumn("seed", F.lit(False)).unionByName(extra.withColumn("seed", F.lit(True)))


def news_sitemap(stories: DataFrame, key: str, title: str, ts: str, now: Column, limit: int = 100) -> DataFrame:
    """The newest stories of the last two days."""
    return stories.where(F.col(ts) >= now - F.expr("INTERVAL 48 HOURS")).orderBy(F.desc(ts), key).limit(limit)


def evaluate(outputs: DataFrame, scenarios: DataFrame, key: str, least: float = 80.0) -> DataFrame:
    """How outputs meet their scenarios: keywords and category in per cent, less 20 for each forbidden word."""
    x = outputs.join(scenarios, key).withColumn("_t", F.lower("text"))
    kw = 100.0 * F.size(F.filter("keywords", lambda w: F.contains(F.col("_t"), w))) / F.size("keywords")
    cat = F.when(F.col("category") == F.col("want"), 100.0).otherwise(0.0)
    bad = F.size(F.filter("forbidden", lambda w: F.contains(F.col("_t"), w)))
    s = x.select(F.greatest(F.lit(0.0), (kw + cat) / 2 - 20 * bad).alias("score"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= least).alias("passed"), F.round(F.avg("score"), 6).alias("mean_score"))


def top_story(stories: DataFrame, members: DataFrame, story: str, source: str, created: str, now: Column, hours: int = 6, sources: int = 3) -> DataFrame:
    """``stories`` with ``top_story``: created at most ``hours`` before ``now`` and told by ``sources`` or more."""
    n = members.groupBy(story).agg(F.count_distinct(source).alias("_n"))
    young = F.col(created) >= now - F.expr(f"INTERVAL {hours} HOURS")
    return stories.join(n, story, "left").withColumn("top_story", young & (F.coalesce("_n", F.lit(0)) >= sources)).drop("_n")
