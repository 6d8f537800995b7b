"""Scores of articles, pairs and stories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import topic_skipped
from ..functions.text import proper_nouns
from ..functions.vector import cosine, jaccard

# Weights of the discovery score, trusted publishers in the order in which they are tried, and of the pair score.
DISCOVERY = {"freshness": 0.20, "trust": 0.30, "entities": 0.30, "content": 0.20}
DISCOVERY_THRESHOLD, METADATA_THRESHOLD = 0.50, 0.25
TRUSTED = {
    "reuters": 1.0, "apnews": 1.0, "associated press": 1.0, "bbc": 0.95, "guardian": 0.9, "cnn": 0.9, "bloomberg": 0.95, "nytimes": 0.9, "new york times": 0.9,
    "washington post": 0.9, "independent": 0.8, "techcrunch": 0.8, "the verge": 0.8,
}
PAIR = {"embedding": 0.45, "event": 0.25, "entity": 0.15, "temporal": 0.10, "source": 0.05}
EVENT = {"actors": 0.25, "targets": 0.20, "place": 0.20, "kind": 0.15, "date": 0.10}
DECAY = 0.1155


def trust_weight(source: Column, trusted: Mapping[str, float] = TRUSTED) -> Column:
    """Weight of the first publisher key that the source's name holds, else 0."""
    name = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return reduce(lambda rest, kv: F.when(F.contains(name, F.lit(kv[0])), kv[1]).otherwise(rest), reversed(list(trusted.items())), F.lit(0.0))


def _fresh(pub: Column, now: Column) -> tuple[Column, Column]:
    hours = F.timestamp_diff("SECOND", pub, now) / 3600.0
    return hours, F.when(pub.isNull(), 0.25).otherwise(F.greatest(F.lit(0.0), 1.0 - hours / 24.0))


def discovery_score(title: Column, content: Column, pub: Column, source: Column, now: Column, trusted: Mapping[str, float] = TRUSTED) -> Column:
    """0..1 by freshness, trust, names and length; -1 for skipped topics, stale or short articles; 0 without a title."""
    hours, fresh = _fresh(pub, now)
    n = F.length(F.coalesce(content, F.lit("")))
    score = (DISCOVERY["freshness"] * fresh + DISCOVERY["trust"] * trust_weight(source, trusted) + DISCOVERY["entities"] * F.least(F.lit(1.0), proper_nouns(title) / 4.0)
             + DISCOVERY["content"] * F.least(F.lit(1.0), (n - 300) / 700.0))
    return F.when(F.coalesce(title, F.lit("")) == "", 0.0).when(topic_skipped(title) | (hours > 24) | (n < 300), -1.0).otherwise(score)


def metadata_score(title: Column, pub: Column, source: Column, now: Column, trusted: Mapping[str, float] = TRUSTED) -> Column:
    """As the discovery score, of what a feed entry tells: the content's weight goes to the others."""
    hours, fresh = _fresh(pub, now)
    k = 1 / (1 - DISCOVERY["content"])
    score = k * (DISCOVERY["freshness"] * fresh + DISCOVERY["trust"] * trust_weight(source, trusted) + DISCOVERY["entities"] * F.least(F.lit(1.0), proper_nouns(title) / 4.0))
    return F.when(F.coalesce(title, F.lit("")) == "", 0.0).when(topic_skipped(title) | (hours > 24), -1.0).otherwise(score)


def prioritize(score: Column, entities: Column, threshold: float = DISCOVERY_THRESHOLD) -> tuple[Column, Column]:
    """Whether an article has priority, and why not."""
    reason = F.when(score < 0, "rejected").when(score >= threshold, "").when(entities < 2, "low_entity_count").otherwise(F.concat(F.lit("low_discovery_score_"), F.floor(score * 100).cast("string")))
    return (score >= 0) & (score >= threshold), reason


def pair_score(cos: Column, events_a: Column, events_b: Column, entities_a: Column, entities_b: Column, same_source: Column, temporal: Column | None = None) -> Column:
    """Weighted likeness of two articles; the temporal part is constant unless a column is given."""
    t = F.lit(0.95) if temporal is None else temporal
    return (PAIR["embedding"] * cos + PAIR["event"] * jaccard(events_a, events_b) + PAIR["entity"] * jaccard(entities_a, entities_b) + PAIR["temporal"] * t
            + PAIR["source"] * F.when(same_source, 0.8).otherwise(1.0))


def event_similarity(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """0..0.9 likeness of two events with keys kind, parent, actors, targets, location, date."""
    sim = lambda x, y: F.when((F.coalesce(F.size(x), F.lit(0)) > 0) & (F.coalesce(F.size(y), F.lit(0)) > 0), jaccard(x, y)).otherwise(0.0)
    la, lb = F.lower(F.trim(a["location"])), F.lower(F.trim(b["location"]))
    place = F.when((F.coalesce(la, F.lit("")) == "") | (F.coalesce(lb, F.lit("")) == ""), 0.5).when(la == lb, 1.0).when(F.contains(la, lb) | F.contains(lb, la), 0.8).otherwise(0.0)
    kind = F.when(a["kind"] == b["kind"], 1.0).when(a["parent"] == b["parent"], 0.5).otherwise(0.0)
    day = F.when(a["date"].isNull() | b["date"].isNull(), 0.5).when(a["date"] == b["date"], 1.0).otherwise(0.0)
    return EVENT["actors"] * sim(a["actors"], b["actors"]) + EVENT["targets"] * sim(a["targets"], b["targets"]) + EVENT["place"] * place + EVENT["kind"] * kind + EVENT["date"] * day


def stage_a(entities: Column, story_entities: Column, locations: Column, hours: Column, title_jaccard: Column, tier: Column | None = None) -> tuple[Column, Column]:
    """Score 0..100 of an article against a story before vectors, and PASS (60), MAYBE (45) or FAIL."""
    n = lambda x: F.coalesce(F.size(x), F.lit(0))
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.least(n(x), n(y))
    ent = F.when((n(entities) == 0) | (n(story_entities) == 0), 17.5).otherwise(35 * share(entities, story_entities))
    loc = F.when(n(locations) == 0, 10.0).when(n(entities) == 0, 0.0).otherwise(20 * share(entities, locations))
    when = F.when(F.abs(hours) <= 24, 15.0).when(F.abs(hours) <= 72, 7.5).otherwise(0.0)
    t = F.lit(5) if tier is None else tier
    score = ent + loc + when + 20 * title_jaccard + 10 * F.greatest(F.lit(0.0), 1.0 - (t - 1) * 0.2)
    return score, F.when(score >= 60, "PASS").when(score >= 45, "MAYBE").otherwise("FAIL")


def stage_b(cos: Column, shared: Column) -> Column:
    """PASS, MAYBE or FAIL by cosine and shared canonical entities."""
    return F.when((cos >= 0.72) | (shared >= 2), "PASS").when((cos >= 0.67) | (shared >= 1), "MAYBE").otherwise("FAIL")


def trending_score(sources: Column, hours: Column, views: Column, bookmarks: Column, shares: Column) -> Column:
    return 0.40 * F.least(sources / 5.0, F.lit(1.0)) + 0.35 * F.exp(-DECAY * hours) + 0.25 * F.least((views + 3 * bookmarks + 5 * shares) / 500.0, F.lit(1.0))


def trending_rank(sources: Column, hours: Column, recent: Column) -> Column:
    return 0.35 * F.least(F.log(1 + sources) / F.log(F.lit(6.0)), F.lit(1.2)) + 0.35 * F.exp(-DECAY * F.greatest(hours, F.lit(0.0))) + 0.30 * F.least(recent / 5.0, F.lit(1.0))


def _transitions(articles: Column, confidence: Column, sources: Column, contradiction: Column, idle_h: Column, undiscovered_h: Column) -> list[tuple[str, str, Column, Column]]:
    """(from, to, condition, reason) of each transition."""
    n = lambda c, places: F.format_string(f"%.{places}f", F.bround(c.cast("double"), places))
    quiet = F.concat(F.lit("Inactivity "), n(idle_h, 1), F.lit("h, Conf "), n(confidence, 2), F.lit(", Sources "), sources.cast("string"), F.lit(", Contradiction "), n(contradiction, 2))
    return [
        ("emerging", "developing", articles >= 3, F.concat(F.lit("Articles count ("), articles.cast("string"), F.lit(") met threshold (3)"))),
        ("developing", "monitoring", (confidence >= 0.8) & (idle_h >= 6) & (sources >= 3) & (contradiction <= 0.2), quiet),
        ("monitoring", "stable", (confidence >= 0.95) & (idle_h >= 24) & (sources >= 5) & (contradiction <= 0.1), quiet),
        ("stable", "archived", (idle_h >= 168) & (undiscovered_h >= 168), F.concat(F.lit("No updates for "), n(idle_h, 1), F.lit("h, no discovery for "), n(undiscovered_h, 1), F.lit("h"))),
    ]


def lifecycle(state: Column, *signals: Column) -> Column:
    """Next state of a story, by ``signals``: articles, confidence, sources, contradiction, idle hours and hours without
    discovery. Each state has one next state; archived stays archived."""
    out = F.when(state == "archived", "archived")
    for old, new, met, _ in _transitions(*signals):
        out = out.when((state == old) & met, new)
    return out.otherwise(state)


def lifecycle_reason(state: Column, *signals: Column) -> Column:
    """Why ``lifecycle`` decides as it does."""
    out = F.when(state == "archived", "Story is already archived.")
    for old, _, met, why in _transitions(*signals):
        out = out.when((state == old) & met, why)
    return out.otherwise("No thresholds met.")


def hhi(df: DataFrame, group: str, source: str) -> DataFrame:
    """Concentration of sources in a group: the sum of squared shares of its rows."""
    n = df.groupBy(group, source).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(group).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"))


def quality_gate(hhi_: Column, min_cosine: Column, missing: Column, fingerprints: Column, high_stakes: Column, contradictions: Column) -> tuple[Column, Column]:
    """Score of a story's summary and what to do with it."""
    score = (1.0 - F.when(hhi_ > 0.6, 0.15).otherwise(0.0) - F.when(min_cosine < 0.65, 0.15).otherwise(0.0) - F.when(missing > 3, 0.15).otherwise(0.0) - F.when(fingerprints > 1, 0.10).otherwise(0.0))
    return score, F.when((F.round(score, 6) < 0.85) | high_stakes | (contradictions > 0), "needs_review").otherwise("publish")


def missing_entities(nodes: DataFrame, texts: DataFrame, key: str, label: str, text: str) -> DataFrame:
    """Labels of over two characters that their story's text does not hold: (key, label)."""
    low = nodes.where(F.length(label) > 2).withColumn("_l", F.lower(label))
    texts = texts.select(key, F.lower(text).alias("_t"))  # once a text, not once a label it meets
    return low.join(texts, key).where(~F.contains("_t", "_l")).select(key, label)


def numbers_conflict(a: Column, b: Column) -> Column:
    """Over 10 % and over 1 apart; what is no number is compared as text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    both = x.isNotNull() & y.isNotNull()
    gap = F.abs(x - y)
    return F.when(both, (gap > 1) & (gap / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9)) > 0.1)).otherwise(F.lower(F.trim(a)) != F.lower(F.trim(b)))


def canonical_event_type(raw: Column, known: Sequence[str], synonyms: Sequence[tuple[str, str]]) -> Column:
    """Upper-case type if known; else the synonym's, exact or partial (first in order, either way round); else itself.

    The maps are short lists given by the user and become literals.
    """
    up = F.regexp_replace(F.upper(F.trim(raw)), "[ -]", "_")
    low = F.lower(F.trim(raw))
    partial = reduce(lambda rest, kv: F.when(F.contains(low, F.lit(kv[0])) | F.contains(F.lit(kv[0]), low), kv[1]).otherwise(rest), reversed(synonyms), up)
    exact = reduce(lambda rest, kv: F.when(low == kv[0], kv[1]).otherwise(rest), reversed(synonyms), partial)
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "OTHER").when(up.isin(*known), up).otherwise(exact)


def token_cost(calls: DataFrame, prices: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Cost of calls; a model without a price has a null cost, never 0."""
    c = calls.join(prices, model, "left")
    return c.withColumn("cost", F.round(F.col(tokens_in) / 1e6 * F.col("price_in") + F.col(tokens_out) / 1e6 * F.col("price_out"), 8))


def budget_flags(costs: DataFrame, limits: DataFrame, category: str, cost: str, steps: Mapping[str, float]) -> DataFrame:
    """Spending of categories against their limits, and which steps are skipped from which share on."""
    x = costs.groupBy(category).agg(F.sum(cost).alias("spent")).join(limits, category)
    share = F.col("spent") / F.col("budget")
    return x.select(category, F.round("spent", 2).alias("spent"), "budget", F.round(share, 6).alias("share"), *[(share >= v).alias(f"skip_{k}") for k, v in steps.items()])


def link_confidence(ambiguous: Column, has_keyword: Column, hits: Column, rival: Column) -> Column:
    """Confidence of an entity link, 0..1; ``has_keyword`` is null where the type has no keywords."""
    c = (F.when(ambiguous, 0.5).otherwise(0.8) + F.when(has_keyword, 0.2).when(~has_keyword, -0.3).otherwise(0.0) + F.when(hits == 1, 0.1).otherwise(0.0)
         - F.when((hits > 1) & rival, 0.3).otherwise(0.0))
    return F.when(hits == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 2))


def needs_reflection(over_budget: Column, high_stakes: Column, conflict_confidence: Column, divergent: Column, age_h: Column, sources: Column, articles: Column) -> Column:
    """Why a story needs a second look, by the first signal in order; null if it needs none."""
    return (F.when(over_budget, F.lit(None).cast("string")).when(high_stakes, "high_stakes").when(conflict_confidence >= 0.8, "contradiction").when(divergent >= 2, "divergent_sources")
            .when((age_h < 2) & (sources >= 3), "breaking").when(articles >= 5, "large_story"))


def similar_pairs(a: DataFrame, b: DataFrame, least: float, id_col: str = "vec_id", vec: str = "embedding", block: str = "day") -> DataFrame:
    """Pairs (a_id, b_id, cosine) with cosine at least ``least`` of two vector sets, within a block of both; blocks must
    be small by the way they are chosen. For pairs of a whole table see ``clustering.nearby``."""
    x, y = a.select(block, F.col(id_col).alias("a_id"), F.col(vec).alias("_x")), b.select(block, F.col(id_col).alias("b_id"), F.col(vec).alias("_y"))
    return x.join(y, block).where(F.col("a_id") < F.col("b_id")).select("a_id", "b_id", cosine(F.col("_x"), F.col("_y")).alias("cosine")).where(F.col("cosine") >= least)


def parent_type(types: DataFrame, taxonomy: DataFrame, kind: str, parent: str, default: str = "OTHER") -> DataFrame:
    """``types`` with the parent that the ``taxonomy`` (kind, parent) gives them, or ``default``."""
    return types.join(taxonomy.select(kind, parent), kind, "left").withColumn(parent, F.coalesce(parent, F.lit(default)))
