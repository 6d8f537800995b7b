"""What sources say against each other, identity of names, merges and run comparison."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import equal_keys, normalize_fact

# Titles of persons, and words that organisations' names may differ in.
HONORIFICS = ("mr", "ms", "mrs", "dr", "prof", "president", "minister", "pm", "chief", "leader")
SUFFIXES = ("corp", "corporation", "inc", "incorporated", "ltd", "limited", "co", "company", "group", "association", "university", "college", "institute")
SMALL_WORDS = ("of", "the", "and", "for", "in")


def _extremes(events: DataFrame, story: str, source: str, values: Mapping[str, Column], when: str, number: str) -> DataFrame:
    """Least and largest value of everything compared, by story and source.

    Events are dealt by story before they are summed up: a story has few events of a source, so sums before the shuffle would
    sort whole files to save nothing, and all that follows finds its story where it is.
    """
    cols = {f"v_{k}": c for k, c in values.items()} | {"t": F.col(when), "n": F.col(number)}
    rows = events.select(story, F.col(source).alias("s"), *[c.alias(n) for n, c in cols.items()]).repartition(story)
    return rows.groupBy(story, "s").agg(*[f(k).alias(f"{n}_{k}") for k in cols for n, f in (("lo", F.min), ("hi", F.max))])


def _pairs(left: DataFrame, right: DataFrame, story: str, values: Mapping[str, Column], on: Column) -> DataFrame:
    """Conflicts between two sources of a story, told by their extremes: some two values differ unless all are one; the
    widest gap of times or numbers lies between one's least and the other's largest."""
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    apart = lambda p, q: (F.abs(p - q) > 1) & (F.abs(p - q) / F.greatest(F.abs(p), F.abs(q), F.lit(1e-9)) > 0.1)
    kinds = [F.when((x(f"lo_v_{k}") != y(f"hi_v_{k}")) | (x(f"hi_v_{k}") != y(f"lo_v_{k}")), k) for k in values]
    kinds.append(F.when(F.greatest(F.datediff(x("hi_t"), y("lo_t")), F.datediff(y("hi_t"), x("lo_t"))) > 1, "time"))
    kinds.append(F.when(apart(x("lo_n"), y("hi_n")) | apart(x("hi_n"), y("lo_n")), "number"))
    pairs = left.alias("a").join(right.alias("b"), (F.col(f"a.{story}") == F.col(f"b.{story}")) & on)
    return (pairs.select(F.col(f"a.{story}").alias(story), F.least("a.s", "b.s").alias("source_a"), F.greatest("a.s", "b.s").alias("source_b"), F.explode(F.array_compact(F.array(*kinds))).alias("kind")))


def contradictions(events: DataFrame, story: str, source: str, values: Mapping[str, Column], when: str, number: str) -> DataFrame:
    """Conflicts (story, source_a, source_b, kind) between events of different sources in a story: differing values,
    times over a day apart, numbers over 10 % and 1 apart. What is null conflicts with nothing. Events are summed up by
    source first, so pairs are of sources, never of events."""
    x = _extremes(events, story, source, values, when, number)
    return _pairs(x, x, story, values, F.col("a.s") < F.col("b.s"))


def contradictions_incremental(new: DataFrame, existing: DataFrame, known: DataFrame, story: str, source: str, values: Mapping[str, Column], when: str, number: str) -> DataFrame:
    """Conflicts of new events with existing ones of other sources that are not known yet, whichever way round."""
    a, b = (_extremes(x, story, source, values, when, number) for x in (new, existing))
    return _pairs(a, b, story, values, F.col("a.s") != F.col("b.s")).distinct().join(known, [story, "source_a", "source_b", "kind"], "left_anti")


def build_resolver(surfaces: DataFrame, canonical: DataFrame, id_col: str) -> DataFrame:
    """(key, id): normalised surface forms, then canonical names, then aliases; the first mapping of a key wins.

    ``surfaces``: surface, id, order; ``canonical``: the id column, name, aliases.
    """
    rows = (surfaces.select(normalize_fact(F.col("surface")).alias("key"), "id", F.lit(0).alias("r"), F.col("order").cast("long").alias("o"))
            .unionByName(canonical.select(normalize_fact(F.col("name")).alias("key"), F.col(id_col).alias("id"), F.lit(1).alias("r"), F.lit(0).cast("long").alias("o")))
            .unionByName(canonical.select(F.explode("aliases").alias("x"), F.col(id_col).alias("id")).select(normalize_fact(F.col("x")).alias("key"), "id", F.lit(2).alias("r"), F.lit(0).cast("long").alias("o"))))
    return rows.where("key <> ''").groupBy("key").agg(F.min_by("id", F.struct("r", "o", "id")).alias("id"))


def link_entities(mentions: DataFrame, canonical: DataFrame, mention: str, name: str, id_col: str) -> DataFrame:
    """Mentions with the entity of that name, whatever its case; without one they need review."""
    c = canonical.select(F.lower(F.trim(name)).alias("_k"), F.col(id_col)).groupBy("_k").agg(F.min(id_col).alias(id_col))
    out = mentions.withColumn("_k", F.lower(F.trim(mention))).join(c, "_k", "left").drop("_k")
    return out.withColumn("status", F.when(F.col(id_col).isNotNull(), "linked").otherwise("needs_review"))


def resolve_sources(refs: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    """A reference's source by name, else slug, else domain (its own host or a parent of it), else new.

    Hosts are matched by equality with each of their suffixes, not by searching one string in the other.
    """
    n, s, dm = (sources.select(F.lower(F.col(c)).alias(f"_{c}"), F.col("source_id").alias(f"_{c}_id")) for c in ("name", "slug", "domain"))
    x = refs.withColumn("_k", F.lower(F.col(name)))
    parts = F.split("_k", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = x.select("_k").distinct()
    by_domain = keys.select("_k", F.explode(suffixes).alias("_domain")).join(dm, "_domain").groupBy("_k").agg(F.max_by("_domain_id", F.length("_domain")).alias("_domain_id"))
    x = x.join(n, F.col("_k") == F.col("_name"), "left").join(s, F.col("_k") == F.col("_slug"), "left").join(by_domain, "_k", "left")
    how = F.when(F.col("_name_id").isNotNull(), "name").when(F.col("_slug_id").isNotNull(), "slug").when(F.col("_domain_id").isNotNull(), "domain").otherwise("new")
    return x.select(*refs.columns, F.coalesce("_name_id", "_slug_id", "_domain_id").alias("source_id"), how.alias("how"))


def baseline_run(runs: DataFrame, key: str, kind: str, start: str, hours: int = 24, span: int = 7 * 86_400) -> DataFrame:
    """The run of the same kind nearest to ``hours`` before each run, by ordered passes instead of a pair join.

    Targets and runs are put in one order of time; the nearest runs before and after a target are the last and first
    ones seen there, of which two each are kept in case one is the run itself. The order is cut into spans of ``span``
    seconds, so no kind is ordered in one task; what lies beyond a span comes from a table with a row a span.
    """
    t = F.unix_seconds(F.col(start).cast("timestamp"))
    ids = f"array<{runs.schema[key].dataType.simpleString()}>"
    at = lambda c: F.floor(c / span).alias("_b")
    run = lambda: F.struct(F.col("_t").alias("t"), F.col("_ids").alias("ids"))
    times = runs.groupBy(F.col(kind).alias("_kind"), t.alias("_t")).agg(F.slice(F.array_sort(F.collect_set(key)), 1, 2).alias("_ids"))
    times = times.select("_kind", "_t", at(F.col("_t")), run().alias("_r"))
    asked = runs.select(F.col(kind).alias("_kind"), (t - hours * 3600).alias("_t"), F.col(key).alias("_q"))
    both = times.withColumn("_q", F.lit(None).cast(runs.schema[key].dataType)).unionByName(asked.select("_kind", "_t", at(F.col("_t")), F.lit(None).cast(f"struct<t:bigint,ids:{ids}>").alias("_r"), "_q"))
    spans = both.groupBy("_kind", "_b").agg(F.max("_r").alias("hi"), F.min("_r").alias("lo"))
    w = Window.partitionBy("_kind").orderBy("_b")
    spans = spans.select("_kind", "_b", F.last("hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"), F.first("lo", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_right"))
    inside = Window.partitionBy("_kind", "_b").orderBy("_t")
    back, fore = inside.rangeBetween(Window.unboundedPreceding, 0), inside.rangeBetween(0, Window.unboundedFollowing)
    x = both.withColumn("_l", F.last("_r", ignorenulls=True).over(back)).withColumn("_f", F.first("_r", ignorenulls=True).over(fore)).where("_q is not null")
    x = x.join(spans, ["_kind", "_b"]).select("_kind", "_q", "_t", F.coalesce("_l", "_left").alias("_l"), F.coalesce("_f", "_right").alias("_f"))
    # the second nearest is the neighbour of the nearest among the runs themselves
    chain = times.withColumn("_p", F.lag("_r").over(inside)).withColumn("_n", F.lead("_r").over(inside)).join(spans, ["_kind", "_b"])
    chain = chain.select("_kind", F.col("_t").alias("_at"), F.coalesce("_p", "_left").alias("_p"), F.coalesce("_n", "_right").alias("_n"))
    prior = chain.select(F.col("_kind").alias("_kind1"), F.col("_at").alias("_la"), F.col("_p").alias("_before"))
    x = x.join(prior, (F.col("_kind") == F.col("_kind1")) & (F.col("_l.t") == F.col("_la")), "left")
    after = chain.select(F.col("_kind").alias("_kind2"), F.col("_at").alias("_fa"), F.col("_n").alias("_after"))
    x = x.join(after, (F.col("_kind") == F.col("_kind2")) & (F.col("_f.t") == F.col("_fa")), "left")
    c = x.select("_q", "_t", F.explode(F.array("_l", "_f", "_before", "_after")).alias("c")).where("c is not null").select("_q", "_t", "c.t", F.explode("c.ids").alias("id")).where("id <> _q")
    return c.groupBy(F.col("_q").alias(key)).agg(F.min_by("id", F.struct(F.abs(F.col("t") - F.col("_t")), F.col("id"))).alias("baseline"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, metrics: Mapping[str, Column]) -> DataFrame:
    """Difference and per cent of each metric by key; per cent is 0 where the base is 0."""
    x, y = (df.groupBy(key).agg(*[m.alias(f"{p}_{n}") for n, m in metrics.items()]) for df, p in ((a, "a"), (b, "b")))
    z = x.join(y, key, "full_outer").na.fill(0.0)
    out = [F.col(key)]
    for n in metrics:
        gap = F.col(f"b_{n}") - F.col(f"a_{n}")
        out += [F.round(gap, 6).alias(f"{n}_diff"), F.round(F.when(F.col(f"a_{n}") == 0, 0.0).otherwise(100 * gap / F.col(f"a_{n}")), 6).alias(f"{n}_percent")]
    return z.select(*out)


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s]", "")


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def person_words(clean: Column) -> Column:
    """Words of a cleaned name but for titles."""
    return F.array_except(_tokens(clean), F.array(*[F.lit(h) for h in HONORIFICS]))


def stripped(clean: Column) -> Column:
    """Words of a cleaned name but for corporate ones, in order of the alphabet."""
    return F.array_join(F.array_sort(F.array_except(_tokens(clean), F.array(*[F.lit(h) for h in SUFFIXES]))), " ")


def _initials(clean: Column) -> Column:
    """First letters of a cleaned name's main words; "" if it has fewer than two."""
    return F.when(F.size(_main(clean)) > 1, F.array_join(F.transform(_main(clean), lambda w: F.substring(w, 1, 1)), "")).otherwise("")


def same_person(a: Column, b: Column) -> Column:
    """Equal names, or one a single word (titles aside) that the other holds."""
    x, y = _clean(a), _clean(b)
    s, t = person_words(x), person_words(y)
    return (x == y) | ((F.size(s) > 0) & (F.size(t) > 0) & (((F.size(s) == 1) | (F.size(t) == 1)) & F.arrays_overlap(s, t)))


def same_organisation(a: Column, b: Column) -> Column:
    """Equal names, names that differ in corporate words only, or a name and its initials."""
    x, y = _clean(a), _clean(b)
    s, t = _tokens(x), _tokens(y)
    odd = F.concat(F.array_except(s, t), F.array_except(t, s))
    longer = (F.length(x) > 3) & (F.length(y) > 3) & (F.contains(x, y) | F.contains(y, x)) & F.forall(odd, lambda w: w.isin(*SUFFIXES))
    ix, iy = _initials(x), _initials(y)
    return (x == y) | longer | ((ix != "") & (ix == y)) | ((iy != "") & (iy == x))


def _main(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: (w != "") & ~w.isin(*SMALL_WORDS))


def with_coverage(differences: DataFrame, coverage: DataFrame, source: str, default: str = "General coverage") -> DataFrame:
    """Differences between sources with what each source's ``coverage`` says of it, or ``default``."""
    return differences.join(coverage.select(source, "coverage"), source, "left").withColumn("coverage", F.coalesce("coverage", F.lit(default)))


def share_key(x: Column, y: Column) -> Column:
    """Whether two lists of keys (of ``normalize_fact``) have one in common, by itself or by equivalence."""
    return F.arrays_overlap(x, y) | F.exists(x, lambda p: F.exists(y, lambda q: equal_keys(p, q, F.split(p, " "), F.split(q, " "))))


def share_fact(x: Column, y: Column) -> Column:
    """Whether two lists of facts have one in common, by key or by equivalence. Lists that meet many others should be made
    keys before they meet: see ``share_key``."""
    return share_key(F.transform(x, normalize_fact), F.transform(y, normalize_fact))


def story_changes(before: DataFrame, after: DataFrame, story: str, member: str) -> DataFrame:
    """What became of each member between two clusterings."""
    b, a = before.select(F.col(story).alias("old_story"), member), after.select(F.col(story).alias("new_story"), member)
    x = b.join(a, member, "full_outer")
    return x.withColumn("change", F.when(F.col("old_story").isNull(), "added").when(F.col("new_story").isNull(), "removed").when(F.col("old_story") != F.col("new_story"), "moved").otherwise("kept"))


def story_events(before: DataFrame, after: DataFrame, story: str, member: str) -> DataFrame:
    """(event, story, others, members): what became of stories between two clusterings.

    created: none of its members was in a story; merged: its members come from several stories (``others``); merged_away: all
    members that are left went into another story that was merged; split: its members are in several stories;
    removed: none of its members is in a story. ``members`` counts those of the story that the event is about.
    """
    b, a = before.select(F.col(story).alias("old"), member).distinct(), after.select(F.col(story).alias("new"), member).distinct()
    x = b.join(a, member, "full_outer")
    listed = lambda c: F.array_sort(F.collect_set(c))
    news = x.where("new is not null").groupBy("new").agg(F.count(F.lit(1)).alias("members"), listed("old").alias("olds"))
    olds = x.where("old is not null").groupBy("old").agg(F.count(F.lit(1)).alias("members"), listed("new").alias("news"))
    none = F.array().cast(news.schema["olds"].dataType)
    row = lambda df, kind, s, others: df.select(F.lit(kind).alias("event"), s.alias(story), others.alias("others"), "members")
    merged = news.where("size(olds) > 1")
    away = olds.where("size(news) = 1").withColumn("new", F.col("news")[0]).where("new <> old").join(merged.select("new"), "new", "left_semi")
    return (row(news.where("size(olds) = 0"), "created", F.col("new"), none).unionByName(row(merged, "merged", F.col("new"), F.col("olds"))).unionByName(row(away, "merged_away", F.col("old"), F.col("news")))
            .unionByName(row(olds.where("size(news) > 1"), "split", F.col("old"), F.col("news"))).unionByName(row(olds.where("size(news) = 0"), "removed", F.col("old"), none)))
