"""Analytics over telemetry: runs, stages, calls and costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table: (name, n)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def breakdown(df: DataFrame, keys: Sequence[str], cost: str) -> DataFrame:
    """Rows and cost by all keys, and the grand total (``is_total``), in one pass."""
    cols = [F.col(k) for k in keys]
    return df.groupingSets([cols, []], *cols).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(cost), 2).alias("cost"), (F.grouping_id() > 0).alias("is_total"))


def health(df: DataFrame, keys: Sequence[str], bad: Column, latency: str, most: float = 0.10) -> DataFrame:
    """Calls, error rate and mean latency by key; degraded above ``most`` errors."""
    rate = F.count_if(bad) / F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.round(rate, 6).alias("error_rate"), F.round(F.avg(latency), 6).alias("latency"), (rate > most).alias("degraded"))


def series(df: DataFrame, ts: str, unit: str, value: str | None = None) -> DataFrame:
    """Rows (and their sum) by hour or day."""
    more = [] if value is None else [F.round(F.sum(value), 2).alias("total")]
    return df.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *more)


def state_counts(df: DataFrame, state: str) -> DataFrame:
    return df.groupBy(state).agg(F.count(F.lit(1)).alias("n"))


def cost_projection(calls: DataFrame, ts: str, cost: str, now: Column) -> DataFrame:
    """Cost since midnight, and what it makes an hour, a day and a month (half an hour at least)."""
    start = F.date_trunc("DAY", now).cast("timestamp_ntz")
    hours = F.greatest(F.timestamp_diff("SECOND", start, now) / 3600.0, F.lit(0.5))
    c = calls.agg(F.coalesce(F.sum(F.when((F.col(ts) >= start) & (F.col(ts) <= now), F.col(cost))), F.lit(0.0)).alias("today"))
    h = F.col("today") / hours
    return c.select(F.round("today", 4).alias("today"), F.round(h, 4).alias("hourly"), F.round(h * 24, 4).alias("daily"), F.round(h * 720, 4).alias("monthly"))


def percentiles(df: DataFrame, key: str, value: str, above: float, exact: bool = True, small: int = 20_000) -> DataFrame:
    """Median, 90th and 99th percentile (between neighbours by linear interpolation), mean, largest and how many lie above
    a limit. ``exact=False`` uses a sketch of bounded size.

    Keys of up to ``small`` rows are ordered whole. Of a larger one a sketch gives a value a thousandth of the rows before
    each percentile and one as far behind it; the rows below, at and between these two are counted, and only those
    between, about one in 500, are ordered. A value that many rows share is one of the two, or both, and needs no order.
    """
    wanted = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    x = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    sketch = list(wanted.values()) if not exact else [q + d for q in wanted.values() for d in (-0.001, 0.001)]
    facts = x.groupBy("k").agg(F.avg("v").alias("mean"), F.max("v").alias("largest"), F.count_if(F.col("v") > above).alias("above"), F.count(F.lit(1)).alias("n"), F.percentile_approx("v", sketch, 10000).alias("at"))
    last = (F.round("mean", 6).alias("mean"), "largest", "above")
    if not exact:
        return facts.select(F.col("k").alias(key), *[F.round(F.col("at")[i], 6).alias(n) for i, n in enumerate(wanted)], *last)
    facts = cut(facts)
    rows = x.join(facts.select(F.col("k").alias("k2"), "n", "at"), F.col("k").eqNullSafe(F.col("k2")))
    whole = rows.where(F.col("n") <= small).groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in wanted.values()])).alias("p")).select("k", *[F.col("p")[i].alias(n) for i, n in enumerate(wanted)])
    large = rows.where(F.col("n") > small)
    lo, hi = (lambda i: F.col("at")[2 * i]), (lambda i: F.col("at")[2 * i + 1])
    v, between = F.col("v"), lambda i: (F.col("v") > lo(i)) & (F.col("v") < hi(i))
    counts = large.groupBy("k").agg(*[c.alias(f"{what}{i}") for i in range(len(wanted)) for what, c in (("under", F.count_if(v < lo(i))), ("same", F.count_if(v == lo(i))), ("mid", F.count_if(between(i))))])
    mids = large.select("k", "v", F.explode(F.array_compact(F.array(*[F.when(between(i), F.lit(i)) for i in range(len(wanted))]))).alias("i"))
    mids = mids.select(F.col("k").alias("k2"), "i", "v", (F.row_number().over(Window.partitionBy("k", "i").orderBy("v")) - 1).alias("r"))
    ends = facts.where(F.col("n") > small).withColumnRenamed("k", "k1").join(counts, F.col("k1").eqNullSafe(F.col("k")))
    ends = ends.select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * q).alias("rank"), lo(i).alias("lo"), hi(i).alias("hi"), F.col(f"under{i}").alias("under"), F.col(f"same{i}").alias("same"), F.col(f"mid{i}").alias("mid")) for i, q in enumerate(wanted.values())])).alias("e")).select("k", "e.*")
    ends = ends.withColumn("part", F.col("rank") - F.floor("rank")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    ends = ends.withColumn("r", F.floor("rank") + F.col("side") - F.col("under") - F.col("same")).withColumn("share", F.when(F.col("side") == 0, 1 - F.col("part")).otherwise(F.col("part")))
    met = ends.join(mids.withColumnsRenamed({"i": "i2", "r": "r2"}), F.col("k").eqNullSafe(F.col("k2")) & (F.col("i") == F.col("i2")) & (F.col("r") == F.col("r2")), "left")
    met = met.withColumn("v", F.when(F.col("r") < 0, F.col("lo")).when(F.col("r") >= F.col("mid"), F.col("hi")).otherwise(F.col("v")))
    ordered = met.groupBy("k").agg(*[F.sum(F.when(F.col("i") == i, F.col("v") * F.col("share"))).alias(n) for i, n in enumerate(wanted)])
    out = facts.join(whole.unionByName(ordered).withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")))
    return out.select(F.col("k").alias(key), *[F.round(n, 6).alias(n) for n in wanted], *last)


def rates(df: DataFrame, keys: Sequence[str], **conditions: Column) -> DataFrame:
    """Rows and the share of each condition by key; a null condition counts as not met."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.count_if(c) / F.count(F.lit(1)), 6).alias(k) for k, c in conditions.items()])


def cost_forecast(df: DataFrame, article: str, story: str, article_cost: Column, story_cost: Column, volumes: Sequence[int], defaults: tuple[float, float] = (0.005, 0.015)) -> DataFrame:
    """Cost at given volumes from the cost of a distinct article and story."""
    u = df.agg((F.sum(article_cost) / F.nullif(F.count_distinct(article), F.lit(0))).alias("a"), (F.sum(story_cost) / F.nullif(F.count_distinct(story), F.lit(0))).alias("s"))
    unit = F.coalesce("a", F.lit(defaults[0])) + F.coalesce("s", F.lit(defaults[1]))
    return u.select(F.explode(F.array(*[F.lit(v) for v in volumes])).alias("volume"), unit.alias("unit")).select("volume", F.round(F.col("unit") * F.col("volume"), 2).alias("cost"))


def failure_trend(failed: DataFrame, done: DataFrame, ts: str, last: str, days: int = 14) -> DataFrame:
    """Failures and successes of each of the last days, with zeros where there are none."""
    cal = failed.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias("day"))
    n = lambda df, c: df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias(c))
    x = cal.join(n(failed, "failures"), "day", "left").join(n(done, "successes"), "day", "left").na.fill(0, ["failures", "successes"])
    return x.withColumn("rate", F.round(F.when(F.col("failures") + F.col("successes") > 0, F.col("failures") / (F.col("failures") + F.col("successes"))).otherwise(0.0), 6))


def stage_detail(spans: DataFrame, run: str, stage: str, status: str, latency: str, start: str, severity: Sequence[str]) -> DataFrame:
    """Attempts, latencies, first start and worst status of each stage of each run; ``severity`` lists the worst first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in severity]), F.col(status))
    return spans.groupBy(run, stage).agg(F.count(F.lit(1)).alias("attempts"), F.round(F.sum(latency), 2).alias("total"), F.round(F.avg(latency), 6).alias("mean"), F.round(F.max(latency), 2).alias("largest"),
                                         F.min(start).alias("first_start"), F.min_by(status, F.when(rank > 0, rank).otherwise(len(severity) + 1)).alias("status"))


def run_summary(spans: DataFrame, run: str, kind: str, words: dict[str, str]) -> DataFrame:
    """A line a run: how many of each kind, those without any left out."""
    c = spans.groupBy(run).agg(*[F.count_if(F.col(kind) == k).alias(f"_{i}") for i, k in enumerate(words)])
    return c.select(run, F.concat_ws(" · ", *[F.when(F.col(f"_{i}") > 0, F.concat(F.col(f"_{i}").cast("string"), F.lit(f" {w}"))) for i, w in enumerate(words.values())]).alias("summary"))


def engagement(events: DataFrame, story: str, kind: str, views: str, bookmarks: str, unbookmarks: str, shares: str) -> DataFrame:
    """Counters of a story; bookmarks taken back subtract, never below 0."""
    n = lambda k: F.count_if(F.col(kind) == k)
    return events.groupBy(story).agg(n(views).alias("views"), F.greatest(n(bookmarks) - n(unbookmarks), F.lit(0)).alias("bookmarks"), n(shares).alias("shares"))


def completion(children: DataFrame, parent: str, status: str, terminal: Sequence[str]) -> DataFrame:
    """Whether every child of a parent has ended."""
    return children.groupBy(parent).agg(F.count(F.lit(1)).alias("children"), F.bool_and(F.col(status).isin(*terminal)).alias("done"))


#: Upper edges of latency buckets, in seconds. Fixed values.
EDGES = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def window_buckets(df: DataFrame, ts: str, minutes: int, bad: Column, latency: str, change: Column | None = None, edges: Sequence[float] = EDGES) -> DataFrame:
    """(start, upto, n, bad, change): of each window of time and latency bucket the rows, those that are ``bad``, and the sum of
    what they add to the backlog. Such tables can be kept and added up, see ``merge_windows``. Null latencies count in
    the bucket ``upto`` null, which no percentile looks at."""
    b = F.when(F.col(latency).isNotNull(), F.coalesce(*[F.when(F.col(latency) <= e, F.lit(float(e))) for e in edges], F.lit(float("inf"))))
    w = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")
    rows = df.groupBy(w.alias("w"), b.alias("upto")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.sum(F.lit(0) if change is None else change).alias("change"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "upto", "n", "bad", "change")


def merge_windows(buckets: DataFrame, minutes: int) -> DataFrame:
    """Buckets of windows added up to longer windows; tables of several sources may be united before."""
    w = F.window(F.col("start").cast("timestamp"), f"{minutes} minutes")
    return buckets.groupBy(w.alias("w"), "upto").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "change")]).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "upto", "n", "bad", "change")


def bucket_quantile(buckets: DataFrame, q: float, edges: Sequence[float] = EDGES) -> DataFrame:
    """(start, quantile) by linear interpolation in the bucket that holds it; beyond the last edge, that edge. The exact
    quantile lies in the same bucket, so the error is less than the bucket is wide."""
    one = buckets.where("upto is not null").groupBy("start", "upto").agg(F.sum("n").alias("n"))
    c = one.withColumns({"upper": F.sum("n").over(Window.partitionBy("start").orderBy("upto")), "total": F.sum("n").over(Window.partitionBy("start"))})
    x = c.where(F.col("upper") >= q * F.col("total")).groupBy("start").agg(F.min_by(F.struct("upto", "upper", "n", "total"), "upto").alias("x")).select("start", "x.*")
    low = F.coalesce(*[F.when(F.col("upto") > e, F.lit(float(e))) for e in reversed(edges)], F.lit(0.0))
    return x.select("start", F.when(F.col("upto") == float("inf"), F.lit(float(edges[-1]))).otherwise(low + (F.col("upto") - low) * (q * F.col("total") - (F.col("upper") - F.col("n"))) / F.col("n")).alias("quantile"))


def alerts(buckets: DataFrame, slow: float = 30.0, errors: float = 0.05, backlog: int = 100, edges: Sequence[float] = EDGES) -> DataFrame:
    """Windows of ``window_buckets`` with their 95th percentile of latency, error rate and the backlog at their end, and whether
    each is above its limit. There is a row a window only, so the running backlog is a sum over a short table."""
    w = buckets.groupBy("start").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("change").alias("change"))
    w = w.withColumn("backlog", F.sum("change").over(Window.orderBy("start"))).join(bucket_quantile(buckets, 0.95, edges).withColumnRenamed("quantile", "p95"), "start", "left")
    rate = F.col("bad") / F.col("n")
    return w.select("start", "n", F.round("p95", 6).alias("p95"), F.round(rate, 6).alias("rate"), "backlog", (F.col("p95") > slow).alias("is_slow"), (rate > errors).alias("is_failing"), (F.col("backlog") > backlog).alias("is_behind"))


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Rows up to each edge, and above the last."""
    b = F.coalesce(*[F.when(F.col(value) <= e, F.lit(float(e))) for e in edges], F.lit(float("inf")))
    return df.groupBy(b.alias("upto")).agg(F.count(F.lit(1)).alias("n"))


def moving_averages(rows: DataFrame, by: str, order: Sequence[str], averages: Mapping[str, tuple[Column, Column, Column]], alpha: float = 0.1) -> DataFrame:
    """(by, attempts, a column for each average): exponential moving averages over the rows of a key in order.

    Of each average ``averages`` gives the value, whether a row moves it, and whether it starts at its value if the row is the
    first of its key (else it starts at 0).

    What a span of rows does to an average is an affine map, and maps of spans are put together by composing them. Rows
    are range-partitioned by key and order, so a key with many rows is many spans, each folded in its own task; of a
    span one row remains, and a key has no more of these than there are partitions.
    """
    names = list(averages)
    x = rows.select(F.col(by), *order, *[c.alias(f"{p}{i}") for i, n in enumerate(names) for p, c in zip("vms", (averages[n][0].cast("double"), *averages[n][1:]), strict=True)])
    x = cut(x.repartitionByRange(by, *order).withColumn("_span", F.spark_partition_id()))
    back = Window.partitionBy(by, "_span").orderBy(*[F.desc(c) for c in order])
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"_first": F.lead(F.lit(1)).over(back).isNull()} | {f"k{i}": F.coalesce(F.sum(F.col(f"m{i}").cast("int")).over(later), F.lit(0)) for i in range(len(names))})
    rest = lambda i: F.col(f"m{i}") & ~F.col("_first")
    spans = x.groupBy(by, "_span").agg(F.count(F.lit(1)).alias("n"), *[c for i in range(len(names)) for c in (
        F.count_if(rest(i)).alias(f"r{i}"), F.sum(F.when(rest(i), alpha * F.pow(F.lit(1 - alpha), F.col(f"k{i}")) * F.col(f"v{i}")).otherwise(0.0)).alias(f"c{i}"),
        F.max(F.when(F.col("_first"), F.col(f"v{i}"))).alias(f"v{i}"), F.bool_or(F.col("_first") & F.col(f"m{i}")).alias(f"m{i}"), F.bool_or(F.col("_first") & F.col(f"s{i}")).alias(f"s{i}"))])
    each = spans.groupBy(by).agg(F.sum("n").alias("attempts"), F.array_sort(F.collect_list(F.struct("_span", *[c for c in spans.columns if c not in (by, "_span", "n")]))).alias("_s"))

    def fold(i: int) -> Column:
        def step(x: Column, s: Column) -> Column:
            begun = F.when(x.isNull(), F.when(s[f"s{i}"], s[f"v{i}"]).otherwise(0.0)).otherwise(F.when(s[f"m{i}"], (1 - alpha) * x + alpha * s[f"v{i}"]).otherwise(x))
            return F.pow(F.lit(1 - alpha), s[f"r{i}"]) * begun + s[f"c{i}"]

        return F.aggregate("_s", F.lit(None).cast("double"), step)

    return each.select(by, "attempts", *[fold(i).alias(n) for i, n in enumerate(names)])


def domain_policy(attempts: DataFrame, domain: str, ts: str, key: str, provider: Column, ok: Column, latency: Column, length: Column, weights: Mapping[str, float], alpha: float = 0.1) -> DataFrame:
    """What a domain's attempts in order say of it: for each provider of ``weights`` its number of attempts and moving success
    rate, the moving latency, the moving length of what was extracted (successes only move it), the last provider that
    succeeded, and the confidence, which mixes the rates by their weights (after one attempt: 1 or 0, as that went).

    The first attempt of a domain sets the averages; a provider that was not the first starts at 0. See
    ``moving_averages``. Null domains are left out; a null outcome is a failure.
    """
    x = attempts.where(F.col(domain).isNotNull()).select(F.col(domain), F.col(ts).alias("_t"), F.col(key).alias("_k"), provider.alias("_p"), F.coalesce(ok, F.lit(False)).alias("_ok"), F.coalesce(latency, F.lit(0.0)).alias("_l"), F.coalesce(length, F.lit(0.0)).alias("_n"))
    yes = F.lit(True)
    rates = {p: (F.col("_ok").cast("int"), F.coalesce(F.col("_p") == p, F.lit(False)), F.coalesce(F.col("_p") == p, F.lit(False))) for p in weights}
    avg = moving_averages(x, domain, ["_t", "_k"], rates | {"latency": (F.col("_l"), yes, yes), "length": (F.col("_n"), F.col("_ok"), yes)}, alpha)
    counts = x.groupBy(domain).agg(*[F.count_if(F.col("_p") == p).alias(f"{p}_attempts") for p in weights], F.max_by("_p", F.when(F.col("_ok"), F.struct("_t", "_k"))).alias("last_success"), F.bool_or("_ok").alias("_any"))
    mix = sum((w * F.col(p) for p, w in weights.items()), F.lit(0.0))
    out = avg.join(counts, domain)
    return out.select(domain, "attempts", *[f"{p}_attempts" for p in weights], *[F.round(p, 6).alias(f"{p}_rate") for p in weights], F.round("latency", 6).alias("latency"), F.round("length", 6).alias("length"),
                      F.when(F.col("_any"), F.col("last_success")).alias("last_success"), F.round(F.when(F.col("attempts") == 1, F.col("_any").cast("double")).otherwise(mix), 6).alias("confidence"))


def sources_per_story(members: DataFrame, story: str, source: str) -> DataFrame:
    """Mean and exact median of the sources of a story, as one row. Stories are counted by their number of sources first,
    so the median comes from a short table of counts."""
    n = members.groupBy(story).agg(F.count_distinct(source).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 2).alias("mean"), F.round(F.percentile("s", F.lit(0.5), F.col("n")), 2).alias("median"))


def discovery_effectiveness(articles: DataFrame, article: str, story: str, created: str, since: Column) -> DataFrame:
    """Distinct articles and stories since a time."""
    return articles.where(F.col(created) >= since).agg(F.count_distinct(article).alias("articles"), F.count_distinct(story).alias("stories"))


def discovery_report(events: DataFrame, kind: str, ts: str, now: Column) -> DataFrame:
    """Events of each kind today, in the last hour and in the last seven days, up to ``now``."""
    n = F.count_if
    at = F.col(ts)
    return events.where(at <= now).groupBy(kind).agg(n(F.to_date(at) == F.to_date(now)).alias("today"), n(at >= now - F.expr("INTERVAL 1 HOUR")).alias("last_hour"), n(at >= now - F.expr("INTERVAL 7 DAYS")).alias("week"))


def latency_by(calls: DataFrame, key: str, latency: str) -> DataFrame:
    return calls.groupBy(key).agg(F.round(F.avg(latency), 6).alias("latency"), F.round(F.sum(latency), 2).alias("total"))


def extraction_health(events: DataFrame, domain: str, ok: Column, failed: Column, fallback: Column, credit: Column) -> DataFrame:
    """Success among attempts, share of fall-backs and sum of credits of each domain."""
    tries = F.greatest(F.count_if(ok) + F.count_if(failed), F.lit(1))
    return events.groupBy(domain).agg(F.round(F.count_if(ok) / tries, 6).alias("success"), F.round(F.count_if(fallback) / F.count(F.lit(1)), 6).alias("fallback"), F.round(F.sum(F.coalesce(credit, F.lit(0.0))), 2).alias("credits"))


def reflection_analytics(records: DataFrame, score: str, rejected: Column) -> DataFrame:
    """Reflections, their mean score and rejections as one row, zeros if there are none."""
    return records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg(score), 6), F.lit(0.0)).alias("mean"), F.coalesce(F.count_if(rejected), F.lit(0)).alias("rejected"))


def provider_sla(calls: DataFrame, provider: str, ok: Column, retries: Column, latency: str) -> DataFrame:
    """Availability, retries (half of them put down to rate limits, a quarter to time-outs) and mean latency of a provider."""
    x = calls.groupBy(provider).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.sum(retries).alias("retries"), F.round(F.avg(latency), 4).alias("latency"))
    return x.select(provider, "n", F.round(F.col("ok") / F.col("n"), 6).alias("availability"), "retries", F.floor(F.col("retries") / 2).alias("rate_limited"), F.floor(F.col("retries") / 4).alias("timeouts"), "latency")


def failure_analytics(calls: DataFrame, stage: str, provider: str, code: str, failed: Column, retries: Column, top: int = 10) -> DataFrame:
    """(aspect, key, failures, mean_retries, success): in total, of the ``top`` stages with most failures, of each
    provider and of each code of a failure, in one pass of grouping sets. Success is the share of calls that did not fail;
    codes have none, as only failures have a code."""
    x = calls.select(F.col(stage).cast("string").alias("s"), F.col(provider).cast("string").alias("p"), F.when(failed, F.col(code).cast("string")).alias("c"), failed.alias("f"), retries.alias("r"))
    g = x.groupingSets([[F.col("s")], [F.col("p")], [F.col("c")], []], F.col("s"), F.col("p"), F.col("c")).agg(
        F.count_if("f").alias("failures"), F.round(F.avg(F.when(F.col("f"), F.col("r"))), 6).alias("mean_retries"), F.round(1 - F.count_if("f") / F.count(F.lit(1)), 6).alias("share"), F.grouping_id().alias("g"))
    aspect = F.when(F.col("g") == 3, "stage").when(F.col("g") == 5, "provider").when(F.col("g") == 6, "code").otherwise("total")
    g = g.select(aspect.alias("aspect"), F.coalesce("s", "p", "c").alias("key"), "failures", "mean_retries", F.when(F.col("g") != 6, F.col("share")).alias("success"))
    g = g.where((F.col("aspect") != "code") | F.col("key").isNotNull())
    stages = g.where("aspect = 'stage'").orderBy(F.desc("failures"), "key").limit(top)
    return g.where("aspect <> 'stage'").unionByName(stages)


def metrics_summary(runs: DataFrame, failed: Column, cost: str) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(failed).alias("failed"), F.round(F.sum(cost), 2).alias("cost"))


def candidate_funnel(candidates: DataFrame, articles: DataFrame, key: str, group: str, clustered: Column) -> DataFrame:
    """URLs found and crawled, articles kept and clustered, by ``group``. ``articles`` has the key of their candidate."""
    x = candidates.select(key, group).join(articles.withColumns({"_there": F.lit(True), "_in": clustered}).select(key, "_there", "_in"), key, "left")
    return x.groupBy(group).agg(F.count_distinct(key).alias("found"), F.count_distinct(F.when(F.col("_there"), F.col(key))).alias("crawled"), F.count("_there").alias("articles"), F.count_if("_in").alias("clustered"))


def token_usage(calls: DataFrame, keys: Sequence[str], tokens: str, failed: Column, latency: str) -> DataFrame:
    """Tokens, calls, failures and mean latency by ``keys`` (day, provider, model, stage)."""
    return calls.groupBy(*keys).agg(F.round(F.sum(tokens), 2).alias("tokens"), F.count(F.lit(1)).alias("calls"), F.count_if(failed).alias("errors"), F.round(F.avg(latency), 6).alias("latency"))
