"""Stream queries: each runs over the events table as a stream to its end and returns what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams


def _e(spark, d):
    return streams.read_events(spark, d)


def _plain(df):
    """Times without a zone, as in the tables."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def str2(spark, d):
    x = _e(spark, d).select(F.concat(F.lit("h"), (F.col("event_id") / 6).cast("int")).alias("headline"), F.concat(F.lit("u"), F.col("user_id") % 3).alias("url"), "ts")
    return streams.run(streams.candidates(x, "headline", "url", 3, 1800), "append").groupBy("fired_by").agg(F.count(F.lit(1)).alias("n"))


def str3(spark, d):
    return streams.run(streams.without_repeats(_e(spark, d), ["user_id", "event_type"], "100 days"), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def str4(spark, d):
    return _plain(streams.run(streams.counts(_e(spark, d)), "complete"))


def str5(spark, d):
    return _plain(streams.run(streams.velocity(_e(spark, d), "event_type"), "complete"))


def str6(spark, d):
    return _plain(streams.run(streams.sessions(_e(spark, d), "user_id", "3 hours"), "complete"))


def str7(spark, d):
    return streams.run(streams.too_old(_e(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp")), "complete")


def str8(spark, d):
    x = streams.run(streams.domain_policy(_e(spark, d), "user_id"), "update")
    last = x.groupBy("user_id").agg(F.max_by(F.struct("attempts", "average"), "_batch").alias("s"))
    return last.select("user_id", "s.attempts", F.round("s.average", 6).alias("average"))


def str9(spark, d):
    e = _e(spark, d)
    starts = e.where("event_id % 2 = 0").select((F.col("event_id") / 2).cast("long").alias("run"), "ts")
    ends = _e(spark, d).where("event_id % 2 = 1 AND event_id % 10 <> 3").select(((F.col("event_id") - 1) / 2).cast("long").alias("run"), "ts")
    return streams.run(streams.stuck(starts, ends), "append").where(F.col("ts") < F.lit("2024-01-29 00:00:00").cast("timestamp")).select("run")


def str10(spark, d):
    return _plain(streams.run(streams.alerts(_e(spark, d), F.col("event_type") == "error", "6 hours", "3 hours", 0.05), "complete"))


def str11(spark, d):
    return streams.run(streams.engagement(_e(spark, d), F.col("event_id") % 50), "complete")


def str12(spark, d):
    return _plain(streams.run(streams.budget(_e(spark, d), F.col("user_id") % 5, 100.0), "complete"))


_WIN = lambda length, step: f"(SELECT *, time_bucket(INTERVAL {step} HOUR, ts, TIMESTAMP '1970-01-01') - to_hours({step} * k) AS start FROM events, (SELECT unnest(range(0, {length} // {step})) AS k))"

QUERIES = {
    "str2_candidates": (str2, """WITH e AS (SELECT event_id // 6 AS h, user_id % 3 AS u, ts, min(ts) OVER (PARTITION BY event_id // 6) AS t0 FROM events),
        f AS (SELECT h, u, min(ts) AS ts, any_value(t0) AS t0 FROM e GROUP BY h, u), g AS (SELECT h, list_sort(list(ts))[3] AS third, any_value(t0) + INTERVAL 1800 SECOND AS until FROM f GROUP BY h),
        w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events), x AS (SELECT CASE WHEN third <= until AND third <= w THEN 'count' WHEN until <= w THEN 'time' END AS fired_by FROM g, w)
        SELECT fired_by, count(*) AS n FROM x WHERE fired_by IS NOT NULL GROUP BY 1"""),
    "str3_dedup": (str3, "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1"),
    "str4_counts": (str4, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "str5_velocity": (str5, f"SELECT start, event_type, count(*) AS n FROM {_WIN(6, 2)} GROUP BY 1, 2"),
    "str6_sessions": (str6, """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 3 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k"""),
    "str7_late": (str7, "SELECT ts < TIMESTAMP '2024-01-17' AS late, count(*) AS n FROM events GROUP BY 1"),
    "str8_domain_policy": (str8, """WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT user_id, count(*) AS attempts, round(sum(pow(0.9::DOUBLE, age) * CASE WHEN age = n - 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END * value), 6) AS average FROM x GROUP BY 1"""),
    "str9_stuck": (str9, """SELECT CAST(s.event_id / 2 AS BIGINT) AS run FROM events s LEFT JOIN events e ON e.event_id = s.event_id + 1 AND e.event_id % 10 <> 3 AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 60 MINUTE
        WHERE s.event_id % 2 = 0 AND e.event_id IS NULL AND s.ts < TIMESTAMP '2024-01-29'"""),
    "str10_alerts": (str10, f"SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.05 AS alert FROM {_WIN(6, 3)} GROUP BY 1"),
    "str11_engagement": (str11, "SELECT event_id % 50 AS story, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "str12_budget": (str12, "SELECT date_trunc('hour', ts) AS start, user_id % 5 AS key, round(sum(value), 2) AS spent, sum(value) > 100 AS over FROM events GROUP BY 1, 2"),
}
