"""Streams: what the batch operators say of a table, kept up as rows arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import new_place

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events*.parquet", files: int = 1) -> DataFrame:
    """Event files of a folder as a stream, ``files`` a batch."""
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def read_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Feed files as they land: entries with a link and its canonical form."""
    from ..functions.url import canonicalize_url
    from ..sources.records import FEED

    s = spark.readStream.format("xml").option("rowTag", "item").schema(FEED).load(folder)
    return s.where(F.coalesce(F.trim("link"), F.lit("")) != "").withColumn("canonical", canonicalize_url(F.col("link")))


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, mode: str, seconds: int = 7200) -> DataFrame:
    """Run a stream over what is there and return what it wrote, with its state in RocksDB. Complete results replace each other; rows of append and
    update mode are added (update rows carry ``_batch``, so that the last row of a key can be told).

    Each batch has a folder of its own, which a batch that is run again overwrites, so no row is written twice.
    """
    spark = stream.sparkSession
    base = new_place(spark)
    path = f"{base}/rows"

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/_batch={i}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    if not q.awaitTermination(seconds):
        q.stop()
        raise TimeoutError(f"the stream ran longer than {seconds} s")
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(path)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(path)
    return rows if mode == "update" else rows.drop("_batch")


def counts(events: DataFrame, unit: str = "1 hour", late: str = "3 days", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", unit).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def velocity(events: DataFrame, key: str, length: str = "6 hours", step: str = "2 hours", late: str = "3 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "3 days") -> DataFrame:
    """Sessions of a reader: start, end of the last event plus the gap, and events."""
    return (events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def without_repeats(events: DataFrame, keys: list[str], ttl: str = "5 minutes") -> DataFrame:
    """The first event of a key; others within ``ttl`` of event time are dropped."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def too_old(events: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Events by whether they are older than ``hours`` at ``now``: late ones are counted, not lost."""
    return events.groupBy((F.col("ts") < now - F.expr(f"INTERVAL {hours} HOURS")).alias("late")).agg(F.count(F.lit(1)).alias("n"))


def alerts(events: DataFrame, bad: Column, length: str, step: str, errors: float, late: str = "3 days") -> DataFrame:
    """Windows and whether their error rate is above a limit."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"))
    return g.select(F.col("w.start").alias("start"), "n", "bad", (F.col("bad") / F.col("n") > errors).alias("alert"))


def engagement(events: DataFrame, story: Column) -> DataFrame:
    return events.groupBy(story.alias("story"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def budget(events: DataFrame, key: Column, limit: float, late: str = "3 days") -> DataFrame:
    """Hourly spending of a key and whether it is over the limit."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), key.alias("key")).agg(F.sum("value").alias("spent"))
    return g.select(F.col("w.start").alias("start"), "key", F.round("spent", 2).alias("spent"), (F.col("spent") > limit).alias("over"))


def stuck(starts: DataFrame, ends: DataFrame, minutes: int = 60) -> DataFrame:
    """Runs that have no end within ``minutes`` of their start: (run, ts). ``starts`` and ``ends`` have run and ts."""
    s = starts.withWatermark("ts", "10 minutes").alias("s")
    e = ends.withWatermark("ts", "10 minutes").alias("e")
    on = (F.col("s.run") == F.col("e.run")) & (F.col("e.ts") >= F.col("s.ts")) & (F.col("e.ts") <= F.col("s.ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return s.join(e, on, "left_outer").where(F.col("e.run").isNull()).select(F.col("s.run").alias("run"), F.col("s.ts").alias("ts"))


def domain_policy(events: DataFrame, key: str, alpha: float = 0.1, late: str = "3 days", idle_days: int = 365) -> DataFrame:
    """Moving average of ``value`` by key, kept in state; each batch emits the keys it has touched. Within a batch rows
    are taken in order of time; the state is a sum and a count, however long a key lives, and goes ``idle_days`` after
    the key's last event."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, mean = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        for v in rows["value"]:
            mean = float(v) if n == 0 else (1 - alpha) * mean + alpha * float(v)
            n += 1
        state.update((n, mean))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_days * 86_400_000)
        yield pd.DataFrame({key: [k[0]], "attempts": [n], "average": [mean]})

    return (events.withWatermark("ts", late).select(key, "ts", "event_id", "value").groupBy(key)
            .applyInPandasWithState(fold, f"{key} long, attempts long, average double", "n long, mean double", "update", "EventTimeTimeout"))


def candidates(entries: DataFrame, key: str, url: str, needed: int = 3, seconds: int = 60, late: str = "10 minutes", quiet: int = 86_400, buckets: int = 8192) -> DataFrame:
    """Headline windows: one opens at a headline's first entry and fires at ``needed`` different URLs or ``seconds``
    later; entries that come after that are ignored, for ``quiet`` seconds, after which the headline's state goes. Emits
    (key, urls, fired_by).

    Entries wait in the state until the watermark passes the moment at which they decide, so any split of the entries into
    batches gives one answer, as long as none is later than ``late``. Headlines are dealt into ``buckets`` by their hash; a
    bucket has one state, one timer (the next moment at which one of its headlines decides or ends its quiet time) and one
    call a batch, so calls do not grow with headlines or entries.
    """
    kind = entries.schema[key].dataType.simpleString()
    x = entries.withWatermark("ts", late).select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_b"), F.col(key).alias("_k"), F.col(url).cast("string").alias("link"), F.ceil(F.unix_micros("ts") / 1000).alias("millis"), "ts")
    length, rest = 1000 * seconds, 1000 * quiet

    def decide(found: list[tuple]) -> tuple[int, int, str]:
        """When the entries of a headline decide, on how many URLs, and by what."""
        found.sort(key=lambda x: (x[0], str(x[1])))
        end, urls = found[0][0] + length, set()
        for at, link in found:
            if at > end:
                break
            urls.add(link)
            if len(urls) >= needed:
                return at, len(urls), "count"
        return end, len(urls), "time"

    def fold(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        keys, times, links, silent, until = state.get if state.exists else ([], [], [], [], [])
        still, waiting = dict(zip(silent, until, strict=True)), {}
        for k, t, u in zip(keys, times, links, strict=True):
            waiting.setdefault(k, []).append((t, u))
        if not state.hasTimedOut:
            for f in frames:
                for k, t, u in zip(f["_k"].tolist(), f["millis"].tolist(), f["link"].tolist(), strict=True):
                    if k not in still:
                        waiting.setdefault(k, []).append((t, u))
        now = state.getCurrentWatermarkMs()
        still = {k: t for k, t in still.items() if t > now}
        fired, moments = [], []
        for k in list(waiting):
            at, n, by = decide(waiting[k])
            if at <= now:
                fired.append((k, n, by))
                still[k] = waiting.pop(k)[0][0] + length + rest
            else:
                moments.append(at)
        if waiting or still:
            rows = [(k, t, u) for k, found in waiting.items() for t, u in found]
            state.update(([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], list(still), list(still.values())))
            state.setTimeoutTimestamp(max(min([*moments, *still.values()]) - 1, now))  # a timer fires behind its time
        elif state.exists:
            state.remove()
        if fired:
            yield pd.DataFrame(fired, columns=[key, "urls", "fired_by"])

    held = f"keys array<{kind}>, times array<long>, links array<string>, silent array<{kind}>, until array<long>"
    return x.groupBy("_b").applyInPandasWithState(fold, f"{key} {kind}, urls long, fired_by string", held, "append", "EventTimeTimeout")
