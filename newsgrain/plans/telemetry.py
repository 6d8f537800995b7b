"""Telemetry queries: events play stage runs, calls and failures; line items play execution records; orders play tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, gates, maintenance, serving, telemetry
from ..sources import records
from ..storage import new_place
from ..streaming import upserts

NOW, DAY = "2024-01-20 15:30:00", "2024-01-20"
ONOW = "2001-08-01"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ts(x):
    return F.lit(x).cast("timestamp_ntz")


def _ev(spark, d):
    return _t(spark, d, "events")


def _li(spark, d):
    return _t(spark, d, "lineitem")


def _tasks(spark, d):
    """Orders as tasks: P pending, F failed, O running."""
    state = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_custkey") % 2 == 0, "running").otherwise("processing")
    return _t(spark, d, "orders").select("o_orderkey", "o_orderdate", state.alias("state"), (F.col("o_custkey") % 5).alias("tries"), "o_totalprice")


def src3(spark, d):
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        one = records.read_table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def src6(spark, d):
    e = _ev(spark, d)
    known = F.expr("event_id % 3 = 0 AND user_id % 7 > 0 OR user_id % 5 = 0")
    base = e.where(known).groupBy("user_id").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    delta = e.where(~known).groupBy("user_id").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("k"))
    x = dedup.upsert(base, delta, ["user_id"], {"mean": F.when(F.col("b.mean").isNull(), F.col("d.v")).when(F.col("d.v").isNull(), F.col("b.mean")).otherwise(0.9 * F.col("b.mean") + 0.1 * F.col("d.v")),
                                                "n": F.coalesce("b.n", F.lit(0)) + F.coalesce("d.k", F.lit(0))})
    return x.select("user_id", F.round("mean", 6).alias("mean"), "n")


def src6_stream(spark, d):
    """Totals by user and type that a stream of four files keeps up."""
    place = new_place(spark)
    _ev(spark, d).repartition(4, "event_id").write.parquet(f"{place}/in")
    stream = spark.readStream.schema(_ev(spark, d).schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    table = upserts.UpsertTable(spark, f"{place}/table", ["user_id", "event_type"], "user_id long, event_type string, n long, most double, last timestamp_ntz", 16)
    each = [F.count(F.lit(1)).alias("n"), F.max("value").alias("most"), F.max("ts").alias("last")]
    version = table.follow(stream, each, {"n": F.coalesce("b.n", F.lit(0)) + F.coalesce("d.n", F.lit(0)), "most": F.greatest("b.most", "d.most"), "last": F.greatest("b.last", "d.last")})
    return table.snapshot(version)


def src10(spark, d):
    return records.ingest_events(_ev(spark, d)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


CATALOGUE = [("click", ["k"]), ("view", ["k"]), ("purchase", ["k", "sku"])]


def src11(spark, d):
    cat = spark.createDataFrame(CATALOGUE, "event_type string, required array<string>")
    return records.validate_events(_ev(spark, d), cat).groupBy("event_type", "problem").agg(F.count(F.lit(1)).alias("n"))


def src13(spark, d):
    e = _ev(spark, d).select("user_id", "event_type")
    return records.append_log(e.where("event_type <> 'view'"), e.where("event_type = 'view'")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def flt11(spark, d):
    return gates.list_failures(_ev(spark, d), {"event_type": "error", "user_id": None}, [F.desc("ts"), "event_id"], 20, 5).select("event_id", "total")


def flt12(spark, d):
    p = _ev(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), (F.count_if(F.col("event_type") == "signup") / F.count(F.lit(1))).alias("local"), (F.count_if(F.col("event_type") == "click") / F.count(F.lit(1))).alias("p1"),
                                           (F.count_if(F.col("event_type") == "view") / F.count(F.lit(1))).alias("p2"))
    return gates.route_domains(p, "attempts", "local", ["p1", "p2"]).select("user_id", "skip_local")


def sc23(spark, d):
    return records.clean_events(_ev(spark, d).select("event_id", F.concat(F.lit('{"primary_event":{"event_type":" '), "event_type", F.lit('","actors":[" a","",'), F.to_json(F.struct(F.col("event_id").cast("string").alias("x"))), F.lit('],"confidence":'), F.col("value"), F.lit("}}")).alias("raw"),
                                                     F.col("event_id")).select("event_id", F.when(F.col("event_id") % 10 == 0, '{"x":1}').otherwise(F.col("raw")).alias("raw")), "event_id", "raw").groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("sure"), F.sum(F.size("actors")).alias("actors"))


def sc36(spark, d):
    return _ev(spark, d).select("event_id", records.metric(F.col("props"), ["found", "k"]).alias("n"))


def jn15(spark, d):
    s = _t(spark, d, "customer").select(F.col("c_custkey").alias("story"), "c_mktsegment")
    v = _ev(spark, d).where("event_type = 'view'").withColumn("story", F.col("event_id") % 400)
    return serving.reading_history(v, s, "user_id", "story", "ts", _ts(NOW), 5).select("event_id", "c_mktsegment", "rank", "is_today")


def agg1(spark, d):
    return telemetry.totals({n: _t(spark, d, n) for n in ("orders", "lineitem", "events", "documents")})


def agg2(spark, d):
    return telemetry.breakdown(_li(spark, d), ["l_returnflag", "l_linestatus"], "l_extendedprice")


def agg3(spark, d):
    c = _li(spark, d).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    p = _t(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return gates.page(c, [F.desc("n"), "l_partkey"], 100).join(p, "l_partkey", "left").select("l_partkey", "n", "p_name", F.when(F.col("p_name").isNotNull(), 0.95).otherwise(0.70).alias("confidence"))


def agg6(spark, d):
    return telemetry.sources_per_story(_li(spark, d), "l_orderkey", "l_suppkey")


def agg7(spark, d):
    return telemetry.discovery_effectiveness(_t(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderdate", _ts("2000-01-01"))


def agg8(spark, d):
    return telemetry.discovery_report(_ev(spark, d), "event_type", "ts", _ts(NOW))


def agg9(spark, d):
    e = _ev(spark, d).where((F.col("ts") <= _ts(NOW)) & (F.col("ts") > _ts(NOW) - F.expr("INTERVAL 24 HOURS")))
    return telemetry.series(e, "ts", "hour")


def agg10(spark, d):
    return telemetry.state_counts(_t(spark, d, "orders"), "o_orderstatus")


def agg11(spark, d):
    return telemetry.cost_projection(_ev(spark, d), "ts", "value", _ts(NOW))


def agg12(spark, d):
    o = _t(spark, d, "orders").where(F.col("o_orderdate") > _ts(ONOW) - F.expr("INTERVAL 7 DAYS"))
    return telemetry.series(o, "o_orderdate", "day", "o_totalprice")


def agg13(spark, d):
    return telemetry.latency_by(_ev(spark, d), "event_type", "value")


def agg14(spark, d):
    e = _ev(spark, d).withColumn("provider", F.col("user_id") % 7)
    return telemetry.health(e, ["provider"], F.col("event_type") == "error", "value")


def agg15(spark, d):
    e = _ev(spark, d).withColumn("stage", F.col("user_id") % 50)
    return telemetry.health(e, ["stage"], (F.col("event_type") == "error") & (F.col("value") > 60), "value", 0.0)


def agg16(spark, d):
    e = _ev(spark, d).withColumn("domain", F.col("user_id") % 20)
    kind = F.col("event_type")
    return telemetry.extraction_health(e, "domain", kind == "click", kind == "error", kind == "signup", F.when(kind == "purchase", F.col("value")))


def _decision():
    """The decision of a record is null for a tax of 0."""
    return F.when(F.col("l_tax") == 0, F.lit(None)).when(F.col("l_tax") > 0.06, "failed").otherwise("ok")


def agg17(spark, d):
    return telemetry.rates(_li(spark, d), ["l_returnflag", "l_linenumber"], success=_decision() != "failed", repaired=F.col("l_discount") > 0.08)


def agg18(spark, d):
    return telemetry.rates(_li(spark, d), ["l_linestatus", "l_linenumber"], success=_decision() != "failed", valid=F.col("l_discount") <= 0.05, retried=F.col("l_quantity") > 45, fallback=F.col("l_quantity") < 3)


def agg19(spark, d):
    return telemetry.percentiles(_li(spark, d), "l_linenumber", "l_extendedprice", 60000.0)


def agg20(spark, d):
    x = telemetry.rates(_li(spark, d).withColumn("g", F.col("l_suppkey") % 12), ["g"], hit_rate=F.col("l_discount") > 0.09)
    return x.withColumn("low_value", F.col("hit_rate") < 0.10)


def agg21(spark, d):
    x = _li(spark, d).where("l_tax > 0.07 AND l_discount > 0.09")
    return telemetry.reflection_analytics(x, "l_quantity", F.col("l_returnflag") == "R")


def agg22(spark, d):
    return telemetry.cost_forecast(_li(spark, d), "l_partkey", "l_orderkey", F.col("l_quantity"), F.col("l_tax"), [100, 1000, 10000, 100000, 1000000])


def agg23(spark, d):
    return telemetry.provider_sla(_li(spark, d), "l_returnflag", _decision() != "failed", (F.col("l_quantity") % 4).cast("int"), "l_extendedprice")


def agg24(spark, d):
    e = _ev(spark, d).withColumn("stage", F.col("user_id") % 60).withColumn("provider", F.col("user_id") % 4).withColumn("code", F.floor(F.col("value") / 50))
    return telemetry.failure_analytics(e, "stage", "provider", "code", F.col("event_type") == "error", F.col("event_id") % 3)


def agg25(spark, d):
    e = _ev(spark, d)
    return telemetry.failure_trend(e.where("event_type = 'error' AND hour(ts) < 12"), e.where("event_type = 'purchase'"), "ts", DAY)


def agg26(spark, d):
    return telemetry.stage_detail(_li(spark, d), "l_orderkey", "l_linestatus", "l_returnflag", "l_quantity", "l_shipdate", ["R", "A", "N"])


def agg27(spark, d):
    return telemetry.run_summary(_ev(spark, d), "user_id", "event_type", {"view": "viewed", "click": "clicked", "error": "failed"})


def agg28(spark, d):
    return telemetry.metrics_summary(_t(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_totalprice")


def agg32(spark, d):
    return telemetry.engagement(_ev(spark, d).withColumn("story", F.col("event_id") % 100), "story", "event_type", "view", "signup", "error", "click")


def agg33(spark, d):
    return telemetry.completion(_li(spark, d), "l_orderkey", "l_returnflag", ["A", "R"])


def agg34(spark, d):
    found = _li(spark, d).withColumnRenamed("l_orderkey", "o_orderkey")
    return telemetry.candidate_funnel(_t(spark, d, "orders"), found, "o_orderkey", "o_orderpriority", F.col("l_returnflag") == "A")


def agg37(spark, d):
    # a queue grows by two of five events and shrinks by two others
    change = F.when(F.col("event_id") % 5 < 2, 1).when(F.col("event_id") % 5 < 4, -1).otherwise(0) + F.when(F.col("event_type") == "error", 1).otherwise(0)
    five = telemetry.window_buckets(_ev(spark, d), "ts", 5, F.col("event_type") == "error", "value", change)
    return telemetry.alerts(telemetry.merge_windows(five, 360), 30.0, 0.05, 100)


def agg37b(spark, d):
    return telemetry.histogram(_ev(spark, d), "value", [1, 5, 10, 30, 60, 120])


def agg38(spark, d):
    e = _ev(spark, d).withColumn("domain", F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")))  # one domain has half of all attempts
    provider = F.element_at(F.array(F.lit("local"), F.lit("search"), F.lit("render")), (F.col("event_id") % 7 % 3 + 1).cast("int"))
    return telemetry.domain_policy(e, "domain", "ts", "event_id", provider, F.col("event_type") != "error", F.col("value"), F.col("value") * 10, {"local": 0.5, "search": 0.3, "render": 0.2})


def agg41(spark, d):
    return telemetry.token_usage(_li(spark, d), ["l_shipdate", "l_returnflag", "l_linestatus"], "l_quantity", F.col("l_tax") > 0.06, "l_extendedprice")


def win7(spark, d):
    x = serving.worst_attempts(_li(spark, d), ["l_orderkey", "l_linestatus"], F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0), "l_shipdate", "l_partkey")
    return x.select("l_orderkey", "l_linestatus", "l_returnflag", "l_shipdate", "l_partkey")


def win8(spark, d):
    last = gates.page(_t(spark, d, "orders").join(_li(spark, d).select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 1)
    return last.join(_li(spark, d), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", "l_suppkey")


def win14(spark, d):
    return serving.velocity(_ev(spark, d), "user_id", "ts", "event_id").select("event_id", "velocity")


def mnt1(spark, d):
    return telemetry.state_counts(maintenance.recover_stuck(_tasks(spark, d), "state", "o_orderdate", _ts(ONOW), 60 * 24 * 400), "state")


def mnt2(spark, d):
    return telemetry.state_counts(maintenance.retire_stale(_tasks(spark, d), "state", "o_orderdate", _ts(ONOW), 24 * 300), "state")


def mnt3(spark, d):
    return maintenance.reap_stuck(_tasks(spark, d), "state", "o_orderdate", _ts(ONOW), 60 * 24 * 200).groupBy("state", "reason").agg(F.count(F.lit(1)).alias("n"))


def mnt4(spark, d):
    return telemetry.state_counts(maintenance.retain(_tasks(spark, d), "state", "o_orderdate", _ts(ONOW), {"pending": 300, "failed": 140, "running": 70}), "state")


def mnt5(spark, d):
    x = maintenance.purge_redact(_tasks(spark, d), "o_orderdate", _ts(ONOW), ["o_totalprice"], 900, 400)
    return x.agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("o_totalprice").isNull()).alias("redacted"))


def mnt6(spark, d):
    return maintenance.due_retries(_tasks(spark, d), "state", "tries", "o_orderdate", _ts("2000-06-01")).select("o_orderkey")


def mnt7(spark, d):
    return maintenance.timed_out(_tasks(spark, d), "state", "o_orderdate", _ts(ONOW), 24 * 100, ("running", "processing")).select("o_orderkey")


def mnt8(spark, d):
    return maintenance.orphans(_t(spark, d, "embeddings"), _t(spark, d, "documents"), "vec_id", "doc_id")


def mnt9(spark, d):
    return maintenance.forget_users(_ev(spark, d), _t(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id")), "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def mnt10(spark, d):
    p = F.col("doc_id") % 9 == 0
    x = maintenance.signature_purge(_t(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang")), p, F.col("doc_id") % 9 < 1, ["text"])
    return x.agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"))


def mnt11(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") < 7, "m1").otherwise("m0").alias("model"))
    return maintenance.reembed_list(_t(spark, d, "documents"), v, "doc_id", "model", "m1")


_TASKS = "t AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'processing' END AS state, o_custkey % 5 AS tries, o_totalprice FROM orders)"
_OLD = lambda days: f"o_orderdate < TIMESTAMP '{ONOW}' - to_days({days})"
_OK = "count(*) FILTER (l_tax <> 0 AND l_tax <= 0.06)"
_R = lambda c: f"round(count(*) FILTER ({c}) / count(*)::DOUBLE, 6)"


QUERIES = {
    "src3_tables": (src3, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"))),
    "src6_upsert": (src6, """WITH b AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM events WHERE event_id % 3 = 0 AND user_id % 7 > 0 OR user_id % 5 = 0 GROUP BY 1), d AS (SELECT user_id, avg(value) AS v, count(*) AS k FROM events WHERE NOT (event_id % 3 = 0 AND user_id % 7 > 0 OR user_id % 5 = 0) GROUP BY 1)
        SELECT user_id, round(CASE WHEN m IS NULL THEN v WHEN v IS NULL THEN m ELSE 0.9 * m + 0.1 * v END, 6) AS mean, coalesce(n, 0) + coalesce(k, 0) AS n FROM b FULL JOIN d USING (user_id)"""),
    "src6_stream_upsert": (src6_stream, "SELECT user_id, event_type, count(*) AS n, max(value) AS most, max(ts) AS last FROM events GROUP BY 1, 2"),
    "src10_ingest_events": (src10, "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1"),
    "src11_validate_events": (src11, "SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'ok' WHEN event_type = 'purchase' THEN 'missing_key' ELSE 'unknown_event' END AS problem, count(*) AS n FROM events GROUP BY 1, 2"),
    "src13_append_log": (src13, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "flt11_failures": (flt11, "SELECT event_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 5"),
    "flt12_route_domains": (flt12, "SELECT user_id, count(*) >= 8 AND count(*) FILTER (event_type = 'signup') / count(*)::DOUBLE < 0.05 AND greatest(count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'view')) / count(*)::DOUBLE > 0.2 AS skip_local FROM events GROUP BY 1"),
    "sc23_clean_events": (sc23, """SELECT CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 10 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS n, round(sum(CASE WHEN event_id % 10 <> 0 THEN least(value, 1.0) END), 4) AS sure,
        CAST(sum(CASE WHEN event_id % 10 <> 0 THEN 2 END) AS BIGINT) AS actors FROM events GROUP BY 1, 2"""),
    "sc36_metric": (sc36, "SELECT event_id, CAST(props->>'k' AS BIGINT) AS n FROM events"),
    "jn15_reading_history": (jn15, f"""WITH v AS (SELECT event_id, event_id % 400 AS story, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE event_type = 'view')
        SELECT event_id, c_mktsegment, CAST(rank AS INTEGER) AS rank, CAST(ts AS DATE) = DATE '{DAY}' AS is_today FROM v LEFT JOIN customer ON c_custkey = story WHERE rank <= 5"""),
    "agg1_totals": (agg1, "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents"),
    "agg2_cost_breakdown": (agg2, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS cost, l_returnflag IS NULL AS is_total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())"),
    "agg3_entity_counts": (agg3, "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 100) SELECT l_partkey, n, p_name, CAST(CASE WHEN p_name IS NOT NULL THEN 0.95 ELSE 0.70 END AS DOUBLE) AS confidence FROM c LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey"),
    "agg6_sources_per_story": (agg6, "SELECT round(avg(s), 2) AS mean, round(median(s), 2) AS median FROM (SELECT count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_orderkey)"),
    "agg7_effectiveness": (agg7, "SELECT count(DISTINCT o_orderkey) AS articles, count(DISTINCT o_custkey) AS stories FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'"),
    "agg8_discovery_report": (agg8, f"SELECT event_type, count(*) FILTER (CAST(ts AS DATE) = DATE '{DAY}') AS today, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS week FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1"),
    "agg9_hourly": (agg9, f"SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events WHERE ts <= TIMESTAMP '{NOW}' AND ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR GROUP BY 1"),
    "agg10_state_counts": (agg10, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "agg11_cost_projection": (agg11, f"WITH c AS (SELECT sum(value) AS t FROM events WHERE ts >= TIMESTAMP '{DAY}' AND ts <= TIMESTAMP '{NOW}') SELECT round(t, 4) AS today, round(t / 15.5, 4) AS hourly, round(t / 15.5 * 24, 4) AS daily, round(t / 15.5 * 720, 4) AS monthly FROM c"),
    "agg12_daily": (agg12, f"SELECT date_trunc('day', o_orderdate) AS bucket, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate > TIMESTAMP '{ONOW}' - INTERVAL 7 DAY GROUP BY 1"),
    "agg13_latency": (agg13, "SELECT event_type, round(avg(value), 6) AS latency, round(sum(value), 2) AS total FROM events GROUP BY 1"),
    "agg14_provider_health": (agg14, "SELECT user_id % 7 AS provider, count(*) AS calls, " + _R("event_type = 'error'") + " AS error_rate, round(avg(value), 6) AS latency, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.1 AS degraded FROM events GROUP BY 1"),
    "agg15_stage_health": (agg15, "SELECT user_id % 50 AS stage, count(*) AS calls, " + _R("event_type = 'error' AND value > 60") + " AS error_rate, round(avg(value), 6) AS latency, count(*) FILTER (event_type = 'error' AND value > 60) > 0 AS degraded FROM events GROUP BY 1"),
    "agg16_extraction_health": (agg16, "SELECT user_id % 20 AS domain, round(count(*) FILTER (event_type = 'click') / greatest(count(*) FILTER (event_type IN ('click', 'error')), 1)::DOUBLE, 6) AS success, " + _R("event_type = 'signup'") + " AS fallback, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 2) AS credits FROM events GROUP BY 1"),
    "agg17_prompt_analytics": (agg17, f"SELECT l_returnflag, l_linenumber, count(*) AS n, round({_OK} / count(*)::DOUBLE, 6) AS success, {_R('l_discount > 0.08')} AS repaired FROM lineitem GROUP BY 1, 2"),
    "agg18_model_benchmarks": (agg18, f"SELECT l_linestatus, l_linenumber, count(*) AS n, round({_OK} / count(*)::DOUBLE, 6) AS success, {_R('l_discount <= 0.05')} AS valid, {_R('l_quantity > 45')} AS retried, {_R('l_quantity < 3')} AS fallback FROM lineitem GROUP BY 1, 2"),
    "agg19_context_percentiles": (agg19, "SELECT l_linenumber, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99, round(avg(l_extendedprice), 6) AS mean, max(l_extendedprice) AS largest, count(*) FILTER (l_extendedprice > 60000) AS above FROM lineitem GROUP BY 1"),
    "agg20_cache": (agg20, f"SELECT l_suppkey % 12 AS g, count(*) AS n, {_R('l_discount > 0.09')} AS hit_rate, {_R('l_discount > 0.09')} < 0.10 AS low_value FROM lineitem GROUP BY 1"),
    "agg21_reflection": (agg21, "SELECT count(*) AS n, coalesce(round(avg(l_quantity), 6), 0.0) AS mean, count(*) FILTER (l_returnflag = 'R') AS rejected FROM lineitem WHERE l_tax > 0.07 AND l_discount > 0.09"),
    "agg22_forecast": (agg22, "WITH u AS (SELECT sum(l_quantity) / count(DISTINCT l_partkey) + sum(l_tax) / count(DISTINCT l_orderkey) AS c FROM lineitem) SELECT CAST(v AS INTEGER) AS volume, round(c * v, 2) AS cost FROM u, (SELECT unnest([100, 1000, 10000, 100000, 1000000]) AS v)"),
    "agg23_sla": (agg23, f"SELECT l_returnflag, count(*) AS n, round({_OK} / count(*)::DOUBLE, 6) AS availability, CAST(sum(CAST(l_quantity AS INTEGER) % 4) AS BIGINT) AS retries, CAST(sum(CAST(l_quantity AS INTEGER) % 4) // 2 AS BIGINT) AS rate_limited, CAST(sum(CAST(l_quantity AS INTEGER) % 4) // 4 AS BIGINT) AS timeouts, round(avg(l_extendedprice), 4) AS latency FROM lineitem GROUP BY 1"),
    "agg24_failure_analytics": (agg24, """WITH e AS (SELECT CAST(user_id % 60 AS VARCHAR) AS s, CAST(user_id % 4 AS VARCHAR) AS p, CASE WHEN event_type = 'error' THEN CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) END AS c, event_type = 'error' AS f, event_id % 3 AS r FROM events),
        g AS (SELECT 'total' AS aspect, NULL AS key, count(*) FILTER (f) AS failures, round(avg(r) FILTER (f), 6) AS mean_retries, round(1 - count(*) FILTER (f) / count(*)::DOUBLE, 6) AS success FROM e
          UNION ALL SELECT 'stage', s, count(*) FILTER (f), round(avg(r) FILTER (f), 6), round(1 - count(*) FILTER (f) / count(*)::DOUBLE, 6) FROM e GROUP BY s
          UNION ALL SELECT 'provider', p, count(*) FILTER (f), round(avg(r) FILTER (f), 6), round(1 - count(*) FILTER (f) / count(*)::DOUBLE, 6) FROM e GROUP BY p
          UNION ALL SELECT 'code', c, count(*) FILTER (f), round(avg(r) FILTER (f), 6), NULL FROM e WHERE c IS NOT NULL GROUP BY c)
        SELECT * FROM g WHERE aspect <> 'stage' UNION ALL SELECT * FROM (SELECT * FROM g WHERE aspect = 'stage' ORDER BY failures DESC, key LIMIT 10)"""),
    "agg25_failure_trend": (agg25, f"""WITH c AS (SELECT CAST(unnest(generate_series(DATE '{DAY}' - 13, DATE '{DAY}', INTERVAL 1 DAY)) AS DATE) AS day), f AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' AND hour(ts) < 12 GROUP BY 1), s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
        SELECT day, coalesce(f.n, 0) AS failures, coalesce(s.n, 0) AS successes, round(CASE WHEN coalesce(f.n, 0) + coalesce(s.n, 0) > 0 THEN coalesce(f.n, 0) / (coalesce(f.n, 0) + coalesce(s.n, 0))::DOUBLE ELSE 0.0 END, 6) AS rate FROM c LEFT JOIN f USING (day) LEFT JOIN s USING (day)"""),
    "agg26_stage_detail": (agg26, "SELECT l_orderkey, l_linestatus, count(*) AS attempts, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, round(max(l_quantity), 2) AS largest, min(l_shipdate) AS first_start, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'A') THEN 'A' ELSE 'N' END AS status FROM lineitem GROUP BY 1, 2"),
    "agg27_run_summary": (agg27, "SELECT user_id, concat_ws(' · ', CASE WHEN v > 0 THEN v || ' viewed' END, CASE WHEN c > 0 THEN c || ' clicked' END, CASE WHEN e > 0 THEN e || ' failed' END) AS summary FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)"),
    "agg28_metrics": (agg28, "SELECT count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS failed, round(sum(o_totalprice), 2) AS cost FROM orders"),
    "agg32_engagement": (agg32, "SELECT event_id % 100 AS story, count(*) FILTER (event_type = 'view') AS views, greatest(count(*) FILTER (event_type = 'signup') - count(*) FILTER (event_type = 'error'), 0) AS bookmarks, count(*) FILTER (event_type = 'click') AS shares FROM events GROUP BY 1"),
    "agg33_completion": (agg33, "SELECT l_orderkey, count(*) AS children, bool_and(l_returnflag IN ('A', 'R')) AS done FROM lineitem GROUP BY 1"),
    "agg34_funnel": (agg34, "SELECT o_orderpriority, count(DISTINCT o_orderkey) AS found, count(DISTINCT l_orderkey) AS crawled, count(l_orderkey) AS articles, count(*) FILTER (l_returnflag = 'A') AS clustered FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"),
    "agg37_alerts": (agg37, """WITH e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type = 'error' AS bad, CASE WHEN event_id % 5 < 2 THEN 1 WHEN event_id % 5 < 4 THEN -1 ELSE 0 END + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS change,
            coalesce(list_filter([0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]::DOUBLE[], lambda x: value <= x)[1], 'inf'::DOUBLE) AS upto FROM events),
        w AS (SELECT start, count(*) AS n, count(*) FILTER (bad) / count(*)::DOUBLE AS rate, CAST(sum(sum(change)) OVER (ORDER BY start) AS BIGINT) AS backlog FROM e GROUP BY start),
        b AS (SELECT start, upto, count(*) AS k FROM e GROUP BY 1, 2), c AS (SELECT *, sum(k) OVER (PARTITION BY start ORDER BY upto) AS upper, sum(k) OVER (PARTITION BY start) AS total FROM b),
        q AS (SELECT start, arg_min(upto, upto) AS upto, arg_min(upper, upto) AS upper, arg_min(k, upto) AS k, any_value(total) AS total FROM c WHERE upper >= 0.95::DOUBLE * total GROUP BY start),
        p AS (SELECT start, CASE WHEN isinf(upto) THEN 300 ELSE low + (upto - low) * (0.95::DOUBLE * total - (upper - k)) / k END AS p95 FROM (SELECT *, coalesce(list_filter([0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]::DOUBLE[], lambda x: x < upto)[-1], 0) AS low FROM q))
        SELECT start, n, round(p95, 6) AS p95, round(rate, 6) AS rate, backlog, p95 > 30 AS is_slow, rate > 0.05 AS is_failing, backlog > 100 AS is_behind FROM w JOIN p USING (start)"""),
    "agg37_histogram": (agg37b, "SELECT CAST(CASE WHEN value <= 1 THEN 1 WHEN value <= 5 THEN 5 WHEN value <= 10 THEN 10 WHEN value <= 30 THEN 30 WHEN value <= 60 THEN 60 WHEN value <= 120 THEN 120 ELSE 'inf'::DOUBLE END AS DOUBLE) AS upto, count(*) AS n FROM events GROUP BY 1"),
    "agg38_domain_policy": (agg38, """WITH RECURSIVE e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS domain, ['local', 'search', 'render'][event_id % 7 % 3 + 1] AS p, event_type <> 'error' AS ok, value AS v, ts, event_id FROM events),
        x AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY domain) AS n FROM e),
        r AS (SELECT domain, rn, n, CASE WHEN p = 'local' AND ok THEN 1.0::DOUBLE ELSE 0 END AS a, CASE WHEN p = 'search' AND ok THEN 1.0::DOUBLE ELSE 0 END AS b, CASE WHEN p = 'render' AND ok THEN 1.0::DOUBLE ELSE 0 END AS c, v AS l, v * 10 AS z, CASE WHEN ok THEN p END AS last, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END AS first,
            (p = 'local')::BIGINT AS na, (p = 'search')::BIGINT AS nb, (p = 'render')::BIGINT AS nc FROM x WHERE rn = 1
          UNION ALL SELECT x.domain, x.rn, x.n, CASE WHEN p = 'local' THEN 0.9::DOUBLE * a + CASE WHEN ok THEN 0.1::DOUBLE ELSE 0 END ELSE a END, CASE WHEN p = 'search' THEN 0.9::DOUBLE * b + CASE WHEN ok THEN 0.1::DOUBLE ELSE 0 END ELSE b END, CASE WHEN p = 'render' THEN 0.9::DOUBLE * c + CASE WHEN ok THEN 0.1::DOUBLE ELSE 0 END ELSE c END,
            0.9::DOUBLE * l + 0.1::DOUBLE * v, CASE WHEN ok THEN 0.9::DOUBLE * z + 0.1::DOUBLE * v * 10 ELSE z END, CASE WHEN ok THEN p ELSE last END, first, na + (p = 'local')::BIGINT, nb + (p = 'search')::BIGINT, nc + (p = 'render')::BIGINT FROM r JOIN x ON x.domain = r.domain AND x.rn = r.rn + 1)
        SELECT domain, n AS attempts, na AS local_attempts, nb AS search_attempts, nc AS render_attempts, round(a, 6) AS local_rate, round(b, 6) AS search_rate, round(c, 6) AS render_rate, round(l, 6) AS latency, round(z, 6) AS length, last AS last_success,
          round(CASE WHEN n = 1 THEN first ELSE 0.5::DOUBLE * a + 0.3::DOUBLE * b + 0.2::DOUBLE * c END, 6) AS confidence FROM r WHERE rn = n"""),
    "agg41_daily_usage": (agg41, "SELECT l_shipdate, l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS tokens, count(*) AS calls, count(*) FILTER (l_tax > 0.06) AS errors, round(avg(l_extendedprice), 6) AS latency FROM lineitem GROUP BY 1, 2, 3"),
    "win7_worst_attempts": (win7, "SELECT l_orderkey, l_linestatus, l_returnflag, l_shipdate, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END DESC, l_shipdate DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1"),
    "win8_latest_run": (win8, "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey = (SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)"),
    "win14_velocity": (win14, "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS velocity FROM events"),
    "mnt1_recover_stuck": (mnt1, f"WITH {_TASKS} SELECT CASE WHEN state = 'processing' AND {_OLD(400)} THEN 'pending' ELSE state END AS state, count(*) AS n FROM t GROUP BY 1"),
    "mnt2_retire_stale": (mnt2, f"WITH {_TASKS} SELECT CASE WHEN state = 'pending' AND {_OLD(300)} THEN 'skipped' ELSE state END AS state, count(*) AS n FROM t GROUP BY 1"),
    "mnt3_reap_stuck": (mnt3, f"WITH {_TASKS} SELECT CASE WHEN state = 'running' AND {_OLD(200)} THEN 'failed' ELSE state END AS state, CASE WHEN state = 'running' AND {_OLD(200)} THEN 'no end within {60 * 24 * 200} minutes' END AS reason, count(*) AS n FROM t GROUP BY 1, 2"),
    "mnt4_retention": (mnt4, f"WITH {_TASKS} SELECT state, count(*) AS n FROM t WHERE NOT (state = 'pending' AND {_OLD(300)}) AND NOT (state = 'failed' AND {_OLD(140)}) AND NOT (state = 'running' AND {_OLD(70)}) GROUP BY 1"),
    "mnt5_purge_redact": (mnt5, f"SELECT count(*) AS kept, count(*) FILTER ({_OLD(400)}) AS redacted FROM orders WHERE NOT {_OLD(900)}"),
    "mnt6_due_retries": (mnt6, f"WITH {_TASKS} SELECT o_orderkey FROM t WHERE state = 'failed' AND tries < 3 AND o_orderdate <= TIMESTAMP '2000-06-01'"),
    "mnt7_timed_out": (mnt7, f"WITH {_TASKS} SELECT o_orderkey FROM t WHERE state IN ('running', 'processing') AND {_OLD(100)}"),
    "mnt8_orphans": (mnt8, "SELECT vec_id AS id, 'vector' AS kind FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'article' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"),
    "mnt9_forget_users": (mnt9, "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1"),
    "mnt10_signature_purge": (mnt10, "SELECT count(*) AS n, count(text) AS texts FROM documents WHERE doc_id % 9 <> 0"),
    "mnt11_reembed": (mnt11, "SELECT doc_id, CASE WHEN label < 7 THEN 'm1' WHEN label >= 7 THEN 'm0' END AS model FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE label IS NULL OR label >= 7"),
}
