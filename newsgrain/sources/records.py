"""Tables, events and feeds as DataFrames with declared schemas, and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "title string, link string, description string, pubDate string, published string, updated string, created string"
SCENARIOS = ("scenario_id string, description string, category string, articles array<struct<title:string,description:string,content:string>>, expected_headline_keywords array<string>, "
             "expected_category string, min_key_facts int, forbidden_words array<string>")  # fmt: skip
EVENT = ("struct<primary_event:struct<event_type:string,actors:array<string>,targets:array<string>,objects:array<string>,location:string,event_time:string,confidence:double>>")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def read_feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Feed entries with a link, its canonical form, and their raw dates."""
    from ..functions.url import canonicalize_url

    rows = spark.read.format("xml").option("rowTag", tag).schema(FEED).load(path)
    return rows.where(F.coalesce(F.trim("link"), F.lit("")) != "").withColumn("canonical", canonicalize_url(F.col("link")))


def parse_time(c: Column) -> Column:
    """A time in one of the forms that feeds use; null if in none."""
    forms = ("EEE, dd MMM yyyy HH:mm:ss Z", "EEE, dd MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    # the parser takes no names of days, so these go first
    bare = F.regexp_replace(c, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(bare if f.startswith("EEE") else c, F.lit(f.removeprefix("EEE, ").replace("dd MMM", "d MMM"))) for f in forms])


def entry_pub_date(df: DataFrame, now: Column) -> DataFrame:
    """``published_at``: the first date that can be read, else ``now``."""
    return df.withColumn("published_at", F.coalesce(*[parse_time(F.col(c)) for c in ("pubDate", "published", "updated", "created") if c in df.columns], now.cast("timestamp")))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENARIOS).option("multiLine", True).json(path)


def ingest_events(events: DataFrame) -> DataFrame:
    """Interaction events in their declared types; works on static and streaming frames alike."""
    return events.select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp_ntz"), F.col("user_id").cast("long"), F.col("event_type").cast("string"), F.col("value").cast("double"), F.col("props").cast("string"))


def validate_events(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``problem``: ok, unknown_event, or missing_key where the payload lacks a required key."""
    keys = F.coalesce(F.map_keys(F.from_json("props", "map<string,string>")), F.array().cast("array<string>"))
    x = events.join(catalogue, "event_type", "left")
    return x.withColumn("problem", F.when(F.col("required").isNull(), "unknown_event").when(F.size(F.array_except("required", keys)) > 0, "missing_key").otherwise("ok")).drop("required")


def clean_events(df: DataFrame, key: str, raw: str) -> DataFrame:
    """Extracted events: type, trimmed actors and confidence in 0..1; rows without a primary event have status error."""
    p = F.from_json(raw, EVENT)["primary_event"]
    x = df.select(key, p.alias("p"))
    actors = F.filter(F.transform(F.coalesce(F.col("p.actors"), F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    ok = F.col("p").isNotNull()
    return x.select(key, F.when(ok, F.coalesce(F.trim("p.event_type"), F.lit("OTHER"))).alias("event_type"), F.when(ok, actors).alias("actors"),
                    F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("p.confidence", F.lit(0.5))))).alias("confidence"), F.when(ok, "ok").otherwise("error").alias("status"))


def metric(json: Column, names: Sequence[str]) -> Column:
    """First counter of the given names under metrics, output, outputs or the top, as a whole number."""
    places = ("$.metrics.", "$.output.", "$.outputs.", "$.")
    return F.coalesce(*[F.get_json_object(json, p + n).try_cast("long") for p in places for n in names])


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows.select(*log.columns))


def write_sitemap(df: DataFrame, path: str) -> None:
    """Write (loc, title, publication_date) as XML, escaped by the writer."""
    df.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").mode("overwrite").save(path)
