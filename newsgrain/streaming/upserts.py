"""A keyed table that a stream keeps up: batches are merged into hash buckets, and every batch leaves a snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.dedup import upsert


class UpsertTable:
    """Rows by key, in ``buckets`` hash buckets under ``path``, a folder that driver and executors share.

    Version n of the table is what batch n - 1 left; version 0 is empty. A batch reads the version before it, merges the
    buckets that its keys fall into, and writes these, and nothing else, into a folder of its own. A manifest, written
    last, says of each bucket which folder has it: a few rows, whatever the size of the table. A batch that is run again
    reads the same version and replaces the same folder and manifest, so it changes nothing, and readers of any
    complete version are not disturbed. A stream that has one checkpoint for good gives batches their numbers.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.empty = spark.createDataFrame([], schema)
        self.stored = StructType([*self.empty.schema.fields, StructField("bucket", IntegerType())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int) -> dict[int, int]:
        """Which version's folder has each bucket."""
        if not version:
            return {}
        return {r["bucket"]: r["held_by"] for r in self.spark.read.schema("bucket int, held_by int").parquet(f"{self.path}/manifest/version={version}").collect()}  # at most ``buckets`` rows

    def latest(self) -> int:
        """The last complete version."""
        try:
            return self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0] or 0
        except AnalysisException:  # nothing was ever merged
            return 0

    def snapshot(self, version: int, only: Sequence[int] | None = None) -> DataFrame:
        """The table as of a version, or some of its buckets."""
        held = {b: v for b, v in self.manifest(version).items() if only is None or b in set(only)}
        out = self.empty
        for v in sorted(set(held.values())):
            mine = [b for b, w in held.items() if w == v]
            rows = self.spark.read.schema(self.stored).parquet(f"{self.path}/data/{v}").where(F.col("bucket").isin(*mine)).drop("bucket")
            out = out.unionByName(rows)
        return out

    def merge(self, delta: DataFrame, batch: int, exprs: dict[str, Column]) -> None:
        """Merge batch number ``batch``, one row a key; ``exprs`` as in ``dedup.upsert``."""
        delta = delta.persist()
        try:
            touched = [r[0] for r in delta.select(self._bucket()).distinct().collect()]
            old = self.manifest(batch)
            merged = upsert(self.snapshot(batch, touched), delta, self.keys, exprs).select(self.empty.columns)
            merged.withColumn("bucket", self._bucket()).repartition("bucket", *self.keys).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/{batch + 1}")
            rows = sorted((old | dict.fromkeys(touched, batch + 1)).items())
            self.spark.createDataFrame(rows, "bucket int, held_by int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={batch + 1}")
        finally:
            delta.unpersist()

    def follow(self, stream: DataFrame, each: Sequence[Column], exprs: dict[str, Column], seconds: int = 600) -> int:
        """Merge what the stream has now, each batch aggregated to one row a key by ``each``; the version reached."""

        def keep(batch: DataFrame, i: int) -> None:
            self.merge(batch.groupBy(*self.keys).agg(*each), i, exprs)

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        if not q.awaitTermination(seconds):
            q.stop()
            raise TimeoutError(f"the stream ran longer than {seconds} s")
        return self.latest()
