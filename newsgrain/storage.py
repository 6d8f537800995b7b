"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where none is set, a local folder serves a local master; on a cluster that is an error,
    as each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='newsgrain-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/newsgrain-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back: later steps start from files, whatever executors are lost."""
    spark = df.sparkSession
    path = new_place(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted_cut(df: DataFrame, *more: Column) -> tuple:
    """What ``cut`` gives, with the number of rows, and more aggregates, all taken while the table is written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(f"m{i}") for i, c in enumerate(more)]))
    return out, seen.get["n"], *[seen.get[f"m{i}"] for i in range(len(more))]


def on_driver(df: DataFrame) -> pd.DataFrame:
    """A bounded table on the driver; what Arrow held to bring it there is given back, not kept for the rest of the session."""
    found = df.toPandas()
    pa.default_memory_pool().release_unused()
    return found


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hold Arrow batches to ``rows`` rows, so that a worker holds few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
