"""What the training-data operators share: table access, shared storage and bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import bounded_batches, counted_cut, cut, on_driver  # noqa: F401

#: A word is a run of anything but the six ASCII white-space characters.
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels no model may learn from: crc32 of the id's text leaves 2 modulo 4 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text", max_bytes: int = 32 << 20):
    """Up to ``per_class`` whole labelled texts of either class, on the driver, for fitting.

    Ids are taken by their md5, so a rerun takes the same ones; of the texts found, in that order, those of a class are
    taken until ``max_bytes`` are reached (the last one still whole), so the driver holds twice that and two texts at
    most. An id with several labels has the largest. Null labels, ids and texts are not learned from. Returns a pandas
    frame (text, y).
    """
    one = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("y"))
           .withColumn("_k", F.md5(F.col("_id").cast("string"))))
    picked = [one.where(F.col("y") == c).orderBy("_k", "_id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(cut(picked[0].unionByName(picked[1])))  # at most 2 * per_class rows
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null").join(ids, "_id")
    # sizes first: repeated ids or long texts must not reach the driver unbounded
    sizes = rows.groupBy("y", "_k", "_id").agg(F.sum(F.octet_length("text")).alias("n"))
    upto = Window.partitionBy("y").orderBy("_k", "_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = cut(sizes.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("before") < max_bytes).select("_id"))
    found = on_driver(rows.join(F.broadcast(chosen), "_id").select("_k", "_id", "text", "y"))
    return found.sort_values(["_k", "_id", "text"], ignore_index=True)[["text", "y"]]
