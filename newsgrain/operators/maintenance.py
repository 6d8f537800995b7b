"""Set-based upkeep of state: recovery, expiry, retention, purges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recover_stuck(df: DataFrame, state: str, ts: str, now: Column, minutes: int = 30, stuck: str = "processing", back: str = "pending") -> DataFrame:
    late = (F.col(state) == stuck) & (F.col(ts) < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return df.withColumn(state, F.when(late, back).otherwise(F.col(state)))


def retire_stale(df: DataFrame, state: str, ts: str, now: Column, hours: int = 72, open_: tuple = ("pending",), null_is_open: bool = False) -> DataFrame:
    """Old open rows become skipped. A null state counts as open only if asked for."""
    is_open = F.col(state).isin(*open_) | (F.col(state).isNull() if null_is_open else F.lit(False))
    return df.withColumn(state, F.when(is_open & (F.col(ts) < now - F.expr(f"INTERVAL {hours} HOURS")), "skipped").otherwise(F.col(state)))


def reap_stuck(df: DataFrame, state: str, ts: str, now: Column, minutes: int = 60) -> DataFrame:
    late = (F.col(state) == "running") & (F.col(ts) < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return df.withColumn("reason", F.when(late, F.lit(f"no end within {minutes} minutes"))).withColumn(state, F.when(late, "failed").otherwise(F.col(state)))


def retain(df: DataFrame, state: str, ts: str, now: Column, days: Mapping[str, int]) -> DataFrame:
    """Rows younger than their state's days; states without a rule stay."""
    keep = F.coalesce(*[F.when(F.col(state) == k, F.col(ts) >= now - F.expr(f"INTERVAL {v} DAYS")) for k, v in days.items()], F.lit(True))
    return df.where(keep)


def purge_redact(df: DataFrame, ts: str, now: Column, heavy: list[str], purge_days: int = 30, redact_days: int = 14) -> DataFrame:
    """Rows younger than ``purge_days``; of those older than ``redact_days`` the heavy columns are nulled."""
    age = lambda d: F.col(ts) < now - F.expr(f"INTERVAL {d} DAYS")
    out = df.where(~age(purge_days))
    for c in heavy:
        out = out.withColumn(c, F.when(age(redact_days), F.lit(None)).otherwise(F.col(c)))
    return out


def due_retries(df: DataFrame, state: str, tries: str, at: str, now: Column, most: int = 3) -> DataFrame:
    return df.where((F.col(state) == "failed") & (F.col(tries) < most) & (F.col(at) <= now))


def timed_out(df: DataFrame, state: str, ts: str, now: Column, hours: int = 6, open_: tuple = ("collecting", "searching")) -> DataFrame:
    return df.where(F.col(state).isin(*open_) & (F.col(ts) < now - F.expr(f"INTERVAL {hours} HOURS")))


def orphans(vectors: DataFrame, articles: DataFrame, vec_key: str, key: str) -> DataFrame:
    """Vectors without an article and articles without a vector: (id, kind)."""
    v, a = vectors.select(F.col(vec_key).alias("id")), articles.select(F.col(key).alias("id"))
    return v.join(a, "id", "left_anti").withColumn("kind", F.lit("vector")).unionByName(a.join(v, "id", "left_anti").withColumn("kind", F.lit("article")))


def forget_users(df: DataFrame, users: DataFrame, user: str) -> DataFrame:
    return df.join(users.select(user).distinct(), user, "left_anti")


def signature_purge(df: DataFrame, first: Column, second: Column, cols: list[str]) -> DataFrame:
    """Null the columns of rows that bear both signatures, and drop rows of which nothing is left. Refuses if some row
    bears one signature without the other, since then one of them is wrong."""
    n = df.agg(F.count_if(first & second).alias("both"), F.count_if(first != second).alias("one")).first()
    if n["one"]:
        raise ValueError(f"the signatures disagree on {n['one']} rows ({n['both']} bear both)")
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(first & second, F.lit(None)).otherwise(F.col(c)))
    return out.where(~(first & second) | F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull())


def reembed_list(articles: DataFrame, vectors: DataFrame, key: str, model: str, target: str) -> DataFrame:
    """Articles whose vector is of another model, or missing."""
    return articles.join(vectors.select(key, model), key, "left").where(F.col(model).isNull() | (F.col(model) != target)).select(key, model)
