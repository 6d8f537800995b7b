"""Audit of how filters interact: every order of them at once, by wide packed counters."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table
from .covering import word_blocks

FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bytes of a field. Counts are below 2**63, so no sum carries into the next field.
FIELD = 8
_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"
_HELD = 64


def failures(text: bytes) -> int:
    """Bits of the first four filters that a text fails: A under 100 words, B 100 * distinct words < 80 * words, C
    100 * capitals A-Z > 10 * code points, D any of ``#$%&*|``."""
    n, seen = 0, set()
    for words in word_blocks(text):
        n += len(words)
        seen.update(words)
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    return (n < 100) + 2 * (100 * len(seen) < 80 * n) + 4 * (100 * capitals > 10 * points) + 8 * (len(text.translate(None, _MARKS)) != len(text))


def text_failures(docs: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, fails, text_key) of every whole text (null: empty), in one pass: ``fails`` as in ``failures``,
    ``text_key`` a 128-bit hash. A null part is the empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([failures(t) for t in texts], pa.int32()),
                                              pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())], ["doc_id", "part", "fails", "text_key"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, part string, fails int, text_key binary")


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail which of the five filters.

    E fails if any smaller id has the same text, in whichever part. Rows with a null id are not compared; of rows that
    share the least id of a text none fails. ``good`` and ``toxic`` say whether a label of the id has quality 1, toxic 1.
    Rows are counted by id, then by text, before they meet, so a text with any number of copies is a few rows.
    """
    rows = cut(text_failures(docs, part, id_col, text_col))
    says = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    says = says.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    named = rows.where("doc_id is not null").groupBy("doc_id", "part", "fails", "text_key").agg(F.count(F.lit(1)).alias("n"))
    named = named.join(says, "doc_id", "left").select("doc_id", "part", "fails", "text_key", "n", flag("good"), flag("toxic"))
    texts = named.groupBy("text_key", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("text_key"))
    fine = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0).cast("long"))
    split = F.inline(F.array(F.struct(F.col("fails").alias("mask"), fine.alias("n")), F.struct((F.col("fails") + 16).alias("mask"), (F.col("n") - fine).alias("n"))))
    told = texts.withColumn("least", least).select("part", "good", "toxic", split).select("part", "mask", "good", "toxic", "n")
    nameless = rows.where("doc_id is null").groupBy("part", F.col("fails").alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    return told.where("n > 0").unionByName(nameless.select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n"))


@functools.lru_cache(4)
def packed(filters: str) -> list[int]:
    """For mask * 4 + good * 2 + toxic: an integer with a field for every measure of every step of every order, 1 where one
    such document counts. The first field is the lowest."""
    out = []
    for mask in range(1 << len(filters)):
        for good in (0, 1):
            for toxic in (0, 1):
                fields = bytearray()
                for order in permutations(range(len(filters))):
                    gone = False
                    for f in order:
                        fails = bool(mask >> f & 1)
                        removed = fails and not gone
                        for one in (not gone and not fails, removed, fails and gone, mask == 1 << f, removed and good, removed and toxic):
                            fields += int(bool(one)).to_bytes(FIELD, "little")
                        gone = gone or fails
                out.append(int.from_bytes(bytes(fields), "little"))
    return out


def unpack(total: int, filters: str) -> dict[str, list]:
    """Columns of a part's rows from its sum: orders and steps in order, measures and Shapley sums."""
    orders = list(permutations(range(len(filters))))
    steps = len(filters)
    x = np.frombuffer(total.to_bytes(len(orders) * steps * len(MEASURES) * FIELD, "little"), "<i8").reshape(len(orders), steps, len(MEASURES))
    at = np.array(orders)
    share = np.zeros(steps, np.int64)
    np.add.at(share, at.reshape(-1), x[:, :, 1].reshape(-1))
    cols = {"filter_order": ["".join(filters[f] for f in o) for o in orders for _ in o], "step": list(range(1, steps + 1)) * len(orders)}
    return cols | {m: x[:, :, i].reshape(-1) for i, m in enumerate(MEASURES)} | {"shapley": share[at.reshape(-1)]}


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from (part, mask, good, toxic, n), where bit i of ``mask`` is
    set if the i-th filter fails.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): with five filters
    600 rows a part. Each mask stands for one big integer that has a field for each measure of each step; a task adds the
    integers of its rows by part, and the sums are added by part and a salt, then by part. Tasks read parts one after
    the other, so they hold a single sum, and at most 64 while rows come in any order. An empty table gives no rows.
    """
    size = len(packed(filters)[0].to_bytes(len(list(permutations(filters))) * len(filters) * len(MEASURES) * FIELD, "little"))

    def as_batch(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.to_bytes(size, "little") for v in sums.values()], pa.binary())], ["part", "total"])

    def add_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sums = packed(filters), {}
        for b in batches:
            part = b.column(0).dictionary_encode()
            mask, good, toxic, n = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
            found, where = np.unique(np.stack([part.indices.to_numpy(zero_copy_only=False), mask * 4 + good * 2 + toxic]), axis=1, return_inverse=True)
            times = np.zeros(found.shape[1], np.int64)
            np.add.at(times, where.reshape(-1), n)
            names = part.dictionary.to_pylist()
            for p, k, m in zip(*found.tolist(), times.tolist(), strict=True):
                sums[names[p]] = sums.get(names[p], 0) + m * unit[k]
                if len(sums) > _HELD:
                    yield as_batch(sums)
                    sums = {}
        yield as_batch(sums)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        held, total = None, 0
        for b in batches:
            for p, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if p != held:
                    if held is not None:
                        yield held, total
                    held, total = p, 0
                total += int.from_bytes(t.as_py(), "little")
        if held is not None:
            yield held, total

    def add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, t in in_order(batches):
            yield as_batch({p: t})

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, t in in_order(batches):
            cols = unpack(t, filters)
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(cols["step"])), pa.array(cols["filter_order"]), pa.array(cols["step"], pa.int32()),
                                              *[pa.array(np.ascontiguousarray(cols[m]), pa.int64()) for m in (*MEASURES, "shapley")]], ["part", *list(cols)])

    bounded_batches(counts.sparkSession)
    salt: Column = F.spark_partition_id() % 64
    sums = counts.select("part", *[F.col(c).cast("long") for c in ("mask", "good", "toxic", "n")]).mapInArrow(add_masks, "part string, total binary").withColumn("salt", salt)
    sums = sums.repartition("part", "salt").select("part", "total").sortWithinPartitions("part").mapInArrow(add_sums, "part string, total binary")
    longs = ", ".join(f"{m} long" for m in (*MEASURES, "shapley"))
    return sums.repartition("part").sortWithinPartitions("part").mapInArrow(tell, f"part string, filter_order string, step int, {longs}")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the five filters of ``failures`` and ``masks`` interact over ``docs``, by part; see ``interactions``.

    Null texts are empty, null parts the empty part, repeated rows count as often as they come. Only the named columns are
    read.
    """
    return interactions(masks(docs, labels, part, id_col, text_col))


def op12_filter_audit(spark, sf_dir):
    """Outcomes of all orders of the five filters, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, 1 << (ascii(filter_order[step]) - 65) AS own,
    CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS BIGINT) AS earlier FROM o, range(1, 6) AS r(step)),
c AS (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN mask & (own + earlier) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 AND good = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 AND toxic = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM c
"""
