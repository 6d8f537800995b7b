"""Packing token ids into windows: bounded-space online packing in each partition, then a merge of what is left over."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table
from .tokens import WordCoder, vocabulary_path

_SPAN = 1 << 32
_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "seq", "offset", "chunk")


class OpenWindows:
    """At most ``space`` open windows of ``size`` ids. ``put`` gets a document's ids as bytes of 32-bit numbers."""

    def __init__(self, size: int, space: int, emit):
        self.size, self.space, self.emit = size, space, emit
        self.open: list[tuple[int, list]] = []  # (filled, pieces); a piece: (doc, ids, start, doc_tokens)
        self.next = 0

    def _close(self, pieces: list, chunk: int | None = None) -> None:
        at = 0
        for doc, ids, start, total in pieces:
            self.emit((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at, chunk))
            at += len(ids) // 4
        self.next += 1

    def put(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        view = memoryview(ids)
        while total - at >= self.size:
            self._close([(doc, view[4 * at : 4 * (at + self.size)], at, total)])
            at += self.size
        while at < total:
            need = total - at
            best = max((i for i, (n, _) in enumerate(self.open) if self.size - n >= need), key=lambda i: (self.open[i][0], -i), default=None)
            if best is None and len(self.open) < self.space:
                self.open.append((need, [(doc, bytes(view[4 * at :]), at, total)]))
                return
            if best is None:  # none fits: the fullest takes as much as it can and leaves
                best = max(range(len(self.open)), key=lambda i: (self.open[i][0], -i))
            filled, pieces = self.open[best]
            take = min(need, self.size - filled)
            pieces.append((doc, bytes(view[4 * at : 4 * (at + take)]), at, total))
            at += take
            if filled + take == self.size:
                del self.open[best]
                self._close(pieces)
            else:
                self.open[best] = (filled + take, pieces)

    def finish(self) -> None:
        """Fill whole windows from what is open; the rest, under one window, leaves in chunks whose sizes are powers of two."""
        rest = [p for _, pieces in sorted(self.open, key=lambda x: -x[0]) for p in pieces]
        left = sum(len(p[1]) for p in rest) // 4
        while rest:
            goal = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            got, own = 0, []
            while got < goal:
                doc, ids, start, total = rest.pop(0)
                take = min(goal - got, len(ids) // 4)
                own.append((doc, ids[: 4 * take], start, total))
                if 4 * take < len(ids):
                    rest.insert(0, (doc, ids[4 * take :], start + take, total))
                got += take
            self._close(own, None if goal == self.size else goal)
            left -= goal
        self.open = []


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, space: int = 16, end_id: int = 2,
         path: str | None = None, group: int = 64) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` ids (a power of two):
    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is the ids of its whole text and then ``end_id`` (so null and empty texts have one id). Each partition
    keeps ``space`` open windows. A document goes, whole, into the fullest window that it fits; if it fits none and
    all are open, the fullest is filled up with its first ids and emitted, so emitted sequences are full. What is left
    over in a partition is under one window and leaves in chunks of power-of-two sizes; chunks of ``group`` partitions
    are merged by descending size, which never cuts a chunk, and only their last sequences are shorter than ``size``,
    each a power of two long. No sequence needs padding.

    Rows keep their multiplicity; ids may be null or repeat. An empty table gives an empty result. Pieces, not ids, are
    what is stored between the steps. Only the two named columns are read.
    """
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, out, end = WordCoder(path), TaskContext.get().partitionId(), [], end_id.to_bytes(4, "little")
        windows = OpenWindows(size, space, out.append)
        id_type = None

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            out.clear()
            arrays = [pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:]]
            arrays.insert(5, pa.array([part] * len(arrays[0]), pa.int64()))
            return pa.RecordBatch.from_arrays(arrays, list(_NAMES))

        for b in batches:
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                windows.put(doc, (coder.encode(text) if text else b"") + end)
            yield flush()
        if id_type is not None:
            windows.finish()
            yield flush()

    bounded_batches(docs.sparkSession)
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, seq long, offset long, chunk long"
    pieces = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = pieces.where(F.col("chunk").isNull()).withColumn("sequence_id", (F.col("part") * _SPAN + F.col("seq")) * 2)

    left = pieces.where(F.col("chunk").isNotNull()).withColumn("_g", F.floor(F.col("part") / group))
    chunks = left.select("_g", "part", "seq", "chunk").distinct()  # under log2(size) a partition, so few a group
    down = Window.partitionBy("_g").orderBy(F.desc("chunk"), "part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (chunks.withColumn("_at", F.coalesce(F.sum("chunk").over(down), F.lit(0)))
              .withColumn("_all", F.sum("chunk").over(Window.partitionBy("_g"))))
    # the last sequence, m ids long, is cut into the powers of two of m; as sizes descend, no chunk lies across a cut
    m, at = F.col("_all") % size, F.col("_at")
    tail = at >= F.col("_all") - m
    at_in = at - (F.col("_all") - m)
    begin, rank = F.lit(0).cast("long"), F.lit(0)
    for k in range(size.bit_length() - 2, -1, -1):
        upto = (m.bitwiseAND(F.lit(-(1 << k)).cast("long")))  # m without its bits under k
        has = m.bitwiseAND(F.lit(1 << k).cast("long")) != 0
        begin = F.when(has & (at_in >= upto), upto).otherwise(begin)
        rank = F.when(has & (at_in >= upto), F.lit(size.bit_length() - k)).otherwise(rank)
    chunks = (chunks.withColumn("_to", F.when(tail, at_in - begin).otherwise(at % size))
              .withColumn("sequence_id", ((F.col("_g") * _SPAN + F.floor(at / size) * 64 + F.when(tail, rank).otherwise(0)) * 2 + 1)))
    merged = left.join(chunks.select("part", "seq", "sequence_id", "_to"), ["part", "seq"]).withColumn("offset", F.col("offset") + F.col("_to"))
    return full.select(*names).unionByName(merged.select(*names))


def op7_pack(spark, sf_dir):
    """Pieces of all documents in sequences of 4,096 ids."""
    return pack(table(spark, sf_dir, "documents"))
