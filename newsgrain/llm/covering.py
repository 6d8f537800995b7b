"""Near-duplicates by SimHash with covering locality-sensitive hashing: no pair within the radius is missed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clustering import components
from .common import bounded_batches, counted_cut, cut, table

BITS, SHINGLE, RADIUS, SEED = 64, 3, 3, 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 20
_SPACE = b" \t\n\v\f\r"


def word_blocks(data: bytes, block: int = _BLOCK) -> Iterator[list[bytes]]:
    """The words of ``data``, about ``block`` bytes at a time, never cut within a word."""
    at = 0
    while at < len(data):
        end = min(len(data), at + block)
        while end < len(data) and data[end] not in _SPACE:
            step = data[end : end + block].split(None, 1)[0] if data[end : end + block] else b""
            end += max(1, len(step))
        yield data[at:end].split()
        at = end


def fingerprint(text: bytes, block: int = _BLOCK) -> int:
    """The 64-bit SimHash of a text's runs of three words, repeats included; see ``fingerprints``."""
    votes, n, held, first = np.zeros(BITS, np.int64), 0, [], True
    for words in word_blocks(text.translate(_LOWER), block):
        words = held + words
        grams = [xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in zip(words, words[1:], words[2:])]
        if grams:
            first = False
            bits = np.unpackbits(np.array(grams, "<u8").view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
            n += len(grams)
        held = words[-(SHINGLE - 1) :]
    if first and held:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED)
    return sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row: fp is a long whose 64 bits are the fingerprint.

    A-Z are lower-cased; the XXH64 hashes (seed 42) of the runs of three words, joined by single spaces, vote on each bit,
    and a bit is set if it is set in more than half of them. A text of fewer words is one run; without words, or null, its
    fingerprint is zero. Texts are read in blocks of 1 MB, so long ones need no more memory than their own size.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """2**(radius + 1) - 1 masks over the given bits: whatever ``radius`` of the bits are struck out, one mask has none of them.

    Every bit has a non-zero vector of radius + 1 binary digits, and the mask of a vector u holds the bits whose vector has
    an odd product with u. At most ``radius`` vectors leave a u other than zero that has an even product with all of
    them. The vectors are dealt evenly, so a mask has about half of the bits.
    """
    many = (1 << (radius + 1)) - 1
    vector = {b: 1 + i % many for i, b in enumerate(bits)}
    return [sum(1 << b for b, v in vector.items() if (u & v).bit_count() % 2) for u in range(1, many + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _within(radius: int):
    """From rows (bucket, fp) in order, whole buckets in a task: links that join all fingerprints of a bucket that chains of
    pairs within the radius join. A pair already joined by others is not listed, so the links grow with the rows."""

    def links(b: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root, left, right, lag = np.arange(len(b)), [], [], 1
        at, start = np.arange(len(b) - 1), np.searchsorted(b, b)
        while len(at):
            at = at[at + lag < len(b)]
            if lag & (lag - 1) == 0:  # buckets that are joined already need no more pairs
                loose = np.zeros(len(b), bool)
                loose[start[root != start]] = True
                at = at[loose[start[at]]]
            at = at[b[at] == b[at + lag]]
            open_ = at[root[at] != root[at + lag]]
            hit = open_[np.bitwise_count(fp[open_] ^ fp[open_ + lag]) <= radius]
            if len(hit):
                left.append(fp[hit])
                right.append(fp[hit + lag])
                x, y = root[hit], root[hit + lag]
                while len(x):
                    np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                    while (root[root] != root).any():
                        root = root[root]
                    x, y = root[x], root[y]
                    x, y = x[x != y], y[x != y]
            lag += 1
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in links(b, fp.view(np.uint64))], ["a", "b"])

        held = None
        for x in batches:
            b, fp = (x.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if held is not None:
                b, fp = np.concatenate([held[0], b]), np.concatenate([held[1], fp])
            upto = int(np.searchsorted(b, b[-1])) if len(b) else 0
            held = b[upto:], fp[upto:]
            yield out(b[:upto], fp[:upto])
        if held is not None:
            yield out(*held)

    return run


def _in_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within the buckets of rows (bucket, fp)."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_within(radius), "a long, b long")


def covering_links(prints: DataFrame, radius: int = RADIUS, crowd: int = 1024) -> DataFrame:
    """Links (a, b) between the different fingerprints of ``prints`` (fp): their components are those of all pairs at most
    ``radius`` bits apart.

    A covering mask names a table, the bits that it keeps a bucket. Each pair within the radius shares a bucket in at least
    one table, and every bucket is searched whole. A bucket of more than ``crowd`` fingerprints is dealt again by covering
    masks over the bits that its own mask leaves free, which keeps the guarantee, as its members differ nowhere else; what
    remains free then bounds a bucket by 2**16 fingerprints of 64 bits at radius 3, whatever the table's size.
    """
    masks = covering_masks(list(range(BITS)), radius)
    finer = [covering_masks([i for i in range(BITS) if not m >> i & 1], radius) for m in masks]
    bits = lambda m: F.col("fp").bitwiseAND(F.lit(_signed(m)))
    keyed = prints.select("fp", F.inline(F.array(*[F.struct(F.lit(t).alias("t"), bits(m).alias("k")) for t, m in enumerate(masks)])))
    large, n = counted_cut(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("t", "k"))
    if not n:
        return _in_buckets(keyed.select(F.xxhash64("t", "k").alias("bucket"), "fp"), radius)
    small = keyed.join(large, ["t", "k"], "left_anti").select(F.xxhash64("t", "k").alias("bucket"), "fp")
    of_table: Column = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in finer]), F.col("t") + 1)
    again = keyed.join(large, ["t", "k"]).select("t", "k", "fp", F.posexplode(of_table).alias("u", "m"))
    again = again.select(F.xxhash64("t", "k", "u", F.col("fp").bitwiseAND(F.col("m"))).alias("bucket"), "fp")
    return _in_buckets(small, radius).unionByName(_in_buckets(again, radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, crowd: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row a row of ``docs``: documents whose fingerprints differ in at most
    ``radius`` bits link, and a component is named by its least id.

    Only different fingerprints are searched, so copies cost nothing. Texts without words, empty and null ones too, have
    fingerprint zero and link like any others. Ids may repeat, and rows with a null id take part but do not name a component
    (one of such rows only is named null). An empty table gives an empty result. Only the two named columns are read.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(cut(covering_links(prints.select("fp"), radius, crowd))).select(F.col("node").alias("fp"), "root"))
    ids = prints.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    moved = roots.join(ids, "root").select("fp", "component_id")
    named = prints.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_simhash_covering(spark, sf_dir):
    """Components of documents whose fingerprints are at most 3 bits apart."""
    return near_duplicates(table(spark, sf_dir, "documents"))
