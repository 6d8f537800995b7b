"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, labelled_sample, table

#: Bytes a position, positions a half chunk; a filter spans two positions, a chunk two halves, chunks overlap by one half.
STEP, HALF = 4, 32
HALF_BYTES = STEP * HALF
DIMS, FILTERS, UNITS = 6, 16, 16
#: Bytes that are computed at once, whatever the length of a text.
BLOCK = 1 << 20


class ByteNet:
    """Embedding of bytes -> filters over 8 bytes, every 4 -> mean and maximum over each chunk of 256 bytes -> learned
    chunk units -> their maximum and mean over all chunks -> one logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = lambda *s, by: (r.standard_normal(s) / np.sqrt(by)).astype(np.float32)
        wide = STEP * DIMS
        self.p = {
            "embed": n(256, DIMS, by=2), "near": n(wide, FILTERS, by=2 * wide), "far": n(wide, FILTERS, by=2 * wide), "bias": np.zeros(FILTERS, np.float32),
            "chunk": n(2 * FILTERS, UNITS, by=2 * FILTERS), "chunk_bias": np.zeros(UNITS, np.float32),
            "out": n(2 * UNITS, by=2 * UNITS), "out_bias": np.zeros(1, np.float32),
        }

    @staticmethod
    def pieces(texts: list[bytes], block: int = BLOCK) -> Iterator[list[tuple[int, bytes, int]]]:
        """Groups of about ``block`` bytes of (text's number, bytes, chunks), so that memory does not grow with a text.

        A piece holds the halves of its chunks and one more, into which the last filter of the last chunk reaches; the
        next piece of a text begins with the next chunk. So pieces give what the text would give at once.
        """
        group, size, most = [], 0, max(1, block // HALF_BYTES)
        for i, t in enumerate(texts):
            total = max(1, -(-len(t) // HALF_BYTES) - 1)
            for c in range(0, total, most):
                n = min(most, total - c)
                group.append((i, t[c * HALF_BYTES : (c + n + 2) * HALF_BYTES], n))
                size += (n + 2) * HALF_BYTES
                if size >= block:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def chunks_of(self, group: list[tuple[int, bytes, int]]):
        """The units of all chunks of a group, the texts that they belong to, and what the gradients need."""
        p = self.p
        counts = np.array([n for _, _, n in group])
        data = np.frombuffer(b"".join(t.ljust((n + 2) * HALF_BYTES, b"\0") for _, t, n in group), np.uint8)
        starts = np.cumsum(counts + 2) - counts - 2
        chunks = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, counts, strict=True)])
        a = p["embed"][data].reshape(-1, STEP * DIMS)
        y = a @ p["near"]
        y[:-1] += a[1:] @ p["far"]
        y += p["bias"]
        np.maximum(y, 0, out=y)
        y3 = y.reshape(-1, HALF, FILTERS)
        mean, top = y3.mean(axis=1), y3.max(axis=1)
        v = np.concatenate([(mean[chunks] + mean[chunks + 1]) / 2, np.maximum(top[chunks], top[chunks + 1])], axis=1)
        h = np.maximum(v @ p["chunk"] + p["chunk_bias"], 0)
        return h, np.repeat([i for i, _, _ in group], counts), (data, chunks, a, y, top, v)

    def pooled(self, texts: list[bytes], block: int = BLOCK):
        """Maximum and mean of the units over the chunks of each text, and the numbers of chunks."""
        kind = self.p["chunk"].dtype
        high, total, counts = np.zeros((len(texts), UNITS), kind), np.zeros((len(texts), UNITS), kind), np.zeros(len(texts), np.int64)
        for group in self.pieces(texts, block):
            h, doc, _ = self.chunks_of(group)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            own = doc[first]
            high[own] = np.maximum(high[own], np.maximum.reduceat(h, first, axis=0))
            total[own] += np.add.reduceat(h, first, axis=0)
            counts[own] += np.diff(first, append=len(doc))
        return high, total / counts[:, None].astype(kind), counts

    def forward(self, texts: list[bytes], block: int = BLOCK) -> np.ndarray:
        high, avg, _ = self.pooled(texts, block)
        return self._score(np.concatenate([high, avg], axis=1))

    def _score(self, d: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((d @ self.p["out"] + self.p["out_bias"]).astype(np.float64), -500, 500)))

    def gradients(self, texts: list[bytes], target: np.ndarray, weight: np.ndarray, block: int = BLOCK):
        """Of the mean weighted log loss over whole texts. Groups are computed again if there are several."""
        p, groups = self.p, list(self.pieces(texts, block))
        if len(groups) == 1:
            ready = [self.chunks_of(groups[0])]
            h, doc, _ = ready[0]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            counts = np.diff(first, append=len(doc))
            high, avg = np.maximum.reduceat(h, first, axis=0), np.add.reduceat(h, first, axis=0) / counts[:, None].astype(h.dtype)
        else:
            high, avg, counts = self.pooled(texts, block)
            ready = (self.chunks_of(g) for g in groups)
        d = np.concatenate([high, avg], axis=1)
        dz = ((self._score(d) - target) * weight / len(texts)).astype(np.float32)
        g = {k: np.zeros_like(x) for k, x in p.items()} | {"out": d.T @ dz, "out_bias": dz.sum(keepdims=True)}
        dd = dz[:, None] * p["out"]
        unmet = np.ones((len(texts), UNITS), bool)  # the first chunk of a text that reaches the maximum has its gradient
        for h, doc, (data, chunks, a, y, top, v) in ready:
            dh = (dd[:, UNITS:] / counts[:, None])[doc]
            best = (h == high[doc]) & (h > 0)
            first, nth = np.flatnonzero(np.diff(doc, prepend=-1)), np.cumsum(best, axis=0, dtype=np.int32)
            best &= (nth - np.repeat(nth[first] - best[first], np.diff(first, append=len(doc)), axis=0) == 1) & unmet[doc]
            unmet[doc[first]] &= ~np.logical_or.reduceat(best, first, axis=0)
            dh = ((dh + np.where(best, dd[:, :UNITS][doc], 0)) * (h > 0)).astype(np.float32)
            g["chunk"] += v.T @ dh
            g["chunk_bias"] += dh.sum(axis=0)
            dv = dh @ p["chunk"].T
            dmean, dtop = np.zeros_like(top), np.zeros_like(top)
            dmean[chunks] += dv[:, :FILTERS] / 2
            dmean[chunks + 1] += dv[:, :FILTERS] / 2
            left = top[chunks] >= top[chunks + 1]
            dtop[chunks] += dv[:, FILTERS:] * left
            dtop[chunks + 1] += dv[:, FILTERS:] * ~left
            y3 = y.reshape(-1, HALF, FILTERS)
            dy = np.broadcast_to((dmean / HALF)[:, None, :], y3.shape).copy()
            at = y3.argmax(axis=1)
            i, k = np.indices(at.shape)
            dy[i, at, k] += dtop
            dy = dy.reshape(-1, FILTERS) * (y > 0)
            g["near"] += a.T @ dy
            g["far"] += a[1:].T @ dy[:-1]
            g["bias"] += dy.sum(axis=0)
            da = dy @ p["near"].T
            da[1:] += dy[:-1] @ p["far"].T
            da = da.reshape(-1, DIMS)
            g["embed"] += np.stack([np.bincount(data, da[:, j], 256) for j in range(DIMS)], axis=1).astype(np.float32)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 30, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> ByteNet:
        """Adam over shuffled batches of whole texts."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        s = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        weight = np.ones(len(texts), np.float32)
        for e in range(epochs):
            order = r.permutation(len(texts))
            for b in range(0, len(order), batch):
                some = order[b : b + batch]
                g = self.gradients([texts[j] for j in some], labels[some], weight[some])
                step += 1
                now = rate * (1 - e / epochs) ** 0.5
                for k, x in g.items():
                    m[k] += 0.1 * (x - m[k])
                    s[k] += 0.01 * (x * x - s[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                per_class: int = 1200, updates: int = 900) -> ByteNet | None:
    """Fit on at most ``per_class`` labelled texts of either class (the documented bound); None if a class is missing.

    The number of epochs follows from ``updates``, so that small and large label sets get about as many steps.
    """
    rows = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    y = rows["y"].to_numpy(np.float32)
    if len(set(y.tolist())) < 2:
        return None
    texts = [t.encode() for t in rows["text"]]
    # a rare class is repeated up to balance; as the threshold is a probability, that leaves clear cases clear
    few, many = sorted((np.flatnonzero(y == c) for c in (0, 1)), key=len)
    few = np.resize(few, len(many))
    pick = np.concatenate([few, many])
    epochs = max(4, min(60, updates * 32 // len(pick)))
    return ByteNet().fit([texts[i] for i in pick], y[pick], epochs=epochs)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.7, per_class: int = 1200) -> DataFrame:
    """Probability that each whole text is of label 1: (doc_id, score, predicted).

    The network is fitted on the driver from a bounded sample (``per_class``) of ``labels`` and sent to the tasks (under
    20 kB). Texts are scored whole, in blocks of ``BLOCK`` bytes. Nothing is shuffled; rows keep their multiplicity and ids may be null or repeat. Null and empty texts are scored as a chunk of
    zeros. Without labels of both classes every score is 0.5. Only the named columns are read.
    """
    net = fit_quality(docs, labels, label, id_col, text_col, per_class)
    params = net.p if net else None
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteNet()
        net.p = params or net.p
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            scores = net.forward(texts) if params else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op2_quality(spark, sf_dir):
    """Quality of every whole text, and whether its label was withheld from learning."""
    learn = table(spark, sf_dir, "labels").where(~held_out())
    out = quality_scores(table(spark, sf_dir, "documents"), learn)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
