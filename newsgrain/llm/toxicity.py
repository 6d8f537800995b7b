"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, labelled_sample, table

#: Words that are insults in their language; the fitted lexicon is added to them.
INSULTS = ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "loser", "losers", "pathetic", "scum", "worthless", "disgusting",
           "dumb", "imbecile", "bastard", "bitch", "crap", "shit", "fuck", "fucking", "asshole", "retard", "trash", "clown",
           "idiota", "imbécil", "estúpido", "estúpida", "idiote", "imbécile", "connard", "salaud", "dummkopf", "arschloch", "blödmann", "trottel")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split())
FEATURES = ("hits_per_word", "log_hits", "log_distinct", "closest_hits", "near_second_person", "second_person_rate", "capitals", "capital_words",
            "exclamations", "punctuation", "symbols", "obfuscation", "repeats", "digits", "log_words", "weight")
_STRIP = ".,;:!?\"'()[]{}<>*#%$&|-_~`…“”’«»¡¿"
_PREFIXES = (4, 5, 6)
_LEET = str.maketrans("013457@$", "oieastas")


def _classes() -> np.ndarray:
    """Byte classes: 0 other, 1 small letter, 2 capital, 3 digit, 4 white space, 5 mark of a sentence, 6 symbol, 7 byte of a non-ASCII letter."""
    c = np.zeros(256, np.uint8)
    c[97:123], c[65:91], c[48:58], c[128:] = 1, 2, 3, 7
    for chars, k in ((b" \t\n\r\v\f", 4), (b".,;:!?'\"()-", 5), (b"@#$%^&*_+=|~<>/\\[]{}`", 6)):
        c[list(chars)] = k
    return c


_CLASS = _classes()


def keys_of(word: str) -> list[str]:
    """A word and its prefixes, marked so that a prefix is not taken for a word."""
    return [word, *[word[:n] + "-" for n in _PREFIXES if len(word) > n]]


def words_of(text: str) -> list[str]:
    return [w.strip(_STRIP) for w in text.lower().split()]


def learn_lexicon(texts: list[str], labels: np.ndarray, least: int = 3, precision: float = 0.9, most: int = 4000) -> dict[str, float]:
    """Words and word beginnings that occur almost only in toxic texts, with their log odds.

    Of texts with one signature (the smallest hash of their word pairs) one is counted, so near copies do not count
    twice. Toxic texts are counted by the hashes of their keys, and only keys that enough of them hold are then named
    and looked for in the others, so memory is a few numbers a word.
    """
    chosen: tuple[list, list] = ([], [])
    met: set[tuple[int, int]] = set()
    for text, y in zip(texts, labels, strict=True):
        words = words_of(text)
        sign = min((xxhash.xxh64_intdigest(a + " " + b) for a, b in zip(words, words[1:], strict=False)), default=0)
        if (int(y), sign) not in met:
            met.add((int(y), sign))
            chosen[int(y)].append(text)
    n0, n1 = max(1, len(chosen[0])), max(1, len(chosen[1]))
    least = max(2, least, math.ceil(0.005 * n1)) if n1 > 100 else 2

    def keys(text: str) -> set[str]:
        return {k for w in set(words_of(text)) if len(w) > 2 and not w.isdigit() for k in keys_of(w)}

    hashes = [np.fromiter({hash(k) for k in keys(t)}, np.int64) for t in chosen[1]]
    value, times = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, np.int64), np.zeros(0, int))
    often = set(value[times >= least].tolist())
    toxic: Counter = Counter()
    for t in chosen[1]:
        toxic.update(k for k in keys(t) if hash(k) in often)
    clean: Counter = Counter()
    for t in chosen[0]:
        clean.update(k for k in keys(t) if k in toxic)
    # rates, not counts, as the sample holds the classes in other shares than the corpus
    found = {k: math.log(((a + 0.5) / n1) / ((clean[k] + 0.5) / n0)) for k, a in toxic.items() if a >= least and a / n1 >= precision / (1 - precision) * (clean[k] / n0)}
    best = sorted(found, key=lambda k: (-toxic[k] * found[k], k))[:most]
    return {k: found[k] for k in best}


class Features:
    """The dense features of a text. The lexicon is looked up by the first letters of a word, so most words cost one look-up."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon | {w: max(lexicon.get(w, 0.0), 3.0) for w in INSULTS}
        self.heads = {k.rstrip("-")[:3] for k in self.lexicon}

    def hit(self, word: str) -> float:
        w = word.strip(_STRIP)
        got = max((self.lexicon.get(k, 0.0) for k in keys_of(w)), default=0.0)
        return got

    def __call__(self, text: str) -> list[float]:
        raw = text.split()
        words = text.lower().split()
        n = max(1, len(words))
        heads = self.heads
        at, kinds, weight = [], set(), 0.0
        for i, w in enumerate(words):
            if w[:3] in heads or (not w[:1].isalpha()):
                got = self.hit(w)
                if got > 0:
                    at.append(i)
                    kinds.add(w.strip(_STRIP)[:4])
                    weight += min(got, 6.0)
        b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        c = _CLASS[b]
        counts = np.bincount(c, minlength=8)
        size = max(1, len(b))
        obscured = 0
        if counts[3] + counts[6]:
            letter = (c == 1) | (c == 2)
            before, after = letter[:-2], letter[2:]
            inner = np.flatnonzero(((c[1:-1] == 3) & (before | after)) | ((c[1:-1] == 6) & before & after)) if size > 2 else ()
            obscured = len(inner)
            if obscured:
                for i, w in enumerate(words):
                    if not w.isalpha() and i not in at[-1:]:
                        plain = w.strip(_STRIP).translate(_LEET)
                        if plain.isalpha() and plain != w.strip(_STRIP) and self.hit(plain) > 0:
                            at.append(i)
                            weight += 3.0
                            kinds.add(plain[:4])
        at.sort()
        closest = min((j - i for i, j in zip(at, at[1:], strict=False)), default=10_000)
        second = 0
        near = 0.0
        if at:
            you = [i for i, w in enumerate(words) if w.strip(_STRIP) in SECOND_PERSON]
            second = len(you)
            if you:
                y, x = np.array([-(1 << 40), *you, 1 << 40]), np.array(at)
                k = np.searchsorted(y, x)
                near = 1 / (1 + int(np.minimum(x - y[k - 1], y[k] - x).min()))
        repeats = int(((b[1:] == b[:-1]) & (b[1:] == np.roll(b, 1)[:-1]) & (c[1:] != 4)).sum()) if size > 3 else 0
        letters = max(1, counts[1] + counts[2])
        return [len(at) / n, math.log1p(len(at)), math.log1p(len(kinds)), 1 / (1 + closest), near, second / n, counts[2] / letters,
                sum(map(str.isupper, raw)) / n if counts[2] > 0.3 * letters else 0.0,
                int((b == 33).sum()) / size, counts[5] / size, counts[6] / size, obscured / n, repeats / size, counts[3] / size, math.log1p(len(words)), weight / math.sqrt(n)]


class Boosted:
    """Gradient-boosted regression trees for logistic loss over binned features; trees are arrays of a complete binary tree."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 5.0):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        rate = float((weight * y).sum() / weight.sum())
        self.base = math.log(rate / (1 - rate))
        z = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-z))
            g, h = weight * (p - y), weight * p * (1 - p)
            inner = (1 << self.depth) - 1
            feature, cutoff = np.full(inner, -1), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    rows = node == k
                    best = (1e-6, -1, 0)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for f, e in enumerate(edges):
                        if not len(e) or hs < 2 * self.least * 0.05:
                            continue
                        gb = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                        hb = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                        gain = gb**2 / (hb + 1) + (gs - gb) ** 2 / (hs - hb + 1) - gs**2 / (hs + 1)
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (float(gain[j]), f, j)
                    if best[1] >= 0:
                        feature[k], cutoff[k] = best[1], edges[best[1]][best[2]]
                node = self._down(x, node, feature, cutoff)
            leaf = node - inner
            value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1.0) * self.rate
            z += value[leaf]
            self.trees.append((feature, cutoff, value))
        return self

    @staticmethod
    def _down(x, node, feature, cutoff):
        f = feature[node]
        right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cutoff[node])
        return 2 * node + 1 + right

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for feature, cutoff, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = self._down(x, node, feature, cutoff)
            z += value[node - len(feature)]
        return z


def isotonic(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability) of a non-decreasing fit, between which one interpolates."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first and last margin
    for i in order:
        blocks.append([float(y[i]), float(w[i]), float(z[i]), float(z[i])])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    # a block's rate, drawn a little towards the whole, so that no score is exactly 0 or 1
    to = np.array([(b[0] * b[1] + 0.01) / (b[1] + 0.02) for b in blocks for _ in (0, 1)])
    return at, to


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees: Boosted, knots: tuple[np.ndarray, np.ndarray]):
        self.features, self.trees, self.knots = Features(lexicon), trees, knots

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.trees.margin(np.array([self.features(t or "") for t in texts], np.float64))
        # isotonic steps tie many margins; a share of the margin itself keeps their order
        return 0.98 * np.interp(z, *self.knots) + 0.02 / (1 + np.exp(-z))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                 per_class: int = 3000) -> ToxicityModel | None:
    """Fit on at most ``per_class`` labelled texts of either class (the documented bound); None if a class is missing.

    One half of the sample finds the lexicon for the other half's features and the other way round, so that trees and
    calibration see features of texts that the lexicon has not seen; the lexicon for scoring comes from both halves.
    Weights restore the classes' shares in the labels.
    """
    n = labels.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("one")).first()
    rows = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    y = rows["y"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    texts = rows["text"].tolist()
    share = n["one"] / n["n"]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    fold = np.array([xxhash.xxh64_intdigest(t[:64]) % 2 for t in texts])
    x = np.zeros((len(texts), len(FEATURES)))
    for k in (0, 1):
        other = np.flatnonzero(fold != k)
        own = Features(learn_lexicon([texts[i] for i in other], y[other])) if len(other) else Features({})
        for i in np.flatnonzero(fold == k):
            x[i] = own(texts[i])
    margins = np.zeros(len(texts))
    for k in (0, 1):  # calibrate on margins of trees that did not see the text
        a, b = fold != k, fold == k
        if b.any():
            margins[b] = Boosted().fit(x[a], y[a], weight[a]).margin(x[b]) if a.any() and len(set(y[a].tolist())) == 2 else 0.0
    trees = Boosted().fit(x, y, weight)
    return ToxicityModel(learn_lexicon(texts, y), trees, isotonic(margins, y.astype(float), weight))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.3, per_class: int = 3000) -> DataFrame:
    """Probability that each whole text is toxic: (doc_id, score, predicted).

    The model is fitted on the driver from a bounded sample (``per_class``) of ``labels`` and broadcast (a lexicon of at
    most 4,000 entries and 60 small trees). Nothing is shuffled; rows keep their multiplicity and ids may be null or
    repeat. Null and empty texts have the features of no words. Without labels of both classes every score is 0. Only
    the named columns are read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_toxicity(docs, labels, label, id_col, text_col, per_class))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts = b.column(1).to_pylist()
            scores = m.scores(texts) if m else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    bounded_batches(spark)
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", per_class: int = 3000, train: DataFrame | None = None) -> DataFrame:
    """``docs`` without the documents whose score reaches ``threshold``; texts never leave their partition. The labels
    are those of documents in ``train`` (``docs`` if not given). Rows and columns are otherwise those of ``docs``, with
    their multiplicity; null and empty texts are scored as texts without words. Without labels of both classes all stay."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_toxicity(train if train is not None else docs, labels, per_class=per_class))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            keep = [True] * b.num_rows if m is None else (m.scores(b.column(at).to_pylist()) < threshold).tolist()
            yield b.filter(pa.array(keep, pa.bool_()))

    bounded_batches(spark)
    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir):
    """Toxicity of every whole text, and whether its label was withheld from learning."""
    learn = table(spark, sf_dir, "labels").where(~held_out())
    out = toxicity_scores(table(spark, sf_dir, "documents"), learn)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
