"""Quality and toxicity: gradients, calibration, odd input, and accuracy on labels that were not learned from."""

import numpy as np
import pandas as pd
import pytest

from newsgrain.llm import quality, toxicity

BIG = "/root/testdata/sf0.01"


def auc(y, p):
    r = pd.Series(p).rank().to_numpy()
    y = np.asarray(y)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(0, None), (1, ""), (2, " "), (3, "a"), (4, "You IDIOT!! 1d10t " * 3000), (5, "é" * 10), (None, "x퟿"), (3, "b"), (6, "word " * 40000)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "'y' AS y")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{BIG}/labels.parquet")


def test_gradients_by_differences():
    net = quality.ByteNet(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y, w = [b"hello world, some text " * 30, b"x", b""], np.array([1.0, 0.0, 1.0]), np.ones(3)
    g = net.gradients(texts, y, w)

    def loss():
        s = net.forward(texts)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    r = np.random.default_rng(0)
    for k, x in net.p.items():
        flat = x.reshape(-1)
        for i in r.integers(0, flat.size, 6):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g[k].reshape(-1)[i]) < 1e-4 + 2e-2 * abs(g[k].reshape(-1)[i]), k


@pytest.mark.parametrize("block", [quality.BLOCK, 300])
def test_gradients_of_repetitive_texts(block):
    """Chunks that tie for the maximum count once, however the rows fall into blocks."""
    net = quality.ByteNet(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y, w = [b"a" * 5000, b"ab" * 900 + b"z" * 3000], np.array([1.0, 0.0]), np.ones(2)
    g = net.gradients(texts, y, w, block)

    def loss():
        s = net.forward(texts)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k in ("chunk", "chunk_bias", "near", "out"):
        flat = net.p[k].reshape(-1)
        for i in np.random.default_rng(1).integers(0, flat.size, 6):
            old, ends = flat[i], []
            for move in (1e-6, -1e-6):
                flat[i] = old + move
                ends.append(loss())
            flat[i] = old
            assert abs((ends[0] - ends[1]) / 2e-6 - g[k].reshape(-1)[i]) < 1e-4 + 2e-2 * abs(g[k].reshape(-1)[i]), k


def test_chunks_cover_the_text_and_do_not_depend_on_neighbours():
    net = quality.ByteNet(1)
    texts = [b"", b"abc", b"some words " * 500, b"z" * 127, b"z" * 128, b"z" * 129]
    together, alone = net.forward(texts), np.concatenate([net.forward([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    for block in (128, 300, 1000):  # a text in pieces gives what it gives at once, gradients too
        assert np.allclose(net.forward(texts, block), together, atol=1e-5)
        y, w = np.array([1.0, 0, 1, 0, 1, 0]), np.ones(6)
        whole, parts = net.gradients(texts, y, w), net.gradients(texts, y, w, block)
        assert all(np.allclose(whole[k], parts[k], atol=1e-5) for k in whole)
    long = b"the same " * 200
    assert net.forward([long]) != net.forward([long[:-1] + b"#"])


def test_isotonic_is_monotone_and_calibrated():
    r = np.random.default_rng(1)
    z = r.standard_normal(2000)
    y = (r.random(2000) < 1 / (1 + np.exp(-3 * z))).astype(float)
    at, to = toxicity.isotonic(z, y, np.ones(2000))
    assert (np.diff(at) >= 0).all() and (np.diff(to) >= -1e-12).all() and 0 < to.min() and to.max() < 1
    p = np.interp(z, at, to)
    for lo, hi in ((0, 0.3), (0.3, 0.7), (0.7, 1)):
        m = (p > lo) & (p <= hi)
        assert abs(p[m].mean() - y[m].mean()) < 0.05


def test_trees_learn_a_rule():
    r = np.random.default_rng(2)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.4)).astype(float)
    t = toxicity.Boosted().fit(x[:2000], y[:2000], np.ones(2000))
    assert auc(y[2000:], t.margin(x[2000:])) > 0.99


def test_features_of_plain_words():
    f = toxicity.Features({})
    a = dict(zip(toxicity.FEATURES, f("you are an idiot, a MORON!"), strict=True))
    b = dict(zip(toxicity.FEATURES, f("this is fine and good news"), strict=True))
    c = dict(zip(toxicity.FEATURES, f("what an 1d10t he is"), strict=True))
    assert a["hits_per_word"] == 2 / 6 and a["near_second_person"] > 0 and b["hits_per_word"] == 0 and c["log_hits"] > 0 and c["obfuscation"] > 0
    assert all(np.isfinite(f("")))


@pytest.mark.parametrize("module, label, least", [("quality", "quality", 0.95), ("toxicity", "toxic", 0.7)])
def test_held_out_accuracy(spark, module, label, least):
    query = quality.op2_quality if module == "quality" else toxicity.op3_toxicity
    df = query(spark, BIG).toPandas()
    assert len(df) == 1000 and df["score"].between(0, 1).all()
    m = df.merge(pd.read_parquet(f"{BIG}/labels.parquet"), on="doc_id")
    held = m[m["held_out"]]
    assert auc(held[label], held["score"]) > least
    import zlib

    assert (df["held_out"] == df["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def plain_score(p, t):
    """The network on one text, by loops over positions and chunks."""
    halves = max(2, -(-len(t) // 128))
    e = [p["embed"][b] for b in t.ljust((halves + 1) * 128, b"\0")]
    a = [np.concatenate(e[i : i + 4]) for i in range(0, len(e), 4)]
    y = [np.maximum(a[i] @ p["near"] + a[i + 1] @ p["far"] + p["bias"], 0) for i in range(halves * 32)]
    units = []
    for c in range(halves - 1):
        part = np.array(y[32 * c : 32 * c + 64])
        units.append(np.maximum(np.concatenate([part.mean(axis=0), part.max(axis=0)]) @ p["chunk"] + p["chunk_bias"], 0))
    d = np.concatenate([np.max(units, axis=0), np.mean(units, axis=0)])
    return 1 / (1 + np.exp(-(d @ p["out"] + p["out_bias"][0])))


def test_network_by_loops(spark):
    net = quality.ByteNet(5)
    texts = [b"", b"a", b"some words and more " * 40, bytes(range(1, 256)) * 3, b"q" * 256]
    assert np.allclose(net.forward(texts), [plain_score(net.p, t) for t in texts], atol=1e-5)


def test_trees_by_walking(spark):
    r = np.random.default_rng(4)
    x = r.random((500, 3))
    t = toxicity.Boosted(trees=7).fit(x, (x[:, 1] > 0.3).astype(float), np.ones(500))

    def walk(row):
        z = t.base
        for feature, cutoff, value in t.trees:
            k = 0
            while k < len(feature):
                k = 2 * k + 1 + int(feature[k] >= 0 and row[feature[k]] > cutoff[k])
            z += value[k - len(feature)]
        return z

    assert np.allclose(t.margin(x), [walk(row) for row in x])


def test_proximity_covers_the_whole_text():
    f = toxicity.Features({})
    far = "idiot word word word word " * 1500
    at = toxicity.FEATURES.index("near_second_person")
    assert f(far + "you idiot")[at] == 0.5 and f(far)[at] == 0
    words = ("idiot fine you fine fine moron fine fine fine you fine idiot fine fine " * 3).split()
    hits, you = ([i for i, w in enumerate(words) if w in s] for s in (("idiot", "moron"), ("you",)))
    assert f(" ".join(words))[at] == max(1 / (1 + abs(i - j)) for i in hits for j in you)


def test_sample_is_bounded_and_whole(spark):
    from newsgrain.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(1, 40)] + [(5, None), (None, "y"), (3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(None, 1), (7, None), (4, 1)], "doc_id long, quality int")
    every = labelled_sample(docs, labels, "quality", 100)
    assert len(every) == 40 and every[every.text == "x" * 40].y.tolist() == [1]  # of two labels the larger
    some = labelled_sample(docs, labels, "quality", 100, max_bytes=500)
    for c in (0, 1):
        sizes = some[some.y == c].text.str.len()
        assert sizes.sum() >= 500 and sizes[:-1].sum() < 900
    assert len(labelled_sample(docs, labels, "quality", 5)) <= 11


def test_odd_rows(spark, odd, labels):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    few = labels.where("doc_id < 300")
    both = docs.where("doc_id < 300").unionByName(odd.selectExpr("doc_id + 10000 AS doc_id", "text"))
    for scores in (quality.quality_scores(both, few, per_class=30), toxicity.toxicity_scores(both, few, per_class=60)):
        rows = scores.where("doc_id >= 10000 OR doc_id IS NULL").collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.score for r in quality.quality_scores(odd, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(odd, labels.selectExpr("doc_id", "0 AS toxic")).collect()} == {0.0}
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_scores(empty, labels).count() == 0 and toxicity.toxicity_scores(empty, labels).count() == 0


def test_dropping_keeps_odd_rows_and_columns(spark, labels):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None, "s", 1), (5, "", "s", 2), (5, "", "s", 2), (7, "fine words " * 30_000, None, 3)], "doc_id long, text string, score string, _k int")
    kept = toxicity.drop_toxic(odd, labels, train=docs)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert toxicity.drop_toxic(odd.limit(0), labels, train=docs).count() == 0


def test_toxic_documents_go(spark, labels):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    kept = toxicity.drop_toxic(docs, labels)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(gone & toxic) > 0.7 * len(toxic) and len(gone & clean) < 0.03 * len(clean)
    assert kept.columns == docs.columns
