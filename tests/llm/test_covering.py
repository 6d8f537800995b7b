"""Covering hashing: the guarantee of the masks, fingerprints and components against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from newsgrain.llm import covering

ODD = [None, "", " \t\n", "a", "A b", "a b c", "a B c d", "a b c d", "é ß \u0085x  y", "x" * 3000, "the The\nthe  the " * 2000, "word " * 3]


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    for c in "\t\n\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, radius=3):
    """The least position of each value's component, by all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("bits", [list(range(64)), list(range(0, 64, 2)), [1, 5, 6, 40], []])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_some_mask_avoids_any_bits_within_the_radius(bits, radius):
    masks = covering.covering_masks(bits, radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    some = list(itertools.combinations(bits, min(radius, len(bits))))
    for struck in some if len(some) < 20000 else random.Random(1).sample(some, 20000):
        assert any(not any(m >> b & 1 for b in struck) for m in masks)


def test_two_levels_of_masks_bound_a_bucket():
    for m in covering.covering_masks(list(range(64)), 3):
        free = [i for i in range(64) if not m >> i & 1]
        for f in covering.covering_masks(free, 3):
            assert sum(not f >> i & 1 for i in free) <= 16


def test_fingerprints_equal_the_plain_ones(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in covering.fingerprints(docs).collect()}
    assert got == {i: slow_print(t) for i, t in enumerate(texts)}
    for t in texts:  # blocks of any size give the same
        assert covering.fingerprint((t or "").encode(), 7) == slow_print(t)


@pytest.mark.parametrize("crowd", [1024, 8, 1])
def test_links_lose_no_pair(spark, crowd):
    r = random.Random(3)
    centre = r.getrandbits(64)
    values = {r.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 2**63}
    values |= {centre ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 8))) for _ in range(600)}  # a dense ball
    for v in list(values)[:150]:
        values.add(v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    values = sorted(values)
    prints = spark.createDataFrame([(covering._signed(v),) for v in values], "fp long").repartition(4)
    links = [(values.index(x.a & (1 << 64) - 1), values.index(x.b & (1 << 64) - 1)) for x in covering.covering_links(prints, crowd=crowd).collect()]
    assert all((values[a] ^ values[b]).bit_count() <= 3 for a, b in links)
    assert len(links) < 15 * 15 * len(values)
    least = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    assert least == roots(values)


def test_components_equal_all_pairs(spark, sf):
    rows = [(i, t, "x") for i, t in enumerate(ODD * 2)] + [(None, "a b c d", "y"), (None, "only here without an id", "y"), (3, "other text of a repeated id", "z")]
    base = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text").collect()
    rows += [(r.doc_id, r.text, "x") for r in base]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in covering.near_duplicates(docs, crowd=4).collect())
    prints = [slow_print(t) for _, t, _ in rows]
    distinct = sorted(set(prints))
    root = dict(zip(distinct, roots(distinct), strict=True))
    least = {}
    for (i, _, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = sorted((i if i is not None else -1, f"{p:016x}", least.get(root[p])) for (i, _, _), p in zip(rows, prints, strict=True))
    assert got == want


def test_empty_table(spark):
    assert covering.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_buckets_in_numpy_stay_linear():
    """A dense ball in one bucket: links grow with the rows, not with the pairs."""
    fp = np.arange(1 << 12, dtype=np.int64)
    import pyarrow as pa

    run = covering._within(3)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(512, np.int64)), pa.array(fp[i : i + 512])], ["bucket", "fp"]) for i in range(0, len(fp), 512)]
    links = pa.Table.from_batches(list(run(iter(batches))))
    assert len(fp) - 1 <= links.num_rows < 3 * len(fp)
