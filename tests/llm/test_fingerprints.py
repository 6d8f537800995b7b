"""SimHash against a plain version, edited texts, and the block tables against all pairs."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsgrain.llm import fingerprints as fp

ODD = [None, "", " \t", "a", "a b", "One two THREE", "one two three four five six seven eight nine ten", "é 😀 ñ x" * 7, "w " * 5000, "one two three", "z\ny\rx\x0bw\x0cv", "same words here", "same words here"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(3 * i - 5, t, "f") for i, t in enumerate(ODD)] + [(None, "null id text", "f"), (4, "another text of a known id", "f"), (-2, "", "f"), (31, "same words here", "f"), (None, "null id text", "f")]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)


def test_fingerprint_is_the_sign_of_votes(spark, odd):
    rows = fp.fingerprints(odd).collect()
    texts = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()
    assert len(rows) == len(texts)
    got = {(r.doc_id, r.text_hash): r.fingerprint for r in rows}
    for t in texts:
        w = t.text.lower().split(None) if t.text.isascii() else [x for x in t.text.lower().split(" ") if x]
        w += [""] * (3 - len(w))
        terms = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        h = spark.createDataFrame(terms, "a string, b string, c string").select(F.xxhash64("a", "b", "c"), F.xxhash64("c", "b", "a", F.lit(1))).collect()
        weights = [0 if not sum(map(len, x)) else min(8, 1 + sum(map(len, x)) // 8) for x in terms]
        bits = ""
        for side in (0, 1):
            v = [sum(k * (1 if (x[side] >> i) & 1 else -1) for x, k in zip(h, weights, strict=True)) for i in range(64)]
            bits += f"{sum((s > 0) << i for i, s in enumerate(v)):016x}"
        assert got[t.doc_id, t.h] == bits


def edited(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[i].append(t or "")
    ids = sorted((i for i in by if i is not None), reverse=True)
    out = {}
    for k, i in enumerate(ids):
        nxt = ids[(k + 1) % len(ids)]
        for t in by[i]:
            n = len(t) // 3
            out[i, t] = (t[: len(t) - n] + min(by[nxt])[:n], nxt)
    for t in by[None]:
        n = len(t) // 3
        out[None, t] = (t[: len(t) - n], None)
    return out


def test_edit_study(spark, sf, odd):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet").repartition(5)):
        want = edited([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        rows = fp.edit_study(docs).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str) == sorted(
            ((r.doc_id, len(r.text or ""), hashlib.sha256(want[r.doc_id, r.text or ""][0].encode()).hexdigest()) for r in docs.collect()), key=str)
        by = defaultdict(set)
        for r in rows:
            by[r.doc_id].add(r.fingerprint)
            same = bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1")
            assert r.near_edited == 1 - same / 128
        for r in rows:
            t = next((i, t) for (i, t), (e, _) in want.items() if i == r.doc_id and len(t) == r.n_chars and hashlib.sha256(e.encode()).hexdigest() == r.edited_sha256)
            nxt = want[t][1]
            other = min(by[nxt]) if nxt is not None else fp.ZERO
            assert r.near_next == 1 - bin(int(r.fingerprint, 16) ^ int(other, 16)).count("1") / 128
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)
    assert fp.edit_study(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (one,) = fp.edit_study(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_block_tables_find_all_pairs(spark, radius):
    r = random.Random(radius)
    base = [r.getrandbits(128) for _ in range(40)]
    values = base + [b ^ sum(1 << k for k in r.sample(range(128), r.randint(0, 10))) for b in base for _ in range(6)]
    rows = [(f"{v:032x}",) for v in values] + [(None,), (f"{values[0]:032x}",)]
    df = spark.createDataFrame(rows, "fingerprint string")
    asked = df.limit(60)
    want = {(a[0], b[0]) for a in asked.collect() for b in rows if a[0] and b[0] and a[0] != b[0] and bin(int(a[0], 16) ^ int(b[0], 16)).count("1") <= radius}
    got = fp.within_radius(asked, df, radius).collect()
    assert {(x.asked, x.found) for x in got} == want and len(got) == len(want)


def test_radius_search_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = [(r.doc_id, r.fingerprint) for r in fp.fingerprints(docs).collect()]
    want = sorted((a, x, y, d, sum(z == y for _, z in prints)) for a, x in prints if a % 100 == 0
                  for y in {z for _, z in prints} if (d := bin(int(x, 16) ^ int(y, 16)).count("1")) <= 7)
    assert sorted(map(tuple, fp.op1_radius_search(spark, sf).collect())) == want and want
