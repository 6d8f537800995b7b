"""The similarity join against all pairs of sets."""

import random
import re

import pytest

from newsgrain.llm import jaccard

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORDS.findall(raw)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least.get(top(k))) for k, (i, s) in enumerate(sets)), key=str)


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sk string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, **kw).collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    shared = [prose(60), prose(9), prose(30)]
    rows = [None, "", "  \t\n", "one two", "ONE  two", "one two three four", "a b c d e", "a b c d e f", "A b c d e f g", "x y z", "É É é é é é"]
    base = [prose(r.randint(20, 120)) for _ in range(12)]
    for b in base:
        for _ in range(r.randint(1, 14)):
            w = list(b)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w[: int(len(w) * r.uniform(0.7, 1))]
            rows.append(" ".join(w))
    for _ in range(40):  # different texts that share passages
        rows.append(" ".join(prose(r.randint(3, 30)) + r.choice(shared) + prose(r.randint(0, 12))))
    for _ in range(15):  # made of frequent passages
        rows.append(" ".join(sum(r.sample(shared, r.randint(1, 3)), [])))
    rows += rows[20:30]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(None, rows[25]), (None, "never seen before at all"), (3, rows[3]), (4, "other text under a known id here")]


@pytest.mark.parametrize("seed,often,crowd", [(1, 3, 64), (2, 1, 4), (3, 64, 2), (4, 2, 8)])
def test_equals_all_pairs(spark, seed, often, crowd):
    rows = corpus(seed)
    want = brute(rows)
    assert got(spark, rows, often=often, crowd=crowd) == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=str) == brute(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c if c is not None else i for i, _, c in brute(rows)}


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_across_blocks(monkeypatch):
    text = ("Lorem ipsum " * 50 + "x" * 300 + " \t\n" + "é" * 7 + " end").encode()
    whole = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "_BLOCK", 64)
    parts = jaccard.word_hashes(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert len(whole[0]) == len(WORDS.findall(text))


def test_one_of_each_keeps_rows_apart(spark):
    a, b, c = "a b c d e f g h", "quite other words in this one here", "third text of its own and long enough"
    rows = [(3, a), (5, a), (5, b), (None, c), (None, c), (7, ""), (7, ""), (8, None), (9, c + " too"), (9, c)]
    docs = spark.createDataFrame([(i, t, k, "m", "n", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, mark int, sk string, row string, key int").repartition(4)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    # c + " too" shares 5 of 6 shingles with c, and 9 is their least id
    assert len(got) == 6 and got.count((7, "")) == 2 and (3, a) in got and (5, b) in got and (8, None) in got
    assert sum(i == 9 for i, _ in got) == 1 and not any(i is None for i, _ in got)
    nameless = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")
    assert sorted(r.text for r in jaccard.one_of_each(nameless).collect()) == [a, b]


def test_a_passage_in_all_texts_costs_in_proportion(spark):
    """Signs compared when one passage fills most of every text: members of other classes, not the square of the group."""
    made = {}
    for size in (150, 300):
        r = random.Random(size)
        word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
        passage = " ".join(word() for _ in range(60))
        rows = [(i, " ".join(word() for _ in range(45)) + " " + passage) for i in range(size)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = jaccard.near_duplicates(docs, often=4, crowd=16)
        assert got.where("doc_id = component_id").count() == size
        shared = jaccard.shared_postings(docs, "text", *_frequent(docs, 4))
        none = spark.createDataFrame([], "sk long, root long")
        made[size] = jaccard.candidates(shared, none, 16).count()
    assert made[300] <= 2.5 * max(made[150], 4)


def _frequent(docs, often):
    from pyspark.sql import functions as F

    t = jaccard.profiles(docs, "doc_id", "text").where("token is not null").groupBy("token").agg(F.sum("cnt").alias("df")).where(F.col("df") > often).orderBy("df", "token").toPandas()
    return t["token"].to_numpy("int64"), t["df"].to_numpy("int64")


def test_very_long_text(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(5)) for _ in range(60_000)]
    other = [w if i % 400 else "changed" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:30_000])), (4, "short text of a few words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
