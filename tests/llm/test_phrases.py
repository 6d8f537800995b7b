"""Collocations against brute force: counts of all phrases by plain loops, exact scores, ties and blocks."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from newsgrain.llm import phrases

ODD = [None, "", " ", ".", "a", "A b a B a b", "the\tcat  sat, the cat sat; The Cat\x0bsat\x0cthe cat", "é ü. é ü é", "x" * 500 + " " + "y" * 700, "no stops here " * 400, "a a a a a a a a", "  \u0085 z"]


def made(seed=4):
    r = random.Random(seed)
    names = ["new york city", "prime minister", "united states of america", "a", "b", "c", "the", "of", "rain", "sun"]
    texts = [" ".join(r.choice(names) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(120)]
    return [(i, t, r.choice(["en", "de", None])) for i, t in enumerate(texts + ODD)]


def slow_counts(rows, longest=5):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[" ".join(words[i : i + k])] += 1
    return f, n


def slow(rows, least, keep):
    f, n = slow_counts(rows)
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if " " in p and a >= least}
        scored = []
        for p, a in c.items():
            if any(len(q.split(" ")) > len(p.split(" ")) and f" {p} " in f" {q} " and 100 * b >= 100 * a for q, b in c.items()):
                continue
            w = p.split(" ")
            score, j = min(((1000 * a * n[lang]) // (counts[" ".join(w[:j])] * counts[" ".join(w[j:])]), j) for j in range(1, len(w)))
            scored.append((-score, -a, p.encode(), counts[" ".join(w[:j])], counts[" ".join(w[j:])]))
        for rank, (s, a, p, le, r) in enumerate(sorted(scored)[:keep], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), "doc_id long, text string, lang string").selectExpr("*", "1 AS k", "'x' AS phrase").repartition(5)


@pytest.mark.parametrize("shards", [1, 3])
def test_counts_do_not_depend_on_when_phrases_become_active(docs, shards):
    got = {(r.part, r.phrase): r.a for r in phrases.frequent_phrases(docs, least=12, shards=shards, block=300).collect()}
    f, n = slow_counts(made())
    want = {(lang, p): a for lang, c in f.items() for p, a in c.items() if a >= 12} | {(lang, ""): a for lang, a in n.items()}
    assert got == want
    assert any(p.count(" ") == 4 for _, p in want) and len(want) > 50


def test_collocations_equal_brute_force(docs):
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=8, keep=15, shards=2).collect())
    assert got == slow(made(), 8, 15)


def test_empty_and_rare(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("only once", "en"), (None, None)], "text string, lang string")).count() == 0


def flat(found):
    return {(k, p): int(c) for k, texts, times in found for p, c in zip(texts.to_pylist(), times, strict=True) if p}


@pytest.mark.parametrize("size", [1, 5, 17, 64, 1000])
def test_blocks_lose_and_repeat_nothing(size):
    text = ("one two three four five six seven. " + "w x y z " * 30 + ", last words here" + " q" * 40).encode().translate(phrases._FOLD)
    every = np.zeros(1 << 12, np.uint8)  # all phrases are counted
    total, whole = Counter(), Counter()
    for own, more in phrases.blocks(text, size, 4):
        total.update(flat(phrases.count_grams(own, more, 7, 1, every, 4)))
    whole.update(flat(phrases.count_grams(text, b"", 7, 1, every, 4)))
    f, _ = slow_counts([(0, text.decode(), "x")])
    assert total == whole == {(p.count(" ") + 1, p.encode()): c for p, c in f["x"].items()}


@pytest.mark.parametrize("seed", range(20))
def test_places_marked_by_other_phrases_do_not_spoil_counts(seed):
    """However the marks fall, a phrase is counted in a whole cycle once its subphrases are marked: all of it, or none of it."""
    shards, cycles = 3, 5
    text = " ".join(random.Random(seed).choices(["a", "b", "c", "d"], k=300)).encode()
    when = np.random.default_rng(seed).choice([0, 0, 1, 2, 4, 7, phrases._NEVER], 1 << 8).astype(np.uint8)
    total = Counter()
    for t in range(1, shards * cycles):  # every shard holds the same text; a visit sees only what earlier ones marked
        marks = np.where(when < t, when, phrases._NEVER).astype(np.uint8)
        total.update({k: c for k, c in flat(phrases.count_grams(text, b"", 7, t, marks, shards)).items() if k[0] > 1})
    f, _ = slow_counts([(0, text.decode(), "x")])
    assert any(k > 3 for k, _ in total)
    assert total == {(k, p): shards * f["x"][p.decode()] for k, p in total}


def test_exact_scores_beyond_64_bits(spark):
    big = 10**13
    row = spark.createDataFrame([(big - 7, 10**14 + 3, big, big - 1)], "a long, n long, l long, r long")
    e = "(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    assert e in open(phrases.__file__).read()
    assert row.selectExpr(f"{e} AS s").first().s == 1000 * (big - 7) * (10**14 + 3) // (big * (big - 1))


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = phrases.op11_collocations(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({phrases.OP11_SQL})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("n", [50, 70_000])
def test_a_block_is_numbered_once_and_counted_without_its_text(n):
    """Scans read numbers: of few words two bytes each, of many four; phrases and counts are those of the text."""
    text = (" ".join(f"w{i}" for i in range(n)) + ". w1 w2 w3 w1 w2. é ü ").encode()
    size, words, hashes, codes = phrases.encode(text, b" w4 w5", 7)
    own = phrases.tokens(text)
    assert size == len(own) and len(codes) == (2 if n == 50 else 4) * (size + 2)
    listed = words.split(b" ")
    numbers = np.frombuffer(codes, np.uint16 if n == 50 else np.int32)
    assert [listed[i] for i in numbers] == [*own, b"w4", b"w5"] and len(set(listed)) == len(listed) == len(hashes) // 8
    got = flat(phrases.count_coded(size, words, hashes, codes, 1, np.zeros(1 << 16, np.uint8), 3))
    f, _ = slow_counts([(0, text.decode() + "w4 w5", "x")])
    assert got[2, "ü w4".encode()] == 1 and got[2, b"w1 w2"] == f["x"]["w1 w2"] == 3 and got[3, b"w1 w2 w3"] == 2
    assert sum(c for (k, _), c in got.items() if k == 2) == sum(c for p, c in f["x"].items() if p.count(" ") == 1) - 1  # the last pair begins behind the block


def test_a_block_without_words_is_no_row():
    assert phrases.encode(b"  ", b"", 7) is None and phrases.count_grams(b"", b"", 7, 0, None, 3) == []
