"""Facts of one source only: all tiers and the resolver against a loop over all pairs."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest

from newsgrain.functions import text
from newsgrain.operators import dedup, facts

WORDS = ["Colombian", "government", "north", "south", "korea", "Red Fort", "Delhi", "New Delhi", "India", "15", "50", "dead", "ministry of", "the", "U.S.", "police", "Straße", "ﬁre", "militia", "naxals", "dimaagi"]


def key(x):
    x = unicodedata.normalize("NFKC", x or "").casefold().strip()
    x = re.sub(r"^(?:the|a|an)\s+", "", x)
    x = re.sub(r"[^\w\s]", " ", re.sub(r"[.'’]", "", x))
    return re.sub(r"\s+", " ", x).strip()


def same(a, b):
    a, b = key(a), key(b)
    if not a or not b:
        return False
    if a == b:
        return True
    if len(a) < 5 or len(b) < 5:
        return False
    if a in b or b in a or set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split()):
        return True
    return not re.search(r"\d", a + b) and SequenceMatcher(None, a, b).ratio() >= 0.9


def misspelt(r, x):
    i = r.randrange(len(x))
    return r.choice([x[:i] + x[i + 1 :], x[:i] + x[i] + x[i:], x[:i] + r.choice("xyz") + x[i + 1 :], x.upper(), f"The {x}!", x])


def made(seed, n, stories):
    r = random.Random(seed)
    rows = [(r.choice(stories), r.randint(1, 4), misspelt(r, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 4))))) for _ in range(n)]
    return rows + [(0, 1, None), (0, 1, ""), (0, 2, "..."), (0, 3, "aaaaaaaaaaaaaaaaaaaa"), (0, 4, "aaaaaaaaaaaaaaaaaaab"), (0, 1, "US"), (0, 2, "USA Today")]


def slow(rows, resolver):
    rows = {x for x in rows if x[2] is not None}
    canon = {}
    for s, c in sorted(resolver, key=lambda x: -x[1]):
        canon[key(s)] = c
    at = lambda x: canon.get(key(x)) if key(x) else None
    return {(s, src, f) for s, src, f in rows if not any(s == t and src != o and (same(f, g) or (at(f) is not None and at(f) == at(g))) for t, o, g in rows)}


@pytest.mark.parametrize(("seed", "n", "stories"), [(1, 250, [0, 1, 2]), (2, 300, [0])])
def test_unique_facts_equal_a_loop(spark, seed, n, stories):
    rows = made(seed, n, stories)
    resolver = [("U.S.", 7), ("us", 9), ("USA today", 7), ("North Korea", 3), ("dprk", 3), ("police", 4), ("militia", 4), ("", 1)]
    df = spark.createDataFrame(rows, "story long, source long, fact string").repartition(4)
    got = [tuple(r) for r in facts.unique_facts(df, "story", "source", "fact", spark.createDataFrame(resolver, "surface string, canonical long")).collect()]
    want = slow(rows, resolver)
    assert len(got) == len(set(got)) and set(got) == want and 20 < len(want) < len(rows)


def test_tiers_equal_all_pairs(spark):
    rows = made(3, 160, [0])
    keys = sorted({key(f) for _, _, f in rows if f} - {""})
    got = {(r.item, r.other) for r in facts.equal_facts(spark.createDataFrame([(0, k, True) for k in keys], "story long, key string, asked boolean"), "story").collect()}
    assert got == {(a, b) for a in keys for b in keys if a != b and same(a, b)}


def test_one_hot_story_costs_in_proportion(spark):
    """Thousands of facts of one story, few of them alike: no more candidates than a few for each."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    rows = [(0, i % 3, f"{word()} {word()} said {word()}") for i in range(4000)]
    rows += [(0, (i + 1) % 3, f + "s") for i, (_, _, f) in enumerate(rows[:200])]
    df = spark.createDataFrame(rows, "story long, source long, fact string").repartition(4)
    assert facts.unique_facts(df, "story", "source", "fact").count() == 3800


def test_fold_equals_the_plain_one(spark):
    odd = ["ﬁne ＡＢＣ Straße", "É é", "İ", "ǅ", "①②", "Ω Ω", "", "plain ASCII Text", "ＡＢＣ", "the ﬁrst"]
    rows = spark.createDataFrame([(x,) for x in [*odd, None]], "x string")
    got = {r.x: r.k for r in rows.select("x", text.fold(rows.x).alias("k")).collect()}
    assert got == {x: unicodedata.normalize("NFKC", x or "").casefold() for x in [*odd, None]}
    assert {r.x: r.k for r in rows.select("x", text.normalize_fact(rows.x).alias("k")).collect() if r.x != "İ"} == {x: key(x) for x in [*odd, None] if x != "İ"}


def test_near_duplicate_groups_equal_all_pairs(spark):
    r = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    texts = [None, "", " ", "a", "A", "one two", "One  two", "a b c d e", "a b c d e f"]
    for _ in range(12):  # groups of edited copies that share a passage
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(20, 60))]
        for _ in range(r.randint(1, 25)):
            words = list(base)
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = f"x{r.randint(0, 9)}"
            texts.append(" ".join(words + (passage if r.random() < 0.3 else [])))
    docs = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(docs)
    got = {g.id: g.root for g in dedup.near_duplicate_groups(spark.createDataFrame(docs, "id long, t string").repartition(5), "id", "t").collect()}

    def grams(t):
        w = (t or "").strip(" ").lower()
        w = re.split(r"\s+", w)
        return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 12


def test_near_duplicate_groups_index_no_crowded_run_alone(spark, monkeypatch):
    """Texts of passages that many texts share, in ever other choices, are not all compared with each other; white space at
    the ends of a text is an empty word."""
    from newsgrain.operators import set_join

    r = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(12)] for k in range(24)]
    texts = [" ".join(w for k in r.sample(range(24), 8) for w in passages[k]) for _ in range(160)] + ["\ta b c", "a b c", "a b c\n", "\t a b c", "", "\n", None]
    asked = []
    plain = set_join.verified
    monkeypatch.setattr(set_join, "verified", lambda docs, pairs, *a: plain(docs, asked.append(p := set_join.cut(pairs)) or p, *a))
    got = {g.id: g.root for g in dedup.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()}
    assert [got[i] for i in range(160, 167)] == [160, 161, 162, 160, 164, 165, 164]
    assert sum(p.count() for p in asked) < 160 * 159 // 2 // 4


def test_words_of_a_long_text_across_blocks(monkeypatch):
    from newsgrain.operators import set_join

    data = b"one two\tthree  four " * 40
    whole = set_join.word_hashes(data)
    monkeypatch.setattr(set_join, "_BLOCK", 64)
    assert all((a == b).all() for a, b in zip(whole, set_join.word_hashes(data), strict=True))


def test_spelling_sees_only_pairs_that_share_runs_of_letters(spark, monkeypatch):
    """In small blocks as in large ones, Python compares near pairs only."""
    asked = []
    plain = facts.spelling_ratio
    monkeypatch.setattr(facts, "cut", lambda df: asked.append(df) or df)
    monkeypatch.setattr(facts, "spelling_ratio", plain)
    names = ["crimson winter morning", "crimsom winter morning", "bright yellow pencils", "silent forest walkers"]
    got = facts.equal_facts(spark.createDataFrame([(1, n, True) for n in names], "story int, key string, asked boolean"), "story")
    assert {(r.item, r.other, r.tier) for r in got.collect()} == {(names[0], names[1], "spelling"), (names[1], names[0], "spelling")}
    assert asked[-1].count() == 2  # of twelve
