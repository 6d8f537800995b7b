"""Neighbours: exact tiles against all pairs, planes against their stated recall, candidates in a window of time."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsgrain.operators import clustering, matching, neighbours


def planted(n, least, pairs, seed, dims=64):
    """Random unit vectors, of which the first ``2 * pairs`` make pairs just above ``least``."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims)).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 2 * pairs, 2):
        c = least + 0.004 * r.random()
        z = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
    return x


def frame(spark, x):
    v = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1))
    return spark.createDataFrame(pa.table({"id": np.arange(len(x)), "v": v})).repartition(8)


def all_pairs(x, least):
    s = np.round(x @ x.T, 12)
    a, b = np.nonzero(np.triu(s >= least, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("cap", [16384, 100, 3])
def test_exact_tiles_give_all_pairs_whatever_their_size(spark, cap):
    x = planted(230, 0.6, 20, 1)
    got = neighbours.nearby(frame(spark, x), "id", "v", 0.4, method="exact", cap=cap).collect()
    assert {(r.a, r.b) for r in got} == all_pairs(x, 0.4) and len(got) == len(all_pairs(x, 0.4))
    assert all(abs(r.cosine - x[r.a] @ x[r.b]) < 1e-11 and r.chance == 1.0 for r in got)


@pytest.mark.parametrize(("n", "least"), [(5000, 0.595), (5000, 0.72), (5000, 0.9), (100_000, 0.72), (100_000, 0.9), (100_000, 0.93875)])
def test_recall_just_above_the_threshold(spark, n, least):
    pairs = 1000
    x = planted(n, least, pairs, 2)
    got = neighbours.nearby(frame(spark, x.astype(np.float32)), "id", "v", least - 1e-6, recall=0.95)
    found = {(r.a, r.b): r.chance for r in got.where(f"a < {2 * pairs} and b = a + 1 and a % 2 = 0").collect()}
    assert len(found) >= 0.9 * pairs
    assert all(0.95 - 1e-9 <= c <= 1 for c in found.values())


def test_plan_keeps_its_recall_at_any_size():
    for least in (0.595, 0.72, 0.9, 0.93875):
        for n in (500, 5000, 10**5, 10**7):
            plan = neighbours.plane_plan(least, 0.95, n)
            assert plan.recall >= 0.95 and plan.chance(least + 0.02) > plan.recall
    assert neighbours.plane_plan(0.93875, 0.95, 10**9).planes > neighbours.plane_plan(0.93875, 0.95, 10**4).planes
    with pytest.raises(ValueError, match="exact"):
        neighbours.plane_plan(0.05, 0.9999999, 1000, most=20)


def test_links_of_a_dense_group_are_few(spark):
    r = np.random.default_rng(3)
    centre = r.standard_normal(64)
    x = np.concatenate([centre + 0.05 * r.standard_normal((600, 64)), planted(100, 0.9, 10, 4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for kw in ({"method": "exact"}, {"method": "exact", "cap": 50}, {"method": "planes", "recall": 0.999}):
        links = neighbours.near_links(frame(spark, x), "id", "v", 0.85, **kw)
        got = clustering.connected_components(frame(spark, x), links).collect()
        assert all(g.root == 0 for g in got if g.id < 600) and {(g.id, g.root) for g in got if g.id >= 600 and g.root != g.id} == {(600 + i, 599 + i) for i in range(1, 20, 2)}
    assert neighbours.near_links(frame(spark, x), "id", "v", 0.85, method="exact").count() <= 700


@pytest.mark.parametrize("cap", [16384, 40])
def test_search_equals_a_loop(spark, cap):
    x = planted(300, 0.6, 40, 5)
    x[200:210] = x[7]  # equal vectors: the least ids come first
    x[250] = 0
    v = frame(spark, x)
    got = sorted((r.query, r.rank, r.found, round(r.cosine, 9)) for r in neighbours.similar(v.where("id % 7 = 0"), v, 4, 0.2, "id", "v", after=F.col("id") != 3, cap=cap).collect())
    want = []
    for q in range(0, 300, 7):
        s = np.round(x @ x[q], 12)
        best = sorted((-s[i], i) for i in range(300) if i not in (q, 3) and s[i] >= 0.2)[:4]
        want += [(q, k, i, round(-c, 9)) for k, (c, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_odd_vectors(spark):
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0])], "id long, v array<double>")
    for method in ("exact", "planes"):
        assert [(r.a, r.b) for r in neighbours.nearby(odd, "id", "v", 0.5, method=method).collect()] == [(5, 6)]
        assert {(r.query, r.found) for r in neighbours.similar(odd, odd, 3, 0.5, "id", "v", method=method).collect()} == {(5, 6), (6, 5)}
        assert neighbours.nearby(odd.where("id > 10"), "id", "v", 0.5, method=method).count() == 0
        assert neighbours.similar(odd.where("id > 10"), odd, 3, 0.5, "id", "v", method=method).count() == 0


def moments(r):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * r.randint(0, 600))


@pytest.mark.parametrize("slice_hours", [1, 24, 10000])
def test_candidates_equal_a_loop(spark, slice_hours):
    r = random.Random(9)
    ents = lambda: r.choice([None, []]) if r.random() < 0.15 else ["Common"] * (r.random() < 0.7) + [r.choice("abcdeF") for _ in range(2)]
    stories = [(i, ents(), moments(r) if r.random() > 0.03 else None, r.choice([*matching.LIVE, "archived", None])) for i in range(300)]
    articles = [(i, ents(), moments(r) if r.random() > 0.03 else None) for i in range(120)]
    linked = [(r.randint(0, 119), r.randint(0, 299)) for _ in range(60)] + [(5, i) for i in range(250)]
    a = spark.createDataFrame(articles, "article long, ents array<string>, seen timestamp")
    s = spark.createDataFrame(stories, "story long, ents array<string>, updated timestamp, state string")
    got = matching.candidates(a, s, spark.createDataFrame(linked, "article long, story long"), "article", "story", "ents", "updated", 6, "seen", "state", 72, slice_hours).collect()
    want = set()
    for i, e, seen in articles:
        mine = {x.lower() for x in e or []}
        fits = [(-t.timestamp(), j) for j, f, t, state in stories if seen and t and seen - dt.timedelta(hours=72) <= t <= seen and state in matching.LIVE and (i, j) not in set(linked)
                and (not mine or not f or mine & {x.lower() for x in f})]
        want |= {(i, j) for _, j in sorted(fits)[:6]}
    assert {(g.article, g.story) for g in got} == want and len(got) == len(want) > 300


def test_duplicate_stories_in_the_window_that_pass_both_stages(spark):
    day = dt.datetime(2024, 1, 2)
    row = lambda i, v, n, t, ents: (i, v, n, t, ents, [], ["w"], v, ents, ["w" if ents == ["x"] else "z"], t)
    rows = [row(1, [1.0, 0.0], 3, day, ["x"]), row(2, [1.0, 0.1], 1, day, ["x"]), row(3, [1.0, 0.05], 1, day, ["other"]), row(4, [1.0, 0.02], 9, day - dt.timedelta(days=5), ["x"]), row(5, [1.0, 0.0], 1, day, ["x"])]
    s = spark.createDataFrame(rows, "id long, centroid array<double>, n int, time timestamp, entities array<string>, locations array<string>, words array<string>, article_vector array<double>, article_entities array<string>, article_words array<string>, article_time timestamp")
    run = lambda **kw: {(r.survivor, r.absorbed) for r in clustering.find_duplicate_stories(s, "id", "centroid", "n", 0.6, when="time", now=F.lit(day).cast("timestamp"), passes=clustering.same_event, method="exact", **kw).collect()}
    assert run() == {(1, 2), (1, 5)}  # 3 fails stage A, 4 is too old
    assert run(cap=1) == {(1, 5)}


def test_a_tile_gives_its_pairs_slab_by_slab():
    """All vectors near each other: no batch holds more than a slab's share, and together they are all pairs."""
    import pyarrow as pa

    n = 600
    v = np.ones((n, 4)) / 2
    got = list(neighbours._pairs(0.9)(pa.array(range(n)), v, np.zeros(n, int), True))
    assert len(got) > 1 and max(len(c[0]) for c in got) <= neighbours._ROWS
    assert sum(len(c[0]) for c in got) == n * (n - 1) // 2


def test_candidates_do_not_depend_on_the_length_of_runs(spark, monkeypatch):
    monkeypatch.setattr(matching, "_RUN", 3)
    test_candidates_equal_a_loop(spark, 1)


@pytest.mark.parametrize("spiky", [False, True])
def test_sketches_miss_no_pair_and_are_small(spiky):
    """Bytes that go to the buckets: eight more than the vector has numbers; every pair at the threshold is a candidate."""
    n = 1500
    x = planted(n, 0.72, 500, 8)
    if spiky:  # one large number makes the steps of the others coarse
        x[:, 0] += 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n - 1] = np.nan
    least = 0.9 if spiky else 0.72
    sketches = neighbours._sketch(x)
    assert {len(b) for b in sketches.to_pylist()} == {64 + 8}
    near, off = neighbours._unsketch(sketches)
    assert (np.linalg.norm(near - x, axis=1)[: n - 1] <= off[: n - 1]).all()
    got = {(a, b): s for x_, y_, sure in neighbours._candidates(least)(pa.array(range(n)), (near, off), np.zeros(n, int), True) for a, b, s in zip(x_.to_pylist(), y_.to_pylist(), sure.tolist(), strict=True)}
    want = all_pairs(np.nan_to_num(x), least)
    assert {p for p, sure in got.items() if sure} <= want <= set(got) and len(want) > 400


def test_planes_write_no_vectors_and_give_whole_cosines(spark, monkeypatch):
    """Of buckets nothing is written; pairs and cosines are those of the whole vectors, also in buckets of several tiles."""
    x = planted(400, 0.8, 100, 9)
    x[399] = np.nan
    wide = []
    monkeypatch.setattr(neighbours, "cut", lambda df, real=neighbours.cut: (wide.append(df.columns), real(df))[1])
    for cap in (16384, 7):
        got = {(r.a, r.b): r.cosine for r in neighbours.nearby(frame(spark, x), "id", "v", 0.8, recall=0.9999, cap=cap).collect()}
        want = all_pairs(np.nan_to_num(x), 0.8)
        assert set(got) <= want and len(got) >= 0.98 * len(want)
        assert {(r.a, r.b) for r in neighbours.planes_pairs(frame(spark, x), "id", "v", 0.8, recall=0.9999, cap=cap).collect()} == set(got)
        assert all(abs(c - x[a] @ x[b]) < 1e-11 for (a, b), c in got.items())
    assert wide and not any("bucket" in c and "v" in c for c in wide)


def test_pairs_of_odd_vectors(spark):
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [2.0, 0.0])], "id long, v array<double>")
    assert {(r.a, r.b) for r in neighbours.planes_pairs(odd, "id", "v", 0.5).collect()} == {(5, 6), (6, 7)}
    assert neighbours.planes_pairs(odd.where("id > 10"), "id", "v", 0.5).count() == 0


def test_articles_that_ask_at_one_moment_share_what_is_found(spark, monkeypatch):
    """Stories and articles of whole days: what is written follows moments, entities and what can be chosen, not the articles."""
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    r = random.Random(4)
    ents = lambda: r.choice([None, ["a"], ["B", "c"], ["d"], ["a", "D"]])
    stories = [(i, ents(), day(r.randint(0, 6))) for i in range(600)]
    articles = [(i, ents(), day(r.randint(0, 6))) for i in range(500)]
    linked = [(i, r.randint(0, 599)) for i in range(0, 500, 2)]
    written = []
    for f in {"cut", "counted_cut"} & set(vars(matching)):
        monkeypatch.setattr(matching, f, lambda df, *more, real=getattr(matching, f): (written.append((df.columns, df.count())), real(df, *more))[1])
    a = spark.createDataFrame(articles, "article long, ents array<string>, seen timestamp")
    s = spark.createDataFrame(stories, "story long, ents array<string>, updated timestamp")
    got = matching.candidates(a, s, spark.createDataFrame(linked, "article long, story long"), "article", "story", "ents", "updated", 3, "seen").collect()
    want, gone = set(), set(linked)
    for i, e, seen in articles:
        mine = {x.lower() for x in e or []}
        fits = [(-t.timestamp(), j) for j, f, t in stories if seen - dt.timedelta(hours=72) <= t <= seen and (i, j) not in gone and (not mine or not f or mine & {x.lower() for x in f})]
        want |= {(i, j) for _, j in sorted(fits)[:3]}
    assert {(g.article, g.story) for g in got} == want and len(got) == len(want) == 1500
    moments, keys = 7, 6
    assert all(n <= moments * keys * (4 + 2) for columns, n in written if "_es" not in columns) and len(written) > 1


def test_pairs_by_bytes_are_all_pairs(spark):
    """Pairs just above a low threshold, of which planes miss some; and copies, which stand for pairs of their own."""
    x = planted(3000, 0.595, 1000, 2)
    x[2990:] = x[2]
    v = frame(spark, x.astype(np.float32))
    found = neighbours.planes_pairs(v, "id", "v", 0.595 - 1e-6, cap=700)
    s = np.round(x @ x.T, 6)
    want = int((np.triu(s, 1) >= 0.595).sum())
    assert {(2 * i, 2 * i + 1) for i in range(1000)} <= {(r.a, r.b) for r in found.collect()}
    counted = neighbours.with_copies(found, v, "id", "v").agg(F.sum("n").alias("n")).first().n
    exact = neighbours.with_copies(neighbours.nearby(v, "id", "v", 0.595 - 1e-6, method="exact"), v, "id", "v").agg(F.sum("n").alias("n")).first().n
    assert counted == exact == want > 1000 + 55
