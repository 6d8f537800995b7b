"""Feeds, filters, clusters and streams on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from newsgrain.operators import clustering, dedup, facts, greedy, maintenance, neighbours, serving, telemetry
from newsgrain.plans import streams as stream_queries
from newsgrain.sources import records
from newsgrain.streaming import streams


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<rss><channel><item><title>A &amp; B</title><link>http://X.com/a/?utm_source=q&amp;b=1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>
      <item><title>no link</title></item><item><title>C</title><link>http://x.com/c</link><updated>2024-01-02T03:04:05Z</updated></item><item><title>D</title><link>http://x.com/d</link><pubDate>soon</pubDate></item></channel></rss>""")
    rows = records.entry_pub_date(records.read_feed(spark, str(tmp_path)), F.lit("2024-05-05 00:00:00").cast("timestamp")).orderBy("title").collect()
    assert [(r.title, r.canonical, str(r.published_at)) for r in rows] == [("A & B", "http://x.com/a?b=1", "2024-01-01 10:00:00"), ("C", "http://x.com/c", "2024-01-02 03:04:05"), ("D", "http://x.com/d", "2024-05-05 00:00:00")]
    got = streams.run(streams.read_feeds(spark, str(tmp_path)), "append")
    assert {r.canonical for r in got.collect()} == {r.canonical for r in rows}


def test_scenarios_and_sitemap(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"scenario_id": "a", "articles": [{"title": "t", "content": "c"}], "forbidden_words": ["x"], "min_key_facts": 2}]')
    (r,) = records.read_scenarios(spark, str(tmp_path / "s.json")).collect()
    assert r.scenario_id == "a" and r.articles[0].title == "t" and r.min_key_facts == 2
    records.write_sitemap(spark.createDataFrame([("http://x/?a=1&b=2", "T <1>")], "loc string, title string"), str(tmp_path / "out"))
    body = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert "&amp;b=2" in body and "&lt;1" in body


def test_bloom_holds_its_rate_at_any_size(spark):
    for n, rate in ((1_000_000, 0.01), (20_000, 0.001), (300, 0.1)):
        df = spark.range(n + 200_000).select("id", F.concat(F.lit("key"), "id").alias("k"))
        got = dedup.probe_bloom(df, dedup.build_bloom(df.where(F.col("id") < n), "k", rate), "k").groupBy(F.col("id") < n, "maybe").count().collect()
        counts = {tuple(r)[:2]: tuple(r)[2] for r in got}
        assert counts[True, True] == n and (True, False) not in counts
        assert counts.get((False, True), 0) <= 200_000 * rate * 1.15
    assert dedup.bloom_shape(10**9, 0.01)[0] * 512 < 13 * 10**9  # bits a key


def test_blooms_merge(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("key"), "id").alias("k")).unionByName(spark.createDataFrame([(-1, None)], "id long, k string"))
    a, b = (dedup.build_bloom(df.where(c), "k", 0.01, expect=2000) for c in ("id < 1000", "id >= 1000 and id < 2000"))
    got = {r.id: r.maybe for r in dedup.probe_bloom(df, dedup.merge_blooms(a, b), "k").collect()}
    assert all(got[i] for i in range(2000)) and sum(got[i] for i in range(2000, 3000)) < 30 and not got[-1]
    with pytest.raises(Exception, match="different shapes"):
        dedup.merge_blooms(a, dedup.build_bloom(df, "k", 0.5)).collect()
    assert not any(r.maybe for r in dedup.probe_bloom(df, a.where("false"), "k").collect())


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    b = dedup.build_bloom(df.where("id < 1000"), "k", 0.005)
    rows = dedup.probe_bloom(df, b, "k").collect()
    assert all(r.maybe for r in rows if r.id < 1000)
    assert sum(r.maybe for r in rows if r.id >= 1000) < 0.05 * 2000


def test_near_duplicate_links(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(0, base), (1, base), (2, base + " extra"), (3, "something else entirely with other words in it and more of them"), (4, None), (5, "")]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert {(r.a, r.b) for r in got} == {(0, 2)} and all(r.jaccard >= 0.7 for r in got)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    ids = set(range(60)) | set(range(100, 131))
    root = {i: i for i in ids}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    got = clustering.connected_components(nodes, spark.createDataFrame(links, "a long, b long")).collect()
    assert {x.id: x.root for x in got} == root
    assert clustering.connected_components(nodes, spark.createDataFrame([], "a long, b long")).where("id <> root").count() == 0


def test_components_end_when_links_are_stars(spark, monkeypatch):
    """Stars need no round, and no round is made only to find that nothing changes."""
    written = []
    plain = clustering.cut
    monkeypatch.setattr(clustering, "cut", lambda df: written.append(1) or plain(df))
    for links, rounds in (([(1, 2), (1, 3), (5, 4)], 0), ([(1, 2), (2, 3)], 1), ([], 0)):
        written.clear()
        got = {(r.node, r.root) for r in clustering.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == ({(1, 1), (2, 1), (3, 1)} | ({(4, 4), (5, 4)} if rounds == 0 else set()) if links else set())
        assert len(written) == 1 + rounds


def test_alias_cycles(spark):
    aliases = spark.createDataFrame([(5, 6), (6, 7), (7, 5), (1, 5), (20, 21), (21, 22)], "alias long, target long")
    got = clustering.resolve_aliases(spark.createDataFrame([(i,) for i in (1, 5, 6, 7, 20, 21, 22, 30)], "id long"), aliases, rounds=6).collect()
    assert {r.id: r.target for r in got} == {1: 5, 5: 5, 6: 5, 7: 5, 20: 22, 21: 22, 22: 22, 30: 30}


def test_greedy_groups_partition_the_input(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    bare = v.withColumns({"names": F.array().cast("array<string>"), "source": F.lit(None).cast("string")})  # then the score is 0.45 * cosine + 0.145
    cols = {"id": "vec_id", "vector": "embedding", "events": "names", "entities": "names", "source": "source"}
    got = {r.id: r.leader for r in greedy.micro_clusters(bare, "label", ["vec_id"], cols, 0.45 * 0.3 + 0.145).collect()}
    rows = {r.vec_id: r for r in v.collect()}
    assert set(got) == set(rows)
    cos = lambda a, b: sum(x * y for x, y in zip(rows[a].embedding, rows[b].embedding, strict=True))
    want = {}
    for i in sorted(rows):
        lead = next((x for x in sorted(set(want.values())) if rows[x].label == rows[i].label and cos(x, i) >= 0.3), i)
        want[i] = lead
    assert got == want


def test_planes_find_close_vectors(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 150")
    copies = v.select((F.col("vec_id") + 1000).alias("vec_id"), "label", F.transform("embedding", lambda x: x * 1.001).alias("embedding"))
    every = v.unionByName(copies)
    exact = {(r.a, r.b) for r in clustering.nearby(every, "vec_id", "embedding", 0.95, method="exact").collect()}
    found = {(r.a, r.b) for r in clustering.nearby(every, "vec_id", "embedding", 0.95, recall=0.99).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact) > 0
    near = v.select((F.col("vec_id") + 5000).alias("vec_id"), "label", F.zip_with("embedding", F.reverse("embedding"), lambda x, y: x + 0.35 * y).alias("embedding"))
    mixed = v.unionByName(near).unionByName(v.select((F.col("vec_id") + 9000).alias("vec_id"), "label", "embedding"))  # and exact copies
    exact = {(r.a, r.b) for r in clustering.nearby(mixed.where("vec_id < 9000"), "vec_id", "embedding", 0.9, method="exact").collect()}
    for cap in (16384, 7):  # buckets that fit a tile, and such as are cut into tiles
        found = {(r.a, r.b) for r in clustering.nearby(mixed, "vec_id", "embedding", 0.9, recall=0.97, cap=cap).collect()}
        assert {(a, b) for a, b in found if b >= 9000} == {(i, i + 9000) for i in range(150)}
        assert len(exact & found) >= 0.95 * len(exact) > 100
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert clustering.nearby(odd, "vec_id", "embedding", 0.5).count() == 0


def test_many_queries_find_what_few_do(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.select("vec_id", F.zip_with("embedding", F.reverse("embedding"), lambda x, y: x + 0.3 * y).alias("embedding")).withColumn("vec_id", F.col("vec_id") + 10000)
    exact = {(r.query, r.found, r.rank) for r in neighbours.similar(q, v, 1, 0.8).collect()}
    found = {(r.query, r.found, r.rank) for r in neighbours.similar(q, v, 1, 0.8, method="planes").collect()}
    assert len(exact & found) >= 0.9 * len(exact) > 100 and found <= exact | found


def test_silhouette(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0]), (4, [0.01, 0.99]), (5, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    assign = clustering.cluster_vectors(v, "id", "v", 0.5)
    assert clustering.silhouette(assign, v, "id", "v") > 0.9
    assert clustering.cluster_quality(assign).first() == (2, 1, 2.0)
    assert clustering.silhouette(assign.where("root = 1"), v, "id", "v") == 0.0


def test_pairs_in_order_equal_a_loop(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 0.3)], r.randint(1, 5)) for i in range(60)]
    rows += [(100, rows[3][1], 9), (101, rows[3][1], 9)]
    got = clustering.find_duplicate_stories(spark.createDataFrame(rows, "id long, v array<double>, n int"), "id", "v", "n", sure=0.95, method="exact").collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    pairs = []
    for i, (a, x, m) in enumerate(rows):
        for b, y, n in rows[i + 1 :]:
            c = 2.0 if x == y else dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5  # equal vectors come first
            if c >= 0.95:
                pairs.append((-c, *((a, b) if (m, -a) > (n, -b) else (b, a))))
    gone, kept, want = set(), set(), set()
    for c, s, x in sorted(pairs, key=lambda p: (p[0], p[1] != 100, p)):
        if s not in gone and x not in gone and x not in kept:
            gone.add(x)
            kept.add(s)
            want.add((s, x))
    assert {(g.survivor, g.absorbed) for g in got} == want and (100, 101) in want and (100, 3) in want


def test_duplicate_stories(spark):
    rows = [(1, [1.0, 0.0], 5), (2, [0.99, 0.05], 9), (3, [0.97, 0.2], 1), (4, [0.0, 1.0], 1), (5, [0.01, 1.0], 1)]
    got = clustering.find_duplicate_stories(spark.createDataFrame(rows, "id long, v array<double>, n int"), "id", "v", "n").collect()
    gone = [r.absorbed for r in got]
    assert len(gone) == len(set(gone)) and not {r.survivor for r in got} & set(gone)
    assert (4, 5) in {(r.survivor, r.absorbed) for r in got} and 1 in gone


def test_coreference(spark):
    rows = [(1, "Trump"), (1, "Donald Trump"), (1, "President Trump"), (2, "Trump"), (1, "Ann Lee")]
    got = {(r.story, r.name): r.representative for r in clustering.coref_groups(spark.createDataFrame(rows, "story long, name string"), "story", "name").collect()}
    assert got[1, "Trump"] == "President Trump" and got[2, "Trump"] == "Trump" and got[1, "Ann Lee"] == "Ann Lee"


def test_percentiles_with_frequent_values(spark):
    r = random.Random(8)
    rows = [(k, float(v)) for k in (1, 2, None) for v in [7.0] * 700 + [r.gauss(10, 5) for _ in range(900)] + [-3.0] * 30] + [(5, 1.5), (6, None), (7, 1.0), (7, 2.0)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(3)
    import numpy as np

    ordered = {x.k: x for x in telemetry.percentiles(df, "k", "v", 12.0, small=1200).collect()}
    whole = {x.k: x for x in telemetry.percentiles(df, "k", "v", 12.0).collect()}
    assert set(ordered) == set(whole) == {1, 2, None, 5, 7}
    for k, x in [*ordered.items(), *whole.items()]:
        v = np.array([b for a, b in rows if a == k and b is not None])
        assert np.allclose([x.p50, x.p90, x.p99], np.percentile(v, [50, 90, 99]), atol=1e-6) and x.largest == v.max() and x.above == (v > 12).sum()


def test_facts_of_one_source_only(spark):
    rows = [(1, "a", "Dimaagi Naxals"), (1, "b", "dimagi naxals"), (1, "a", "15 dead"), (1, "b", "50 dead"), (1, "b", "The Colombian Government."), (1, "a", "colombian government"), (2, "a", "alone")]
    df = spark.createDataFrame(rows, "story long, source string, fact string")
    got = {(r.source, r.fact) for r in facts.unique_facts(df, "story", "source", "fact").collect()}
    assert got == {("a", "15 dead"), ("b", "50 dead"), ("a", "alone")}
    plain = {(r.source, r.fact) for r in facts.unique_facts(df, "story", "source", "fact", spelling=False).collect()}
    assert plain == got | {("a", "Dimaagi Naxals"), ("b", "dimagi naxals")}


def test_state_of_streams_goes(spark, tmp_path):
    t0 = 1_700_000_000
    rows = [(1, t0, 1, "x", 1.0, "u"), (2, t0 + 10, 1, "x", 3.0, "u"), (3, t0 + 40 * 86_400, 2, "x", 5.0, "u"), (4, t0 + 80 * 86_400, 2, "x", 7.0, "u"), (5, t0 + 81 * 86_400, 1, "x", 9.0, "u")]
    for i, row in enumerate(rows):
        df = spark.createDataFrame([row], "event_id long, t long, user_id long, event_type string, value double, props string")
        df.select("event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / f"d{i}"))
        next((tmp_path / f"d{i}").glob("part*")).rename(tmp_path / f"events{i}.parquet")
    events = streams.read_events(spark, str(tmp_path))
    got = {(r.user_id, r.attempts, round(r.average, 6)) for r in streams.run(streams.domain_policy(events, "user_id", idle_days=30), "update").collect()}
    assert (1, 2, 1.2) in got or (1, 1, 1.0) in got
    assert (1, 1, 9.0) in got  # reader 1 was forgotten in between


def test_near_duplicates_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    r = random.Random(2)
    base = [r.choice("abcdefghijklmnop") * 3 + str(r.randint(0, 50)) for _ in range(80)]
    for i in range(60):  # one large group, whose members are not all alike
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(80)] = f"edit{r.random()}"
        rows.append((10_000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets, seen = {}, set()
    for i, t in sorted(rows):
        if t not in seen:
            seen.add(t)
            w = (t or "").lower().strip().split()
            sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    ids = sorted(sets)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) > 0}
    got = {(x.a, x.b) for x in dedup.near_duplicates(docs, "doc_id", "text").collect()}
    assert len(got - want) <= 0.02 * len(want)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert sum(top(a) == top(b) for a, b in want) >= 0.9 * len(want) > 100


def test_split_is_a_partition(spark, sf):
    from newsgrain import catalog

    rows = catalog.queries()["clu6_split_clusters"](spark, sf).collect()
    assert len({(r.l_orderkey, r.i) for r in rows}) == len(rows)
    assert {r.status for r in rows} <= {"auto", "needs_review"}


def test_purge_refuses_when_signatures_disagree(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    with pytest.raises(ValueError):
        maintenance.signature_purge(df, F.col("id") == 1, F.col("id") == 2, ["t"])
    assert maintenance.signature_purge(df, F.col("id") == 1, F.col("id") == 1, ["t"]).count() == 1


def test_feed_without_preference(spark):
    users = spark.createDataFrame([(1, "x"), (2, None), (3, "none")], "u long, pref_c string")
    stories = spark.createDataFrame([(10, "x", 5), (11, "y", 9), (12, "x", 7)], "s long, c string, n int")
    got = {(r.u, r.s) for r in serving.personal_feed(users, stories, "u", "c", [F.desc("n"), F.col("s")], 2).collect()}
    assert got == {(1, 12), (1, 10), (2, 11), (2, 12)}


def test_streams_do_not_depend_on_batches(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(3):
        e.where(f"event_id % 1000 >= {i * 334} AND event_id % 1000 < {(i + 1) * 334}").coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        next((tmp_path / f"t{i}").glob("part*")).rename(tmp_path / f"events{i}.parquet")
    one = {tuple(r) for r in stream_queries.str11(spark, sf).collect()}
    assert {tuple(r) for r in stream_queries.str11(spark, str(tmp_path)).collect()} == one
    want = {tuple(r) for r in stream_queries.str4(spark, sf).collect()}
    assert {tuple(r) for r in stream_queries.str4(spark, str(tmp_path)).collect()} == want


def test_candidate_windows_do_not_depend_on_batches(spark, tmp_path):
    """Entries out of order by less than the allowed lateness, in files of any number: one answer."""
    r = random.Random(8)
    start = 1_700_000_000
    rows = [(i, start + 20 * i + r.randint(-150, 150), f"h{r.randint(0, 40)}", f"u{r.randint(0, 4)}") for i in range(600)] + [(9999, start + 200_000, "end", "u")]
    want, by = set(), {}
    for _, t, h, u in sorted(rows, key=lambda x: (x[1], x[3])):
        by.setdefault(h, []).append((t, u))
    for h, entries in by.items():
        end, urls = entries[0][0] + 60, []
        for t, u in entries:
            if t <= end and u not in urls and len(urls) < 3:
                urls.append(u)
        if end <= start + 200_000 - 600:
            want.add((h, len(urls), "count" if len(urls) == 3 else "time"))
    df = spark.createDataFrame([(i, t, 0, h, 0.0, u) for i, t, h, u in rows], "event_id long, t long, user_id long, event_type string, value double, props string")
    df = df.select("event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    for files in (1, 5):
        place = tmp_path / str(files)
        place.mkdir()
        for k in range(files):
            df.where(F.floor(F.least(F.col("event_id"), F.lit(600)) * files / 601) == k).coalesce(1).write.parquet(str(place / f"d{k}"))
            next((place / f"d{k}").glob("part*")).rename(place / f"events{k}.parquet")
        got = streams.run(streams.candidates(streams.read_events(spark, str(place)), "event_type", "props"), "append").collect()
        assert {(g.event_type, g.urls, g.fired_by) for g in got} == want and len(got) == len(want) > 30


def test_headlines_of_a_batch_share_calls(spark, tmp_path):
    """Twenty thousand headlines, each with a window of its own, in one bucket or in many: one row a headline."""
    df = spark.range(60_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3).cast("timestamp_ntz").alias("ts"), F.lit(0).cast("long").alias("user_id"),
                                    F.concat(F.lit("h"), F.floor(F.col("id") / 3)).alias("event_type"), F.lit(0.0).alias("value"), F.concat(F.lit("u"), F.col("id") % (2 + F.floor(F.col("id") / 3) % 2)).alias("props"))
    end = df.limit(1).withColumn("ts", F.lit("2023-12-01").cast("timestamp_ntz")).withColumn("event_type", F.lit("end"))
    df.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("part*")).rename(tmp_path / "events.parquet")
    want = {(2, "time"): 10_000, (3, "count"): 10_000}
    for buckets in (1, 64):
        got = streams.run(streams.candidates(streams.read_events(spark, str(tmp_path)), "event_type", "props", buckets=buckets), "append")
        assert {(r.urls, r.fired_by): r["count"] for r in got.groupBy("urls", "fired_by").count().collect()} == want


def test_candidate_windows(spark, tmp_path):
    rows = [("a", "u1", 0), ("a", "u2", 5), ("a", "u2", 6), ("a", "u3", 7), ("a", "u4", 8), ("b", "u1", 0), ("b", "u2", 100), ("c", "u1", 3)]
    df = spark.createDataFrame([(i, 1_700_000_000 + t, 0, h, 0.0, u) for i, (h, u, t) in enumerate(rows)] + [(99, 1_700_000_000 + 90_000, 0, "late", 0.0, "u")], "event_id long, t long, user_id long, event_type string, value double, props string")
    df = df.select("event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("part*")).rename(tmp_path / "events.parquet")
    got = streams.run(streams.candidates(streams.read_events(spark, str(tmp_path)), "event_type", "props"), "append").collect()
    assert {(r.event_type, r.urls, r.fired_by) for r in got} >= {("a", 3, "count"), ("b", 1, "time"), ("c", 1, "time")}


def test_contradictions_deal_events_before_they_sum_up(spark):
    """One shuffle by story, before any sum, so that no task sorts a whole file."""
    from newsgrain.operators import compare

    e = spark.createDataFrame([(1, 1, "a", "2024-01-01", 1.0), (1, 2, "b", "2024-01-01", 1.0)], "story int, src int, v string, d string, n double")
    found = compare.contradictions(e.withColumn("d", F.to_date("d")), "story", "src", {"v": F.col("v")}, "d", "n")
    assert [tuple(r) for r in found.collect()] == [(1, 1, 2, "v")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [story") == 2
