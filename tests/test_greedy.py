"""Groups that depend on order, streamed upserts and mergeable percentiles against plain loops."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrain.operators import greedy, telemetry
from newsgrain.streaming import upserts


def jac(a, b):
    a, b = {x for x in a or [] if x is not None}, {x for x in b or [] if x is not None}
    return len(a & b) / len(a | b) if a | b else 0.0


def pair(x, y):
    vec = 0.0
    if x["v"] and y["v"]:
        a, b = np.array(x["v"]), np.array(y["v"])
        n = np.linalg.norm(a) * np.linalg.norm(b)
        vec = a @ b / n if n else 0.0
    same = x["source"] is not None and x["source"] == y["source"]
    return round(0.45 * vec + 0.25 * jac(x["events"], y["events"]) + 0.15 * jac(x["ents"], y["ents"]) + 0.095 + 0.05 * (0.8 if same else 1.0), 9)


def event(x, y):
    if x["kind"] is None or y["kind"] is None:
        return 0.0
    a, b = (x["location"] or "").strip().lower(), (y["location"] or "").strip().lower()
    place = 0.5 if not a or not b else 1.0 if a == b else 0.8 if a in b or b in a else 0.0
    kind = 1.0 if x["kind"] == y["kind"] else 0.5 if x["parent"] is not None and x["parent"] == y["parent"] else 0.0
    day = 0.5 if x["date"] is None or y["date"] is None else float(x["date"] == y["date"])
    return 0.25 * jac(x["actors"], y["actors"]) + 0.20 * jac(x["targets"], y["targets"]) + 0.20 * place + 0.15 * kind + 0.10 * day


def test_micro_clusters_equal_a_loop(spark):
    r = random.Random(1)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    near = lambda: [x + r.gauss(0, 0.2) for x in r.choice(base)]
    rows = [{"block": r.choice(["x", "y", None]), "id": i, "v": r.choice([near(), near(), near(), None]), "events": r.choice([["a"], ["b", "a"], None, []]), "ents": r.choice([["p", "q"], ["p", None], None, [chr(97 + k) for k in range(9)]]), "source": r.choice([1, 2, None])} for i in range(150)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "block string, id long, v array<double>, events array<string>, ents array<string>, source long").repartition(6)
    got = {g.id: g for g in greedy.micro_clusters(df, "block", ["id"], {"id": "id", "vector": "v", "events": "events", "entities": "ents", "source": "source"}).collect()}
    assert len(got) == len(rows)
    for block in ("x", "y", None):
        left, part = [x for x in rows if x["block"] == block], 0
        while left:
            lead = left[0]
            mine = [lead, *[x for x in left[1:] if pair(lead, x) >= 0.70]]
            left = [x for x in left if x not in mine]
            assert all(got[x["id"]].leader == lead["id"] and got[x["id"]].part == part for x in mine)
            g, vectors = got[lead["id"]], [x["v"] for x in mine if x["v"]]
            assert g.entities == sorted({e for x in mine for e in x["ents"] or [] if e is not None})[:5] and g.event == (lead["events"] or [None])[0]
            assert (g.centroid is None) == (not vectors) and (not vectors or np.allclose(g.centroid, np.mean(vectors, axis=0)))
            assert all(got[x["id"]].centroid is None for x in mine[1:])
            part += 1
    assert len({g.leader for g in got.values()}) < 120


EVENT = {"id": "id", "kind": "kind", "parent": "parent", "actors": "actors", "targets": "targets", "location": "location", "date": "date"}


def events(spark, seed, n, stories):
    r = random.Random(seed)
    rows = [{"story": r.randrange(stories), "id": i, "kind": r.choice(["A", "A", "B", None]), "parent": r.choice(["P", "P", None]), "actors": r.choice([["x"], ["x", "y"], None]), "targets": r.choice([["t"], ["t", "u"]]), "location": r.choice(["Delhi", "New Delhi", " delhi", None]),
             "date": r.choice([1, 1, 2, None]), "ents": r.choice([["e"], ["e", "f"], []])} for i in range(n)]
    return rows, spark.createDataFrame([tuple(x.values()) for x in rows], "story long, id long, kind string, parent string, actors array<string>, targets array<string>, location string, date int, ents array<string>").repartition(5)


def first_fit(rows, score, fits, doubt):
    parts, out = [], {}
    for x in rows:
        unsure, at = False, None
        for k, p in enumerate(parts):
            mean = round(sum(score(x, y) for y in p) / len(p), 9) if x["kind"] is not None else -1.0
            unsure |= doubt(mean)
            if fits(mean):
                at = k
                break
        if at is None:
            at = len(parts)
            parts.append([])
        parts[at].append(x)
        out[x["id"]] = (at, "needs_review" if unsure else "auto")
    return out


def test_verified_split_equals_a_loop(spark):
    rows, df = events(spark, 2, 260, 12)
    got = {g.id: (g.part, g.status) for g in greedy.split_clusters(df, "story", ["id"], EVENT | {"entities": "ents"}).collect()}
    want = {}
    for s in range(12):
        want |= first_fit([x for x in rows if x["story"] == s], lambda x, y: event(x, y) + 0.1 * jac(x["ents"], y["ents"]), lambda m: m >= 0.8, lambda m: 0.7 <= m < 0.9)
    assert got == want and {s for _, s in want.values()} == {"auto", "needs_review"}


def test_manual_split_peels_the_first_row_off_a_story_that_holds(spark):
    rows, df = events(spark, 3, 120, 30)
    same = [(99, 1000 + i, "A", "P", ["x"], ["t"], "Delhi", 1, ["e"]) for i in range(4)] + [(98, 2000, "A", "P", ["x"], ["t"], "Delhi", 1, ["e"])]
    got = {g.id: g.part for g in greedy.split_story(df.unionByName(spark.createDataFrame(same, df.schema)), "story", ["id"], EVENT).collect()}
    for s in range(30):
        mine = [x for x in rows if x["story"] == s]
        want = {i: p for i, (p, _) in first_fit(mine, event, lambda m: m >= 0.8, lambda m: False).items()}
        if len(want) > 1 and not any(want.values()):
            want = {x["id"]: int(k > 0) for k, x in enumerate(mine)}
        assert {i: got[i] for i in want} == want
    assert [got[1000 + i] for i in range(4)] == [0, 1, 1, 1] and got[2000] == 0


def test_greedy_groups_of_empty_tables(spark):
    _, df = events(spark, 4, 5, 2)
    assert greedy.split_clusters(df.where("false"), "story", ["id"], EVENT | {"entities": "ents"}).count() == 0
    assert greedy.split_story(df.where("false"), "story", ["id"], EVENT).count() == 0


def totals():
    return {"n": F.coalesce("b.n", F.lit(0)) + F.coalesce("d.n", F.lit(0)), "most": F.greatest("b.most", "d.most")}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    table = upserts.UpsertTable(spark, str(tmp_path / "t"), ["k"], "k string, n long, most double", 8)
    r = random.Random(3)
    batches = [[(r.choice("abcdefghij"), r.random()) for _ in range(r.randint(1, 12))] for _ in range(5)]
    frames = [spark.createDataFrame(b, "k string, v double").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most")) for b in batches]
    show = lambda v: {tuple(x) for x in table.snapshot(v).collect()}
    plain = lambda n: {(k, sum(x == k for b in batches[:n] for x, _ in b), max(v for b in batches[:n] for x, v in b if x == k)) for k in {x for b in batches[:n] for x, _ in b}}
    assert show(0) == set() and table.latest() == 0
    for i, f in enumerate(frames):
        table.merge(f, i, totals())
        assert show(i + 1) == plain(i + 1)
        table.merge(f, i, totals())  # the same batch after a failure
        assert show(i + 1) == plain(i + 1) and show(i) == plain(i)
    assert table.latest() == 5
    held = table.manifest(5)
    assert set(held.values()) <= set(range(1, 6)) and len(held) <= 8


def test_a_stream_of_any_files_keeps_the_same_totals(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    want = {tuple(x) for x in e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")).collect()}
    for files in (1, 3):
        e.repartition(files).write.parquet(str(tmp_path / f"in{files}"))
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{files}"))
        table = upserts.UpsertTable(spark, str(tmp_path / f"t{files}"), ["user_id"], "user_id long, n long, most double", 4)
        assert table.follow(stream, [F.count(F.lit(1)).alias("n"), F.max("value").alias("most")], totals()) == files
        assert {tuple(x) for x in table.snapshot(files).collect()} == want
        assert table.follow(stream, [F.count(F.lit(1)).alias("n"), F.max("value").alias("most")], totals()) == files  # nothing new


@pytest.mark.parametrize("minutes", [5, 60])
def test_percentiles_of_merged_buckets_lie_in_the_bucket_of_the_exact_ones(spark, minutes):
    r = random.Random(7)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(4 * 3600)), r.choice([None, r.expovariate(0.08), r.expovariate(1), 500.0 * r.random()]), r.random() < 0.1) for _ in range(4000)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, latency double, bad boolean")
    parts = [telemetry.window_buckets(df.where(c), "ts", minutes, F.col("bad"), "latency", F.when(F.col("bad"), -1).otherwise(1)) for c in ("latency < 5", "latency >= 5 or latency is null")]
    got = {x.start: x for x in telemetry.alerts(telemetry.merge_windows(parts[0].unionByName(parts[1]), 60), 30.0, 0.1, 1000).collect()}
    backlog = 0
    for h in range(4):
        at = dt.datetime(2024, 1, 1, h)
        mine = [x for x in rows if at <= x[0] < at + dt.timedelta(hours=1)]
        backlog += sum(-1 if b else 1 for _, _, b in mine)
        g, values = got[at], sorted(v for _, v, _ in mine if v is not None)
        exact = values[max(0, int(np.ceil(0.95 * len(values))) - 1)]
        edges = [0.0, *telemetry.EDGES]
        k = next((i for i in range(1, len(edges)) if exact <= edges[i]), None)
        assert (edges[k - 1] <= g.p95 <= edges[k]) if k else g.p95 == 300
        assert (g.n, g.backlog, g.is_behind, g.is_slow) == (len(mine), backlog, backlog > 1000, g.p95 > 30)


@pytest.mark.parametrize("entities", [True, False])
def test_small_blocks_are_compared_as_large_ones(entities):
    """Row by row, or by arrays: the same parts and doubts, and no likeness twice."""
    r = random.Random(11)
    names = (*greedy._EVENT_COLS, "entities")
    some = lambda xs: [r.choice(xs) for _ in range(r.randint(0, 3))]
    likeness = greedy._Likeness(names if entities else names[:-1], entities)
    fits, doubt = lambda m: m >= 0.6, lambda m: 0.4 <= m < 0.7
    parts = set()
    for _ in range(200):
        n = r.randint(1, 12)
        cols = {"kind": [r.choice("ab") if r.random() < 0.8 else None for _ in range(n)], "parent": [r.choice(["p", "q", None]) for _ in range(n)], "actors": [some("xyz") or None for _ in range(n)], "targets": [some(["t", "u", None]) for _ in range(n)],
                "location": [r.choice([" Rome", "rome", "North Rome", "Oslo", "", None]) for _ in range(n)], "date": [r.choice([1, 2, None]) for _ in range(n)], "entities": [some("ef") for _ in range(n)]}
        b = greedy.Block(cols)
        none = b.missing("kind")
        part, status = greedy._first_fit(b, lambda i: np.where(none[i], -1.0, b.events(i) + (0.10 * b.jaccard("entities", i) if entities else 0)), fits, doubt)
        assert greedy._first_fit_small(likeness, likeness.numbers([json.dumps(x) for x in zip(*[cols[n] for n in likeness.names])]), fits, doubt) == (part.tolist(), status)
        parts |= set(part.tolist())
    assert len(parts) > 4
