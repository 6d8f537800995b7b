"""Knowledge graphs, substring joins and merges over several tables against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from newsgrain.operators import clustering, compare, graph


@pytest.mark.parametrize("q", [1, 3, 5])
def test_contained_in_equals_a_nested_loop(spark, q):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ab é") for _ in range(r.randint(0, n)))
    small, large = [(r.randint(0, 1), word(5)) for _ in range(60)] + [(0, None), (1, "ab" * 30)], [(r.randint(0, 1), word(14)) for _ in range(80)] + [(0, None), (1, "xab" + "ab" * 30)]
    got = [tuple(x) for x in graph.contained_in(spark.createDataFrame(small, "s long, small string"), spark.createDataFrame(large, "s long, large string"), "s", q).collect()]
    want = {(s, x, y) for s, x in small for t, y in large if s == t and x and y and x in y}
    assert set(got) == want and len(got) == len(want)


def slow_graph(articles, events, entities, sources):
    nodes, edges = set(), set()
    for story in {a[0] for a in articles} | {e[0] for e in events} | {e[0] for e in entities}:
        names = {}
        for _, i, canon, value, cname, aliases in sorted((e for e in entities if e[0] == story), key=lambda e: e[1]):
            node = f"entity:{canon if canon is not None else i}"
            for n in [value, *([cname, *(aliases or [])] if cname is not None else [])]:
                if n:
                    names[n.lower()] = node
            nodes.add((story, node, "entity"))
        mine = [a for a in articles if a[0] == story]
        for _, a, _, s in mine:
            nodes.add((story, f"article:{a}", "article"))
            if s in sources:
                nodes.add((story, f"source:{s}", "source"))
                edges.add((story, f"article:{a}", f"source:{s}", "reported_by", None))
        for _, e, a, _, actors, targets, loc in (e for e in events if e[0] == story):
            nodes.add((story, f"event:{e}", "event"))
            if a in {x[1] for x in mine}:
                edges.add((story, f"article:{a}", f"event:{e}", "describes_event", None))
            for role, who in (("actor", actors), ("target", targets)):
                for w in who or []:
                    if w is not None and w.lower() in names:
                        edges.add((story, names[w.lower()], f"event:{e}", "participated_in", role))
            if loc:
                at = names.get(loc.lower()) or next((v for k, v in names.items() if k in loc.lower() or loc.lower() in k), None)
                if at:
                    edges.add((story, f"event:{e}", at, "located_at", None))
    return nodes, edges


@pytest.mark.parametrize("few", [0, 9, 64])
def test_typed_graph_equals_a_loop_by_either_way(spark, few, monkeypatch):
    monkeypatch.setattr(graph.graph_edges, "__defaults__", (few,))
    test_typed_graph_equals_a_loop(spark)


def test_small_stories_make_no_runs_of_letters(spark, monkeypatch):
    monkeypatch.setattr(graph, "contained_in", lambda *x: pytest.fail("names of a small story were cut into runs of letters"))
    test_typed_graph_equals_a_loop(spark)


def test_typed_graph_equals_a_loop(spark):
    r = random.Random(6)
    names = ["Delhi", "New Delhi", "Red Fort", "north korea", "Korea", "UN", "Acme Corp", "", "Lee", "Seoul city"]
    pick = lambda: r.choice([*names, None])
    articles = list({(s, a): (s, a, pick(), r.choice([1, 2, 3, None])) for s, a in [(r.randint(0, 5), r.randint(0, 9)) for _ in range(40)]}.values())
    events = [(r.randint(0, 5), i, r.choice([None, *range(12)]), r.choice(["attack", None]), [pick() for _ in range(2)], r.choice([None, [pick()]]), pick()) for i in range(60)]
    entities = [(r.randint(0, 5), i, r.choice([None, 100 + i % 5]), r.choice(names), pick(), r.choice([None, [pick(), "alias of " + r.choice(names)]])) for i in range(50)]
    frames = (spark.createDataFrame(articles, "story long, article long, title string, source long"), spark.createDataFrame(events, "story long, event long, article long, event_type string, actors array<string>, targets array<string>, location string"),
              spark.createDataFrame(entities, "story long, entity long, canonical long, value string, canonical_name string, aliases array<string>"), spark.createDataFrame([(1, "one"), (2, "two")], "source long, name string"))
    nodes, edges = (df.collect() for df in graph.knowledge_graph(*frames))
    want_nodes, want_edges = slow_graph(articles, events, entities, {1, 2})
    assert {(n.story, n.node, n.kind) for n in nodes} == want_nodes and len(nodes) == len(want_nodes)
    assert {tuple(e) for e in edges} == want_edges and len(edges) == len(want_edges)
    assert {e[3] for e in want_edges} == {"reported_by", "describes_event", "participated_in", "located_at"}


def test_merges_keep_one_row_a_key_and_follow_chains(spark):
    marks = spark.createDataFrame([("ann", 1, "a"), ("ann", 2, "b"), ("bob", 2, "c"), ("bob", 3, "d"), ("cy", 4, "e")], "user string, story long, note string")
    log = spark.createDataFrame([(1, "x"), (2, "x"), (4, "y")], "story long, note string")
    merges = spark.createDataFrame([(2, 1), (3, 2), (5, 5)], "story long, survivor long")
    out = graph.merge_stories({"marks": marks, "log": log, "versions": log}, merges, "story", {"marks": ["user"]}, ["versions"])
    assert {tuple(x) for x in out["marks"].collect()} == {("ann", 1, "a"), ("bob", 1, "c"), ("cy", 4, "e")}
    assert sorted(tuple(x) for x in out["log"].collect()) == [(1, "x"), (1, "x"), (4, "y")]
    assert sorted(tuple(x) for x in out["versions"].collect()) == [(1, "x"), (4, "y")]
    assert out["marks"].columns == ["user", "story", "note"]


@pytest.mark.parametrize("person", [True, False])
def test_coreference_equals_all_pairs(spark, person):
    r = random.Random(3)
    words = ["Lee", "ann", "Dr", "Mr", "Acme", "Inc", "corp", "World", "Bank", "of", "WB", "wb", "Group", "IBM"]
    rows = list({(r.randint(0, 2), " ".join(r.choice(words) for _ in range(r.randint(1, 3))) + r.choice(["", "", ".", "!"])) for _ in range(220)}) + [(0, "")]
    df = spark.createDataFrame([*rows, (0, None)], "story long, name string").repartition(4)
    got = {(g.story, g.name): g.representative for g in clustering.coref_groups(df, "story", "name", person).collect()}
    same = compare.same_person if person else compare.same_organisation
    a, b = df.toDF("story", "a"), df.toDF("story", "b")
    hits = a.join(b, "story").where(same(F.col("a"), F.col("b"))).collect()
    first = {}
    for s, x, y in hits:
        if len(y) > len(x) or (len(y) == len(x) and y < x):
            first[s, x] = max(first.get((s, x), y), y, key=lambda n: (len(n), n))
    one = {k: first.get(k, k[1]) for k in {(s, n) for s, n in rows}}
    assert got == {(s, n): one.get((s, rep), rep) for (s, n), rep in one.items()}
    assert sum(n != rep for (_, n), rep in got.items()) > 20


def test_one_block_of_many_names(spark):
    names = spark.range(50_000).select(F.lit(1).alias("story"), F.concat(F.lit("Person"), F.col("id") % 9000, F.lit(" Lee"), F.col("id")).alias("name"))
    names = names.unionByName(spark.createDataFrame([(1, "Lee7"), (1, "Dr Person5"), (1, "Lee")], "story int, name string"))
    got = clustering.coref_groups(names, "story", "name")
    assert got.count() == 50_003
    assert {r.name: r.representative for r in got.where("name in ('Lee7', 'Dr Person5', 'Lee')").collect()} == {"Lee7": "Person7 Lee7", "Dr Person5": "Person5 Lee45005", "Lee": "Lee"}


def test_nodes_are_dealt_by_story_once(spark):
    """No equal nodes are sought where files are read, and counts of a story need no second deal."""
    articles = spark.createDataFrame([(1, 1, "t", 1), (1, 1, "s", 1), (2, 1, None, None)], "story long, article long, title string, source long")
    events = spark.createDataFrame([(1, 5, "attack"), (2, 6, None)], "story long, event long, event_type string")
    entities = spark.createDataFrame([(1, 7, 9, "b", "z"), (1, 8, 9, "a", None), (2, 3, None, None, None)], "story long, entity long, canonical long, value string, canonical_name string")
    sources = spark.createDataFrame([(1, None), (1, "one")], "source long, name string")
    nodes = graph.graph_nodes(articles, events, entities, sources, 3)
    want = {(1, "article:1", "s", "article"), (2, "article:1", "Untitled Article", "article"), (1, "source:1", "one", "source"), (1, "event:5", "attack", "event"), (2, "event:6", "EVENT", "event"), (1, "entity:9", "z", "entity"), (2, "entity:3", None, "entity")}
    got = [tuple(n) for n in nodes.collect()]
    assert set(got) == want and len(got) == len(want)
    counts = nodes.groupBy("story", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    plan = counts._jdf.queryExecution().sparkPlan().toString() + counts._jdf.queryExecution().executedPlan().toString()
    deals = [x for x in plan.split("AdaptiveSparkPlan")[-1].splitlines() if "Exchange hashpartitioning" in x]
    assert sum("story" in x for x in deals) == 1 and nodes.rdd.getNumPartitions() == 3
