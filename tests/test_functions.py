"""Unit values of expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsgrain.functions import classify, text, url, vector
from newsgrain.operators import compare, scoring


def one(spark, col, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", dt.datetime: "timestamp_ntz", dt.date: "date"}
    kind = lambda v: f"array<{kinds[type(v[0])] if v else 'string'}>" if isinstance(v, list) else kinds.get(type(v), "string")
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {kind(v)}" for k, v in values.items()) or "x int")
    return df.select(col.alias("r")).first().r


@pytest.mark.parametrize("raw, want", [
    ("The  Colombian   Government.", "colombian government"), ("U.S.", "us"), ("US", "us"), ("O’Neil's Bar-Café!", "oneils bar café"), ("", ""), (None, ""), ("An apple", "apple"),
])
def test_normalize_fact(spark, raw, want):
    assert one(spark, text.normalize_fact(F.col("x")), x=raw) == want


@pytest.mark.parametrize("a, b, same", [
    ("Western Colombia", "Colombia", True), ("Red Fort, Delhi, India", "Red Fort, New Delhi, India", True), ("US", "USA Today", False), ("15 dead people", "50 dead people", False), ("", "x", False), ("U.S.", "US", True),
])
def test_facts_equivalent(spark, a, b, same):
    assert one(spark, text.facts_equivalent(F.col("a"), F.col("b")), a=a, b=b) is same


@pytest.mark.parametrize("a, b, tier", [
    ("The U.S.", "us", "equal"), ("Western Colombia", "Colombia", "contained"), ("Red Fort, Delhi, India", "Red Fort, New Delhi, India", "subset"), ("dimaagi naxals", "dimagi naxals", "spelling"),
    ("15 dead people", "50 dead people", None), ("dimaagi naxals 1", "dimagi naxals 1", None), ("US", "USA Today", None), ("", "", None), (None, "x", None), ("abcdefghij", "klmnopqrst", None),
])
def test_fact_tiers(spark, a, b, tier):
    df = spark.createDataFrame([(a, b, 1)], "a string, b string, _k int")
    (row,) = text.match_facts(df, "a", "b").collect()
    assert row.tier == tier and row._k == 1


def test_spelling(spark):
    assert one(spark, text.spelling_ratio(F.col("a"), F.col("b")), a="dimaagi naxals", b="dimagi naxals") >= 0.9
    assert one(spark, text.token_set_ratio(F.col("a"), F.col("b")), a="new york mets", b="mets new york") == 100.0


@pytest.mark.parametrize("raw, want", [
    ("BREAKING: Storm hits coast - Reuters", "storm hits coast"), ("Live Updates: Vote | CNN", "vote"), ("A – B — C", "a b"), (None, ""), ("Ünïted “Quote”", "ünïted quote"),
])
def test_headline(spark, raw, want):
    assert one(spark, text.normalize_headline(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("HTTPS://WWW.Example.COM/a/?b=2&utm_source=x&a=1#f", "https://www.example.com/a?a=1&b=2"), ("http://x.com/", "http://x.com/"), ("http://x.com/p%20q?z=&y=a+b", "http://x.com/p q?y=a+b"), ("", ""), (None, ""), ("http://x.com?ref=1", "http://x.com"),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, url.canonicalize_url(F.col("x")), x=raw) == want


def test_nfkc_and_slug(spark):
    assert one(spark, text.nfkc(F.col("x")), x="ﬁne Ａ") == "fine A"
    assert one(spark, text.display_slug(F.col("x"), 2024), x="  Hello, World! " + "x" * 60) == ("hello-world-" + "x" * 38) + "-2024"


@pytest.mark.parametrize("body, reason", [
    (None, "empty"), ("  \n ", "empty"), ("Short.", "too_short"), ("We and our partners store things. " * 20, "boilerplate_wall"), ("[a](https://x.y/z) " * 40, "link_farm"), ("menu item " * 60, "not_prose"), ("This is a sentence of an article. " * 20, "ok"),
])
def test_content(spark, body, reason):
    assert one(spark, classify.content_reason(F.col("x")), x=body) == reason


def test_causes(spark):
    name, sure = classify.cause(F.col("m"), F.col("k"))
    assert one(spark, name, m="HTTP 429 Too Many Requests", k=None) == "LLM_RATE_LIMIT"
    assert one(spark, sure, m="odd", k=None) == 0.5
    assert one(spark, name, m=None, k=None) is None
    c = classify.failure_class(F.col("m"), F.col("k"), F.col("s"))
    assert tuple(one(spark, c, m="connection reset", k="", s="crawl")) == ("system_error", "NETWORK_ISSUE", "NETWORK_ISSUE")
    assert tuple(one(spark, c, m="gemini timed out", k="", s="")) == ("llm_error", "TIMEOUT", "LLM_TIMEOUT")
    assert tuple(one(spark, c, m="x", k="", s="judge_agent"))[1] == "JUDGE_AGENT_FAILURE"


def test_context(spark):
    paragraphs = [f"{i} " + "word " * 30 for i in range(60)]
    got = one(spark, text.extract_context(F.col("x"), 1000), x="\n\n".join(paragraphs))
    assert len(got) <= 1000 and got.startswith("0 word") and got.rstrip().endswith(paragraphs[-1].strip()) and "[...]" in got
    assert one(spark, text.extract_context(F.col("x"), 1000), x="short") == "short"
    assert len(one(spark, text.extract_context(F.col("x"), 1000), x="y" * 5000)) == 1000


@pytest.mark.parametrize("a, b, want", [
    (dict(kind="X", parent="P", actors=["a"], targets=["t"], location="Delhi", date=dt.date(2024, 1, 1)), dict(kind="X", parent="P", actors=["a"], targets=["t"], location="delhi ", date=dt.date(2024, 1, 1)), 0.90),
    (dict(kind="X", parent="P", actors=[], targets=[], location="", date=None), dict(kind="Y", parent="Q", actors=[], targets=[], location="", date=None), 0.15),
])
def test_event_similarity(spark, a, b, want):
    side = "struct<kind:string,parent:string,actors:array<string>,targets:array<string>,location:string,date:date>"
    row = spark.createDataFrame([(tuple(a.values()), tuple(b.values()))], f"a {side}, b {side}")
    keys = list(a)
    got = row.select(scoring.event_similarity({k: F.col(f"a.{k}") for k in keys}, {k: F.col(f"b.{k}") for k in keys})).first()[0]
    assert abs(got - want) < 1e-9


def test_vectors(spark):
    assert one(spark, vector.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0
    assert abs(one(spark, vector.cosine(F.col("a"), F.col("b")), a=[1.0, 1.0], b=[2.0, 2.0]) - 1) < 1e-12
    assert one(spark, vector.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == 1 / 3


@pytest.mark.parametrize("a, b, person, org", [
    ("Donald Trump", "Trump", True, False), ("President Trump", "Trump", True, False), ("Lalit Modi", "Narendra Modi", False, False), ("Acme Corp", "Acme", True, True), ("World Health Organization", "WHO", False, True), ("Bank of America", "BA", False, True), ("Acme Bank", "Acme Group", False, False),
])
def test_names(spark, a, b, person, org):
    assert one(spark, compare.same_person(F.col("a"), F.col("b")), a=a, b=b) is person
    assert one(spark, compare.same_organisation(F.col("a"), F.col("b")), a=a, b=b) is org


@pytest.mark.parametrize("state, articles, conf, sources, contra, idle, want", [
    ("emerging", 2, 0.0, 1, 0.0, 1.0, "emerging"), ("emerging", 3, 0.0, 1, 0.0, 1.0, "developing"), ("developing", 9, 0.8, 3, 0.2, 6.0, "monitoring"), ("developing", 9, 0.79, 3, 0.2, 6.0, "developing"),
    ("monitoring", 9, 0.95, 5, 0.1, 24.0, "stable"), ("stable", 9, 1.0, 9, 0.0, 168.0, "archived"), ("archived", 9, 1.0, 9, 0.0, 0.0, "archived"),
])
def test_lifecycle(spark, state, articles, conf, sources, contra, idle, want):
    c = scoring.lifecycle(F.col("s"), F.col("a"), F.col("c"), F.col("n"), F.col("x"), F.col("i"), F.col("i"))
    assert one(spark, c, s=state, a=articles, c=conf, n=sources, x=contra, i=idle) == want
