"""Queries over documents as articles (title: first line, body: text), pages as crawled pages and benchmark items as golden ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions import classify, text, url
from ..operators import dedup, gates, scoring
from ..sources import records
from ..streaming import streams

NOW = "2024-06-30 12:00:00"
TRUSTED = {"src1": 1.0, "src2": 0.9, "src3": 0.8}
_Q = "e"  # what keyword search looks for is a parameter; this one holds in many texts
TITLE_SQL = "split_part(coalesce(text, ''), chr(10), 1)"
# publication times are not in the table: hours before NOW follow from the id, and every fifth has none
PUB_SQL = f"CASE WHEN doc_id % 5 = 0 THEN NULL ELSE TIMESTAMP '{NOW}' - to_hours(doc_id % 30) END"


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def articles(spark, d):
    now = F.lit(NOW).cast("timestamp_ntz")
    pub = F.when(F.col("doc_id") % 5 != 0, F.timestamp_add("HOUR", -(F.col("doc_id") % 30).cast("int"), now))
    return _read(spark, d, "documents").select("doc_id", "text", "lang", "source", text.first_line(F.col("text")).alias("title"), pub.alias("pub"))


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def flt1(spark, d):
    a = articles(spark, d).withColumn("summary", F.col("text")).withColumn("status", F.when(F.col("doc_id") % 3 == 0, "archived").otherwise("active"))
    return gates.publishable(a, "title", "summary", "status").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def flt4(spark, d):
    return gates.keyword_search(articles(spark, d), "the_%", ["title", "text"], ["doc_id"], 50).select("doc_id")


def flt4b(spark, d):
    return gates.keyword_search(articles(spark, d), "thE", ["title", "text"], ["doc_id"], 50, 10).select("doc_id")


def flt6(spark, d):
    return articles(spark, d).select("doc_id", (~classify.topic_skipped(F.col("title"))).alias("kept")).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


def flt7(spark, d):
    return articles(spark, d).select("doc_id", classify.content_reason(F.col("text")).alias("reason"))


def flt8(spark, d):
    return _read(spark, d, "pages").select("page_id", classify.bot_blocked(F.col("html"), classify.STRONG, classify.WEAK, 2000, 12000).alias("blocked"))


def flt9(spark, d):
    return gates.drop_redirect_hosts(_read(spark, d, "pages"), "url", ["example.org", "m.example.com"]).select("page_id")


def flt13(spark, d):
    a = _read(spark, d, "documents").select("doc_id", F.lower("text").alias("a"), F.lower(F.trim("text")).alias("b"), F.lower(F.regexp_replace("text", "  +", " ")).alias("c"))
    return gates.identical_summaries(a, "a", "b", "c").select("doc_id")


def ded1(spark, d):
    return _read(spark, d, "pages").select("page_id", url.canonicalize_url(F.col("url")).alias("canonical"))


def ded2(spark, d):
    return _read(spark, d, "pages").select("page_id", url.url_key(F.col("url")).alias("url_hash"))


def ded3(spark, d):
    p = _read(spark, d, "pages").withColumn("article_id", F.col("page_id"))
    return dedup.url_gate(p.drop("article_id"), p.where("page_id % 2 = 0")).select("page_id", "url_hash", "status", "known_id")


def ded4(spark, d):
    p = _read(spark, d, "pages").withColumn("k", url.url_key(F.col("url")))
    x = dedup.probe_bloom(p, dedup.build_bloom(p.where("page_id % 2 = 0"), "k"), "k")
    known = x.join(p.where("page_id % 2 = 0").select("k", F.lit(True).alias("known")).distinct(), "k", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    # all known keys are found, and at most one in twenty of the others
    return known.groupBy("known").agg(F.count(F.lit(1)).alias("n"), F.when(F.col("known"), F.bool_and("maybe")).otherwise(F.avg(F.col("maybe").cast("int")) <= 0.05).alias("good"))


def ded5(spark, d):
    a = articles(spark, d)
    return a.select("doc_id", text.content_hash(F.lower(F.trim("title")), F.lower(F.trim("text"))).alias("content_hash"))


def ded6(spark, d):
    a = _read(spark, d, "documents")
    return dedup.link_duplicates(a, F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id").select("doc_id", "duplicate_of")


def ded7(spark, d):
    a = _read(spark, d, "documents").select(F.col("doc_id").alias("url_hash"), F.col("text").alias("body"))
    base = a.where("url_hash % 10 < 8").withColumn("hash", F.sha2("body", 256)).withColumn("version", F.lit(1))
    new = a.where("url_hash % 10 > 4").withColumn("body", F.when(F.col("url_hash") % 3 == 0, F.concat("body", F.lit(" more"))).otherwise(F.col("body"))).withColumn("hash", F.sha2("body", 256))
    return dedup.upsert_articles(base, new).select("url_hash", "hash", "version", "change")


def ded8(spark, d):
    p = _read(spark, d, "pages").withColumn("canonical", url.canonicalize_url(F.substring_index("url", "?", 1)))
    return dedup.first_per(p, ["canonical"], F.desc("page_id")).select("canonical", "page_id")


def ded9(spark, d):
    p = _read(spark, d, "pages").withColumn("k", url.url_key(F.col("url")))
    return gates.known_urls(p.where("page_id % 4 <> 1"), p.where("page_id % 4 < 2"), "k").select("page_id", "known")


def ded10(spark, d):
    a = articles(spark, d)
    return a.select("doc_id", text.normalize_headline(F.concat(F.lit("BREAKING: "), F.col("title"), F.lit(" - Daily Wire"))).alias("norm"))


def ded11(spark, d):
    a = articles(spark, d).withColumn("norm", text.normalize_headline(F.col("title")))
    a = a.withColumn("day", F.lit("2024-06-30").cast("date")).withColumn("link", F.sha2("text", 256))
    return dedup.group_candidates(a, "norm", "day", "link", "source", "title", "doc_id", ["src1", "src2"]).select("candidate_key", "headline", "urls", F.array_join("sources", ",").alias("sources"), "priority")


def ded12(spark, d):
    a = _read(spark, d, "documents").select(F.col("lang").alias("story"), F.lit("summary").alias("kind"), F.col("text").alias("body"), "doc_id")
    return dedup.new_artifacts(a.where("doc_id % 2 = 0"), a.where("doc_id % 2 = 1"), ["story", "kind"], ["body"]).groupBy("story").agg(F.count(F.lit(1)).alias("n"))


def ded14(spark, d):
    a = _read(spark, d, "documents")
    cache = a.join(_read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").select(F.concat(F.lit("m1:"), F.sha2("text", 256)).alias("cache_key"))
    return dedup.embedding_misses(a, cache, "text", "doc_id", "m1")


def ded18(spark, d):
    a = _read(spark, d, "documents").withColumn("fp", F.sha2("text", 256))
    return dedup.fabricated(a, "fp", 2).select("doc_id", "shared_by")


def ded18_links(spark, d):
    a = _read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fp"))
    links = a.where("doc_id % 3 > 0").select("doc_id", F.floor(F.col("doc_id") / 10).alias("story"))
    return dedup.fabricated_links(a, "fp", 2, "doc_id", links, "story")


def ded17_groups(spark, d):
    return dedup.near_duplicate_groups(_read(spark, d, "documents"), "doc_id", "text")


def ded17(spark, d):
    return dedup.near_duplicates(_read(spark, d, "documents"), "doc_id", "text")


def sc1(spark, d):
    a = articles(spark, d)
    s = scoring.discovery_score(F.col("title"), F.col("text"), F.col("pub"), F.col("source"), _now(), TRUSTED)
    return a.select("doc_id", F.round(s, 6).alias("score"))


def sc2(spark, d):
    a = articles(spark, d)
    s = F.round(scoring.metadata_score(F.col("title"), F.col("pub"), F.col("source"), _now(), TRUSTED), 6)
    return a.select("doc_id", s.alias("score"), (s >= scoring.METADATA_THRESHOLD).alias("passed"))


def sc3(spark, d):
    a = articles(spark, d).withColumn("entities", text.proper_nouns(F.col("title")))
    a = a.withColumn("score", F.round(scoring.discovery_score(F.col("title"), F.col("text"), F.col("pub"), F.col("source"), _now(), TRUSTED), 6))
    ok, why = scoring.prioritize(F.col("score"), F.col("entities"))
    return a.select("doc_id", ok.alias("priority"), why.alias("reason"))


def sc4(spark, d):
    return articles(spark, d).select("doc_id", scoring.trust_weight(F.col("source"), TRUSTED).alias("trust"))


def sc5(spark, d):
    return articles(spark, d).select("doc_id", text.proper_nouns(F.col("title")).alias("n"))


def sc6(spark, d):
    return _read(spark, d, "pages").select("page_id", gates.crawl_tier(url.host_of(F.col("url")), ["example.com"], ["example.net"]).alias("tier"))


def sc17(spark, d):
    nodes = _read(spark, d, "benchmark").select((F.col("item_id") % 40).alias("k"), F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"[.,\n]", " "), " +"))).alias("label"))
    docs = _read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("k"), "text")  # a document holds the labels of one class of items
    return scoring.missing_entities(nodes.distinct(), docs, "k", "label", "text").groupBy("k").agg(F.count(F.lit(1)).alias("missing"))


def sc18(spark, d):
    a = _read(spark, d, "documents")
    return a.select("doc_id", text.normalize_fact(F.col("text")).alias("fact"))


def sc24(spark, d):
    a = _read(spark, d, "documents")
    return gates.entities_by_rule(a, "doc_id", "text", ["The"], ["Of And"], ["thth"], ["ndnd"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values"))


def sc25(spark, d):
    a = _read(spark, d, "documents")
    e = gates.entities_by_rule(a, "doc_id", "text", ["The"], ["Of And"], ["thth"], ["ndnd"])
    return gates.normalize_entities(e, "doc_id", ["the"], ["of and"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").cast("decimal(12,2)").cast("double").alias("sure"))


def sc29(spark, d):
    name, sure = classify.cause(F.col("text"), F.when(F.col("doc_id") % 7 == 0, "RateLimitError").when(F.col("doc_id") % 11 == 0, "MemoryError"))
    return _read(spark, d, "documents").select("doc_id", name.alias("cause"), sure.alias("confidence"))


def sc30(spark, d):
    stage = F.when(F.col("doc_id") % 13 == 0, "judge_agent").when(F.col("doc_id") % 17 == 0, "event_extraction").otherwise("other")
    c = classify.failure_class(F.col("text"), F.when(F.col("doc_id") % 5 == 0, "AsyncpgError").when(F.col("doc_id") % 9 == 0, "LLMError"), stage)
    return _read(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.category", "c.subtype", "c.code")


def sc31(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(text.extract_context(F.col("text"), 2000)).alias("context"), (F.length("text") <= 2000).alias("whole"))


def sc32(spark, d):
    a = articles(spark, d)
    return a.select("doc_id", F.md5(text.embedding_text(F.col("title"), F.lit(None).cast("string"), F.col("text"))).alias("h"))


def sc35(spark, d):
    return _read(spark, d, "pages").select("page_id", url.host_of(F.col("url")).alias("host"))


def src4(spark, d):
    return _read(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("n"), F.md5("html").alias("h"))


def src12(spark, d):
    return _read(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


def _feed(spark, d):
    """The pages as entries of a feed, written as XML files and where they lie. Every seventh has no link; dates come in
    four forms and some cannot be read."""
    p = _read(spark, d, "pages")
    at = F.timestamp_add("HOUR", -(F.col("page_id") % 1000).cast("int"), _now())
    pub = F.when(F.col("page_id") % 4 == 0, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(F.col("page_id") % 4 == 1, F.lit("last week"))
    updated = F.when(F.col("page_id") % 4 == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(F.col("page_id") % 8 == 1, F.date_format(at, "yyyy-MM-dd"))
    rows = p.select(F.col("page_id").cast("string").alias("title"), F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("link"), pub.alias("pubDate"), updated.alias("updated"))
    path = f"{storage.new_place(spark)}.xml"
    rows.repartition(3).write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(path)
    return path


def src1(spark, d):
    return records.read_feed(spark, _feed(spark, d)).select(F.col("title").cast("long").alias("page_id"), "canonical")


def src2(spark, d):
    x = records.entry_pub_date(records.read_feed(spark, _feed(spark, d)), _now())
    return x.select(F.col("title").cast("long").alias("page_id"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))


def src5(spark, d):
    b = _read(spark, d, "benchmark")
    article = F.struct(F.lit("t").alias("title"), F.lit("d").alias("description"), F.col("text").alias("content"))
    path = f"{storage.new_place(spark)}.json"
    rows = b.select(F.col("item_id").cast("string").alias("scenario_id"), F.array(article, article).alias("articles"), F.array(F.lit("a"), F.lit("b")).alias("expected_headline_keywords"), F.lit(3).alias("min_key_facts"))
    rows.write.option("maxRecordsPerFile", 1).json(path)
    x = records.read_scenarios(spark, path)
    return x.select(F.col("scenario_id").cast("long").alias("item_id"), F.posexplode("articles").alias("pos", "a"), F.size("expected_headline_keywords").alias("keywords"), "min_key_facts").select("item_id", "pos", F.md5("a.content").alias("h"), "keywords", "min_key_facts")


def str1(spark, d):
    return streams.run(streams.read_feeds(spark, _feed(spark, d)), "append").select(F.col("title").cast("long").alias("page_id"), "canonical")


def src7(spark, d):
    a = articles(spark, d)
    tags = _read(spark, d, "documents").select("doc_id", F.explode(F.array("lang", "source")).alias("tag"))
    return gates.search_docs(a.select("doc_id", "title"), tags, "doc_id", "tag")


def win2(spark, d):
    a = articles(spark, d).withColumn("score", F.length("text").cast("long"))
    return gates.diverse_topk(a, "source", ["score"], "doc_id", 10).select("doc_id", "source", "score")


def win3(spark, d):
    seeds = _read(spark, d, "benchmark").select("item_id", F.col("text").alias("seed"))
    return gates.rank_results(articles(spark, d).select("doc_id", "title", "text"), seeds, 10)


def win1(spark, d):
    p = _read(spark, d, "pages").withColumn("host", url.host_of(F.col("url"))).withColumn("tier", gates.crawl_tier(F.col("host"), ["example.com"], ["example.net"]))
    return gates.crawl_order(p, "tier", "host", "page_id").select("page_id", "tier", "turn", "place")


def clu11(spark, d):
    p = _read(spark, d, "pages").withColumn("host", url.host_of(F.col("url")))
    return gates.inject_seeds(p.where("page_id % 2 = 0").select("page_id", "host"), p.where("page_id % 2 = 1").select("page_id", "host"), "host")


def src9(spark, d):
    a = articles(spark, d).where(F.col("pub").isNotNull())
    return gates.news_sitemap(a, "doc_id", "title", "pub", _now(), 100).select("doc_id", "title")


def agg35(spark, d):
    out = _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("category"), F.array(F.lower(text.first_line(F.col("text"))), F.lower("source"), F.lower("lang")).alias("keywords"))
    want = out.select("doc_id", "keywords", F.lit(1).alias("want"), F.array(F.lit("idiot"), F.lit("trash")).alias("forbidden"))
    return gates.evaluate(out.drop("keywords"), want, "doc_id")


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_CANON = r"""(SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) ||
   CASE WHEN length(p) > 1 AND p[-1] = '/' THEN p[:-2] ELSE p END ||
   CASE WHEN len(qs) > 0 THEN '?' || array_to_string(list_sort(qs), '&') ELSE '' END AS canonical
  FROM (SELECT page_id, url, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p,
     list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: contains(x, '=') AND split_part(x, '=', 2) <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','referrer','gclid','fbclid'], lower(split_part(x, '=', 1)))) AS qs FROM pages))"""
_KEY = "sha256(regexp_replace(lower(trim(url)), '/+$', ''))"
_ANY = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"
_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^(breaking|live|exclusive|update|watch|live updates|just in)\s*:\s*', ''), '\s+[-|—–]\s+[^-|—–]+$', ''), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"""
_WORDS = f"list_transform(regexp_split_to_array(trim({TITLE_SQL}), '\\s+'), lambda w: regexp_replace(w, '[:,.\\-!\"'']+$', ''))"
_NOUNS = f"""CAST(len(list_filter({_WORDS}[2:], lambda w: regexp_matches(w, '^\\p{{Lu}}'))) + (CASE WHEN regexp_matches({_WORDS}[1], '^\\p{{Lu}}') AND lower({_WORDS}[1]) NOT IN
   ({', '.join(f"'{w}'" for w in text.STOP_FIRST_WORDS)}) THEN 1 ELSE 0 END) AS INTEGER)"""
_TRUST = "CASE " + " ".join(f"WHEN contains(lower(trim(source)), '{k}') THEN {v}" for k, v in TRUSTED.items()) + " ELSE 0.0 END"
_HOURS = f"(date_diff('second', {PUB_SQL}, TIMESTAMP '{NOW}') / 3600.0)"
_FRESH = f"(CASE WHEN {PUB_SQL} IS NULL THEN 0.25 ELSE greatest(0.0, 1.0 - {_HOURS} / 24.0) END)"
_SKIP = _ANY(f"lower({TITLE_SQL})", classify.SKIPPED_TOPICS)
_DISC = f"""round(CASE WHEN {TITLE_SQL} = '' THEN 0.0 WHEN {_SKIP} OR coalesce({_HOURS}, 0) > 24 OR length(coalesce(text, '')) < 300 THEN -1.0
  ELSE CAST(0.20 AS DOUBLE) * {_FRESH} + CAST(0.30 AS DOUBLE) * ({_TRUST}) + CAST(0.30 AS DOUBLE) * least(1.0, {_NOUNS} / 4.0) + CAST(0.20 AS DOUBLE) * least(1.0, (length(text) - 300) / 700.0) END, 6)"""
_META = f"""round(CASE WHEN {TITLE_SQL} = '' THEN 0.0 WHEN {_SKIP} OR coalesce({_HOURS}, 0) > 24 THEN -1.0
  ELSE CAST(1.25 AS DOUBLE) * (CAST(0.20 AS DOUBLE) * {_FRESH} + CAST(0.30 AS DOUBLE) * ({_TRUST}) + CAST(0.30 AS DOUBLE) * least(1.0, {_NOUNS} / 4.0)) END, 6)"""
_BODY = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
_CAUSE = "CASE " + " ".join("WHEN " + _ANY("m", w) + (" OR " + _ANY("k", t) if t else "") + f" THEN '{c}'" for c, _, w, t in classify.CAUSES) + f" ELSE '{classify.DEFAULT_CAUSE[0]}' END"
_SURE = "CASE cause " + " ".join(f"WHEN '{c}' THEN {s}" for c, s, _, _ in classify.CAUSES) + f" ELSE {classify.DEFAULT_CAUSE[1]} END"
_ENT = r"""e AS (SELECT doc_id, v, len(string_split_regex(v, '\s+')) AS w FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]', '_', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'))) AS v FROM documents) WHERE length(v) >= 3),
  k AS (SELECT doc_id, v, CASE WHEN lower(v) = 'the' THEN 'STATE' WHEN lower(v) = 'of and' THEN 'AGREEMENT' WHEN contains(lower(v), 'thth') THEN 'ORG' WHEN contains(lower(v), 'ndnd') THEN 'POLITICAL_PARTY' WHEN w >= 3 THEN 'ORG' WHEN w = 2 THEN 'PERSON' END AS kind,
     CASE WHEN lower(v) = 'the' THEN 0.7 WHEN lower(v) = 'of and' OR contains(lower(v), 'thth') THEN 0.6 WHEN contains(lower(v), 'ndnd') THEN 0.5 ELSE 0.3 END AS confidence FROM e)"""


def _class_sql():
    def rules(pairs, category):
        out = []
        for words, (a, b) in pairs:
            hit = "(stage = 'event_extraction' AND " + _ANY("m", ("extraction", "event")) + ")" if words is None else _ANY("m", words)
            out.append(f"WHEN {hit} THEN '{category}/{a}/{b}'")
        return " ".join(out)

    agents = " ".join(f"WHEN stage IN ({', '.join(repr(x) for x in s)}) THEN '{c}/{a}/{b}'" for s, (c, a, b) in classify.AGENT_STAGES)
    model = f"CASE {rules(classify.MODEL_RULES, 'llm_error')} ELSE 'llm_error/UNKNOWN_LLM_ERROR/UNKNOWN_PROVIDER_ERROR' END"
    first, *rest = classify.SYSTEM_RULES
    system = f"WHEN {_ANY('k', ('sqlalchemy', 'asyncpg', 'psycopg'))} THEN 'system_error/{first[1][0]}/{first[1][1]}' {rules(classify.SYSTEM_RULES, 'system_error')}"
    c = f"CASE {agents} WHEN {_ANY('m', classify.MODEL_WORDS)} OR {_ANY('k', ('llm', 'openai'))} THEN {model} {rules(classify.DATA_RULES, 'data_error')} {system} ELSE 'system_error/SYSTEM_ERROR/UNKNOWN_SYSTEM_ERROR' END"
    return f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS m, lower(CASE WHEN doc_id % 5 = 0 THEN 'AsyncpgError' WHEN doc_id % 9 = 0 THEN 'LLMError' ELSE '' END) AS k,
       CASE WHEN doc_id % 13 = 0 THEN 'judge_agent' WHEN doc_id % 17 = 0 THEN 'event_extraction' ELSE 'other' END AS stage FROM documents),
     y AS (SELECT doc_id, {c} AS c FROM x)
     SELECT doc_id, split_part(c, '/', 1) AS category, split_part(c, '/', 2) AS subtype, split_part(c, '/', 3) AS code FROM y"""


QUERIES = {
    "src1_feed": (src1, f"SELECT page_id, canonical FROM {_CANON} WHERE page_id % 7 <> 0"),
    "src2_pub_date": (src2, f"""SELECT page_id, CASE WHEN page_id % 4 IN (0, 2) THEN TIMESTAMP '{NOW}' - to_hours(page_id % 1000) WHEN page_id % 8 = 1 THEN CAST(CAST(TIMESTAMP '{NOW}' - to_hours(page_id % 1000) AS DATE) AS TIMESTAMP) ELSE TIMESTAMP '{NOW}' END AS published_at FROM pages WHERE page_id % 7 <> 0"""),
    "src5_scenarios": (src5, "SELECT item_id, CAST(unnest([0, 1]) AS INTEGER) AS pos, md5(text) AS h, CAST(2 AS INTEGER) AS keywords, CAST(3 AS INTEGER) AS min_key_facts FROM benchmark"),
    "str1_feed_stream": (str1, f"SELECT page_id, canonical FROM {_CANON} WHERE page_id % 7 <> 0"),
    "src4_pages": (src4, "SELECT page_id, length(html) AS n, md5(html) AS h FROM pages"),
    "src7_search_docs": (src7, f"SELECT doc_id, '{{\"doc_id\":' || doc_id || ',\"title\":' || CAST(to_json({TITLE_SQL}) AS VARCHAR) || ',\"tags\":[\"' || least(lang, source) || '\",\"' || greatest(lang, source) || '\"]}}' AS document FROM documents"),
    "src9_news_sitemap": (src9, f"SELECT doc_id, {TITLE_SQL} AS title FROM documents WHERE doc_id % 5 <> 0 AND {PUB_SQL} >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR ORDER BY {PUB_SQL} DESC, doc_id LIMIT 100"),
    "src12_html_text": (src12, None),
    "flt1_publishable": (flt1, f"""SELECT source, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents
        WHERE doc_id % 3 <> 0 AND {TITLE_SQL} <> '' AND NOT starts_with({TITLE_SQL}, '[Mock]') AND text <> '' GROUP BY source"""),
    "flt4_keyword_literal": (flt4, f"SELECT doc_id FROM documents WHERE contains(lower({TITLE_SQL}), 'the_%') OR contains(lower(text), 'the_%') ORDER BY doc_id LIMIT 50"),
    "flt4_keyword_page": (flt4b, f"SELECT doc_id FROM documents WHERE contains(lower({TITLE_SQL}), 'the') OR contains(lower(text), 'the') ORDER BY doc_id LIMIT 50 OFFSET 10"),
    "flt6_topic_gate": (flt6, f"SELECT NOT {_SKIP} AS kept, count(*) AS n FROM documents GROUP BY 1"),
    "flt7_content_quality": (flt7, rf"""WITH b AS (SELECT doc_id, {_BODY} AS body FROM documents)
        SELECT doc_id, CASE WHEN body = '' THEN 'empty' WHEN length(body) < 400 THEN 'too_short'
          WHEN {_ANY("substr(lower(body), 1, 1500)", classify.WALL_PHRASES)} OR {' + '.join(f"CAST(contains(lower(body), '{w}') AS INTEGER)" for w in classify.WALL_PHRASES)} >= 2 THEN 'boilerplate_wall'
          WHEN (len(regexp_extract_all(body, '(?i)\]\(\s*(?:https?:|blob:|javascript:)')) + len(regexp_extract_all(body, 'https?://\S+'))) / (length(body) / 1000.0) > 12.0 THEN 'link_farm'
          WHEN len(regexp_extract_all(body, '[.!?][\s"'')\]]')) / (length(body) / 1000.0) < 1.5 THEN 'not_prose' ELSE 'ok' END AS reason FROM b"""),
    "flt8_bot_wall": (flt8, rf"""WITH b AS (SELECT page_id, regexp_replace(html, '^\s+|\s+$', '', 'g') AS p, lower(regexp_replace(html, '(?is)<noscript.*?</noscript>', ' ', 'g')) AS l FROM pages)
        SELECT page_id, length(p) < 2000 OR {_ANY('l', classify.STRONG)} OR (length(p) <= 12000 AND {_ANY('l', classify.WEAK)}) AS blocked FROM b"""),
    "flt9_redirect_hosts": (flt9, f"SELECT page_id FROM pages WHERE NOT ({_HOST} = 'example.org' OR ends_with({_HOST}, '.example.org') OR {_HOST} = 'm.example.com' OR ends_with({_HOST}, '.m.example.com'))"),
    "flt13_identical": (flt13, "SELECT doc_id FROM documents WHERE lower(text) = lower(trim(text)) AND lower(text) = lower(regexp_replace(text, '  +', ' ', 'g'))"),
    "ded1_canonical_url": (ded1, f"SELECT * FROM {_CANON}"),
    "ded2_url_key": (ded2, f"SELECT page_id, {_KEY} AS url_hash FROM pages"),
    "ded3_url_gate": (ded3, f"""WITH k AS (SELECT {_KEY} AS url_hash, min(page_id) AS known_id FROM pages WHERE page_id % 2 = 0 GROUP BY 1)
        SELECT p.page_id, {_KEY} AS url_hash, CASE WHEN known_id IS NULL THEN 'NEW_URL' ELSE 'FOUND_IN_DATABASE' END AS status, known_id
        FROM pages p LEFT JOIN k ON k.url_hash = {_KEY}"""),
    "ded4_bloom": (ded4, f"SELECT {_KEY} IN (SELECT {_KEY} FROM pages WHERE page_id % 2 = 0) AS known, count(*) AS n, true AS good FROM pages GROUP BY 1"),
    "ded5_content_hash": (ded5, f"SELECT doc_id, sha256(lower(trim({TITLE_SQL})) || chr(10) || chr(10) || lower(trim(coalesce(text, '')))) AS content_hash FROM documents WHERE true"),
    "ded6_duplicate_links": (ded6, "SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY coalesce(text, '')), doc_id) AS duplicate_of FROM documents"),
    "ded7_recrawl": (ded7, """WITH b AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 10 < 8), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE text END) AS hash FROM documents WHERE doc_id % 10 > 4)
        SELECT coalesce(b.doc_id, n.doc_id) AS url_hash, coalesce(n.hash, b.hash) AS hash, CAST(CASE WHEN b.doc_id IS NOT NULL AND n.hash <> b.hash THEN 2 ELSE 1 END AS INTEGER) AS version,
          CASE WHEN b.doc_id IS NULL THEN 'insert' WHEN n.hash <> b.hash THEN 'update' ELSE 'keep' END AS change FROM b FULL JOIN n ON b.doc_id = n.doc_id"""),
    "ded8_feed_dedup": (ded8, f"SELECT canonical, max(page_id) AS page_id FROM {_CANON.replace('FROM pages)', 'FROM (SELECT page_id, split_part(url, chr(63), 1) AS url FROM pages))')} GROUP BY 1"),
    "ded9_known_urls": (ded9, f"SELECT page_id, {_KEY} IN (SELECT {_KEY} FROM pages WHERE page_id % 4 < 2) AS known FROM pages WHERE page_id % 4 <> 1"),
    "ded10_headline": (ded10, f"SELECT doc_id, {_NORM.format(chr(39) + 'BREAKING: ' + chr(39) + ' || ' + TITLE_SQL + ' || ' + chr(39) + ' - Daily Wire' + chr(39))} AS norm FROM documents"),
    "ded11_candidates": (ded11, f"""WITH a AS (SELECT doc_id, source, {TITLE_SQL} AS title, {_NORM.format(TITLE_SQL)} AS norm, sha256(text) AS link FROM documents)
        SELECT sha256(norm || ':2024-06-30') AS candidate_key, min_by(title, doc_id) AS headline, count(DISTINCT link) AS urls, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
          CAST(max(CASE WHEN source IN ('src1', 'src2') THEN 90 ELSE 50 END) AS INTEGER) AS priority FROM a WHERE length(norm) >= 10 GROUP BY norm"""),
    "ded12_artifacts": (ded12, """SELECT lang AS story, count(DISTINCT text) AS n FROM documents WHERE doc_id % 2 = 1 AND (lang, text) NOT IN
        (SELECT (lang, text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1"""),
    "ded14_embedding_misses": (ded14, """SELECT 'm1:' || sha256(coalesce(text, '')) AS cache_key, count(*) AS n_rows, bool_or(trim(coalesce(text, '')) = '') AS zero FROM documents
        WHERE coalesce(text, '') NOT IN (SELECT text FROM documents JOIN embeddings ON doc_id = vec_id) GROUP BY 1"""),
    "ded17_near_duplicates": (ded17, None),
    "ded17_groups": (ded17_groups, r"""WITH RECURSIVE w AS (SELECT min(doc_id) AS id, string_split_regex(lower(trim(text)), '\s+') AS ws FROM documents GROUP BY text),
        g AS (SELECT id, unnest(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS v FROM w),
        n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.v = b.v AND a.id < b.id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(x, y) AS (SELECT id, id FROM w UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), m AS (SELECT x, min(y) AS root FROM r GROUP BY x), f AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY 1)
        SELECT d.doc_id, m.root FROM documents d JOIN f ON f.text = d.text JOIN m ON m.x = f.id"""),
    "ded18_linked_rows": (ded18_links, "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id // 10 END AS story FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 2"),
    "ded18_fabricated": (ded18, "SELECT doc_id, n AS shared_by FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 2"),
    "sc1_discovery": (sc1, f"SELECT doc_id, {_DISC} AS score FROM documents"),
    "sc2_metadata": (sc2, f"SELECT doc_id, {_META} AS score, {_META} >= 0.25 AS passed FROM documents"),
    "sc3_prioritize": (sc3, f"""WITH s AS (SELECT doc_id, {_DISC} AS score, {_NOUNS} AS n FROM documents)
        SELECT doc_id, score >= 0.5 AS priority, CASE WHEN score < 0 THEN 'rejected' WHEN score >= 0.5 THEN '' WHEN n < 2 THEN 'low_entity_count' ELSE 'low_discovery_score_' || CAST(floor(score * 100) AS BIGINT) END AS reason FROM s"""),
    "sc4_trust": (sc4, f"SELECT doc_id, CAST({_TRUST} AS DOUBLE) AS trust FROM documents"),
    "sc5_proper_nouns": (sc5, f"SELECT doc_id, {_NOUNS} AS n FROM documents"),
    "sc6_tier": (sc6, f"SELECT page_id, CASE WHEN {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') THEN 1 WHEN {_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net') THEN 2 ELSE 3 END AS tier FROM pages"),
    "sc17_missing_entities": (sc17, r"""WITH n AS (SELECT DISTINCT item_id % 40 AS k, unnest(string_split_regex(regexp_replace(text, '[.,\n]', ' ', 'g'), ' +')) AS label FROM benchmark)
        SELECT k, count(*) AS missing FROM n JOIN documents ON doc_id % 40 = k WHERE length(label) > 2 AND NOT contains(lower(text), lower(label)) GROUP BY k"""),
    "sc18_fact": (sc18, rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(replace(lower(text), 'ß', 'ss')), '^(the|a|an)\s+', ''), '[.''’]', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS fact FROM documents"""),
    "sc24_rule_entities": (sc24, f"WITH {_ENT} SELECT kind, count(*) AS n, count(DISTINCT v) AS values FROM k WHERE kind IS NOT NULL GROUP BY kind"),
    "sc25_clean_entities": (sc25, f"""WITH {_ENT}, c AS (SELECT doc_id, lower(trim(v)) AS l, min_by(confidence, v) AS confidence FROM k WHERE kind IS NOT NULL AND length(trim(v)) >= 2 GROUP BY 1, 2)
        SELECT doc_id, count(*) AS n, CAST(sum(CAST(confidence AS DECIMAL(12,2))) AS DOUBLE) AS sure FROM c GROUP BY 1"""),
    "sc29_cause": (sc29, f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS m, CASE WHEN doc_id % 7 = 0 THEN 'ratelimiterror' WHEN doc_id % 11 = 0 THEN 'memoryerror' ELSE '' END AS k FROM documents),
        y AS (SELECT doc_id, CASE WHEN m <> '' OR k <> '' THEN {_CAUSE} END AS cause FROM x) SELECT doc_id, cause, CAST({_SURE} AS DOUBLE) AS confidence FROM y"""),
    "sc30_failure_class": (sc30, _class_sql()),
    "sc31_context": (sc31, """WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
        m AS (SELECT *, ps[2:len(ps) - 1] AS mid, 2000 - 5 - 6 - length(ps[1]) - length(ps[-1]) AS room FROM p),
        k AS (SELECT *, len(list_filter(range(1, len(mid) + 1), lambda i: list_sum(list_transform(mid[1:i], lambda x: length(x) + 2)) <= room)) AS kept FROM m)
        SELECT doc_id, md5(CASE WHEN length(text) <= 2000 THEN text WHEN len(ps) < 2 OR room < 0 THEN substr(text, 1, 2000)
            ELSE array_to_string([ps[1]] || mid[1:kept] || CASE WHEN kept < len(mid) THEN ['[...]'] ELSE []::VARCHAR[] END || [ps[-1]], chr(10) || chr(10)) END) AS context, length(text) <= 2000 AS whole FROM k"""),
    "sc32_embedding_text": (sc32, f"SELECT doc_id, md5(replace({TITLE_SQL} || ' ' || substr(text, 1, 4000), chr(10), ' ')) AS h FROM documents"),
    "sc35_host": (sc35, f"SELECT page_id, {_HOST} AS host FROM pages"),
    "win1_crawl_order": (win1, f"""WITH p AS (SELECT page_id, {_HOST} AS host FROM pages), t AS (SELECT *, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 1 WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 2 ELSE 3 END AS tier FROM p)
        SELECT page_id, tier, CAST(row_number() OVER (PARTITION BY tier, host ORDER BY page_id) AS INTEGER) AS turn, min(page_id) OVER (PARTITION BY tier, host) AS place FROM t"""),
    "win2_diverse_topk": (win2, """WITH r AS (SELECT doc_id, source, length(text) AS score, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents)
        SELECT doc_id, source, score FROM r WHERE rn = 1 ORDER BY score DESC, doc_id LIMIT 10"""),
    "win3_rank_results": (win3, None),
    "clu11_inject_seeds": (clu11, f"""WITH p AS (SELECT page_id, {_HOST} AS host FROM pages), f AS (SELECT * FROM p WHERE page_id % 2 = 0), s AS (SELECT * FROM p WHERE page_id % 2 = 1)
        SELECT page_id, host, false AS seed FROM f UNION ALL SELECT page_id, host, true FROM s WHERE host NOT IN (SELECT host FROM f)"""),
    "agg35_evaluation": (agg35, """WITH o AS (SELECT doc_id, lower(text) AS t, quality, [lower(split_part(text, chr(10), 1)), lower(source), lower(lang)] AS k FROM documents JOIN labels USING (doc_id)),
        s AS (SELECT doc_id, 100.0 * len(list_filter(k, lambda w: contains(t, w))) / len(k) AS kw, CASE WHEN quality = 1 THEN 100.0 ELSE 0.0 END AS cat, CAST(contains(t, 'idiot') AS INTEGER) + CAST(contains(t, 'trash') AS INTEGER) AS bad FROM o),
        z AS (SELECT greatest(0.0, (kw + cat) / 2 - 20 * bad) AS score FROM s)
        SELECT count(*) AS n, count(*) FILTER (score >= 80) AS passed, round(avg(score), 6) AS mean_score FROM z"""),
}
