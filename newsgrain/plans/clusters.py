"""Queries over vectors and names: similarity, components, clusters, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_line
from ..functions.vector import cosine, jaccard
from ..operators import clustering, greedy, matching, neighbours, scoring, story
from ..storage import cut


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _v(spark, d):
    """Vectors, of which every fourth is drawn towards the one before it, so that there are close pairs."""
    v = _t(spark, d, "embeddings")
    near = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("_o"))
    x = v.join(near, "vec_id", "left")
    mix = F.when((F.col("vec_id") % 4 == 0) & F.col("_o").isNotNull(), F.zip_with("embedding", "_o", lambda a, b: (0.3 * a.cast("double") + 0.7 * b.cast("double")))).otherwise(F.col("embedding").cast("array<double>"))
    return x.select("vec_id", "label", mix.alias("embedding"))


def _next(df, key, a, b, n=5):
    """Pairs of each row with the ``n`` after it in the order of a whole-number key: ``a`` and ``b`` name their columns."""
    left = df.select(*[F.col(c).alias(x) for c, x in a.items()], F.explode(F.sequence(F.col(key) + 1, F.col(key) + n)).alias("_at"))
    right = df.select(F.col(key).alias("_at"), *[F.col(c).alias(x) for c, x in b.items()])
    return left.join(right, "_at").drop("_at")


def sc7(spark, d):
    v = _t(spark, d, "embeddings")
    tags = lambda c: F.array(F.concat(F.lit("e"), c % 4), F.concat(F.lit("f"), c % 6))
    pairs = _next(v, "vec_id", {"vec_id": "a", "embedding": "x", "label": "la"}, {"vec_id": "b", "embedding": "y", "label": "lb"})
    s = scoring.pair_score(cosine(F.col("x"), F.col("y")), tags(F.col("a")), tags(F.col("b")), tags(F.col("la")), tags(F.col("lb")), F.col("la") == F.col("lb"))
    return pairs.select("a", "b", F.round(s, 6).alias("score"))


def sc8(spark, d):
    v = _t(spark, d, "embeddings").withColumn("day", F.floor(F.col("vec_id") / 16))
    return scoring.similar_pairs(v, v, 0.25, block="day").select("a_id", "b_id", F.round("cosine", 6).alias("cosine"))


def sc10(spark, d):
    a = _t(spark, d, "documents").select("doc_id", matching.title_words(F.col("text")).alias("w"))
    e = lambda c: F.array(F.concat(F.lit("x"), c % 3), F.concat(F.lit("y"), c % 5))
    pairs = _next(a, "doc_id", {"doc_id": "a", "w": "wa"}, {"doc_id": "b", "w": "wb"})
    none = F.array().cast("array<string>")
    s, r = scoring.stage_a(F.when(F.col("a") % 7 == 0, none).otherwise(e(F.col("a"))), e(F.col("b")), F.when(F.col("b") % 2 == 0, none).otherwise(F.array(F.concat(F.lit("x"), F.col("b") % 3))), (F.col("a") - F.col("b")) * 1.0, jaccard(F.col("wa"), F.col("wb")))
    return pairs.select("a", "b", F.round(s, 6).alias("score"), r.alias("outcome"))


def sc11(spark, d):
    pairs = _next(_t(spark, d, "embeddings"), "vec_id", {"vec_id": "a", "embedding": "x"}, {"vec_id": "b", "embedding": "y"})
    return pairs.select("a", "b", scoring.stage_b(cosine(F.col("x"), F.col("y")) + 0.4, (F.col("a") + F.col("b")) % 9 - 6).alias("outcome"))


def jn3(spark, d):
    x = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey") % 500).alias("ents"))
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(x.withColumn("ents", F.transform("ents", lambda e: F.concat(F.lit("P"), e))), "o_orderkey", "left")
    o = cut(o.withColumn("ents", F.when(F.col("o_orderkey") % 11 > 0, F.col("ents"))))  # some have no entities
    a = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("article"), F.transform("ents", F.lower).alias("ents"), F.col("o_orderdate").alias("seen"))
    state = F.element_at(F.array(*[F.lit(x) for x in ("emerging", "developing", "archived", "stable", "monitoring")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    s = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("story"), "o_orderdate", "ents", state.alias("state"))
    linked = a.select("article", (F.col("article") - 1).alias("story"))
    return matching.candidates(a, s, linked, "article", "story", "ents", "o_orderdate", 20, "seen", "state")


def jn4(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    x = x.select("doc_id", matching.title_words(F.col("text")).alias("words"), F.array(F.concat(F.lit("s"), F.col("source")), F.concat(F.lit("d"), F.col("doc_id") % 6)).alias("ents"), F.array(F.concat(F.lit("s"), F.col("source")), F.concat(F.lit("c"), F.col("lang"))).alias("places"),
                 F.timestamp_add("HOUR", F.col("doc_id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("t"), "embedding")
    a = x.where("doc_id % 2 = 1").select(F.col("doc_id").alias("article"), F.col("ents").alias("a_entities"), F.col("words").alias("a_words"), F.col("t").alias("a_time"), F.col("embedding").alias("a_vec"))
    s = x.where("doc_id % 2 = 0").select(F.col("doc_id").alias("story"), F.col("ents").alias("s_entities"), F.when(F.col("doc_id") % 4 == 0, F.col("places")).otherwise(F.array().cast("array<string>")).alias("s_locations"), F.col("words").alias("s_words"), F.col("t").alias("s_time"), F.col("embedding").alias("s_vec"))
    none = a.select("article", F.lit(-1).cast("long").alias("story"))
    pairs = matching.candidates(
        a.select("article", "a_time", F.col("a_entities").alias("e")), s.select("story", "s_time", F.col("s_entities").alias("e")), none, "article", "story", "e", "s_time", seen="a_time")
    return matching.match_articles(pairs, a, s, "article", "story", 3, 50.0)


def jn5(spark, d):
    v = _t(spark, d, "embeddings")
    return neighbours.similar(v.where("vec_id % 100 = 0"), v, 5, 0.2).select("query", "found", F.round("cosine", 6).alias("cosine"), "rank")


def agg4(spark, d):
    v = _t(spark, d, "embeddings").withColumn("story", F.floor(F.col("vec_id") / 12))
    return story.cohesion(v, "story", "vec_id", "embedding").select("story", "n", F.round("mean_cosine", 5).alias("mean_cosine"), F.round("least_cosine", 5).alias("least_cosine"))


def agg5(spark, d):
    c = story.centroid(_t(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def clu3(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.explode(F.array(F.concat(F.lit("t"), F.sha2("text", 256)), F.concat(F.lit("h"), F.sha2(first_line(F.col("text")), 256)))).alias("fp"))
    return clustering.group_by_key(x, "fp", "doc_id")


def clu4(spark, d):
    return clustering.cluster_vectors(_v(spark, d), "vec_id", "embedding", 0.9, method="exact")


def clu4_close(spark, d):
    """The distance that batch clustering has by default, by planes that miss one of ten million pairs at that distance."""
    v = _t(spark, d, "embeddings")
    near = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("_o"))
    mix = F.zip_with("embedding", "_o", lambda a, b: 0.2 * a.cast("double") + 0.8 * b.cast("double"))
    x = v.join(near, "vec_id", "left").select("vec_id", F.when((F.col("vec_id") % 3 > 0) & F.col("_o").isNotNull(), mix).otherwise(F.col("embedding").cast("array<double>")).alias("embedding"))
    return clustering.cluster_vectors(x, "vec_id", "embedding", 0.35, method="planes", recall=1 - 1e-7)


def jn5_recall(spark, d):
    """How many pairs at three thresholds there are, by whole vectors, and whether the join by bytes finds each of them."""
    v, at, out = cut(_v(spark, d)), (0.595, 0.72, 0.9), None
    every = neighbours.with_copies(neighbours.nearby(v, "vec_id", "embedding", min(at), method="exact"), v, "vec_id", "embedding")  # all pairs once, whatever the threshold
    every = cut(every.agg(*[F.coalesce(F.sum(F.when(F.col("cosine") >= least, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, least in enumerate(at)]))
    for i, least in enumerate(at):
        found = neighbours.with_copies(neighbours.planes_pairs(v, "vec_id", "embedding", least), v, "vec_id", "embedding").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("found"))
        row = every.crossJoin(found).select(F.lit(least).alias("least"), F.col(f"n{i}").alias("pairs"), (F.col("found") == F.col(f"n{i}")).alias("enough"))
        out = row if out is None else out.unionByName(row)
    return out


def agg36(spark, d):
    return clustering.cluster_quality(clustering.cluster_vectors(_v(spark, d), "vec_id", "embedding", 0.9, method="exact"))


def clu5(spark, d):
    k, near = F.col("vec_id"), F.floor((F.col("vec_id") + 1) / 4)
    tag = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    v = _v(spark, d).withColumns({"day": F.floor(k / 32), "events": F.array(tag("e", near % 3)), "entities": F.array(tag("f", k % 3), tag("g", near % 5)), "source": k % 2})
    m = greedy.micro_clusters(v, "day", ["vec_id"], {"id": "vec_id", "vector": "embedding", "events": "events", "entities": "entities", "source": "source"})
    return m.select(F.col("id").alias("vec_id"), "leader", "part", "event", F.array_join("entities", ",").alias("entities"), F.round(F.element_at("centroid", 1), 6).alias("first"))


_EVENT = {"id": "i", "kind": "kind", "parent": "parent", "actors": "actors", "targets": "targets", "location": "location", "date": "date"}


def _line_events(spark, d):
    e = _t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("i")).agg(*[F.max(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate")])
    tag = lambda p, c: F.concat(F.lit(p), (F.col(c) % 2).cast("string"))
    return e.select("l_orderkey", "i", F.when(F.col("i") != 6, tag("K", "l_suppkey")).alias("kind"), F.lit("P").alias("parent"), F.array("l_returnflag", "l_linestatus").alias("actors"), F.array(tag("t", "l_partkey")).alias("targets"),
                    tag("City ", "l_suppkey").alias("location"), (F.year("l_shipdate") % 2).alias("date"), F.array(tag("x", "l_partkey"), F.lit("y")).alias("entities"))


def clu6(spark, d):
    return greedy.split_clusters(_line_events(spark, d), "l_orderkey", ["i"], _EVENT | {"entities": "entities"}).withColumnRenamed("id", "i")


def clu7(spark, d):
    return greedy.split_story(_line_events(spark, d), "l_orderkey", ["i"], _EVENT).withColumnRenamed("id", "i")


def clu8(spark, d):
    raw = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("article_vector"))
    k = F.col("vec_id")
    tag = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    near = F.floor((k + 1) / 4)
    v = _v(spark, d).join(raw, "vec_id").withColumn("time", F.timestamp_add("MINUTE", (k % 300 * 10).cast("int"), F.lit("2024-01-01").cast("timestamp")))
    v = v.select("vec_id", F.col("embedding").alias("centroid"), "article_vector", (k % 7).alias("size"), "time", F.array(tag("x", near % 5), tag("y", k % 3)).alias("entities"),
                 F.when(k % 3 == 0, F.array(tag("x", near % 5))).otherwise(F.array().cast("array<string>")).alias("locations"), F.array(tag("w", near % 6), tag("v", k % 2)).alias("words"),
                 F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(tag("x", near % 5), tag("y", k % 3))).alias("article_entities"), F.array(tag("w", near % 6), tag("u", k % 2)).alias("article_words"),
                 F.timestamp_add("HOUR", (-(k % 40)).cast("int"), F.col("time")).alias("article_time"))
    now = F.lit("2024-01-03 02:00:00").cast("timestamp")
    found = clustering.find_duplicate_stories(v, "vec_id", "centroid", "size", 0.60, 25, "time", now, 48, clustering.same_event, method="exact")
    return found.select("survivor", "absorbed", F.round("cosine", 6).alias("cosine"))


def clu9(spark, d):
    c = _t(spark, d, "customer").select("c_nationkey", F.concat(F.element_at(F.array(F.lit("Dr "), F.lit(""), F.lit("Ann ")), (F.col("c_custkey") % 3 + 1).cast("int")), F.lit("Lee"), (F.col("c_custkey") % 4).cast("string")).alias("name"))
    return clustering.coref_groups(c, "c_nationkey", "name")


def clu10(spark, d):
    p = _t(spark, d, "part")
    a = p.where("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("alias"), (F.col("p_partkey") - 1).alias("target"))
    return clustering.resolve_aliases(p.select(F.col("p_partkey").alias("id")), a)


_COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"
_MIXED = """v AS (SELECT a.vec_id, CASE WHEN a.vec_id % 4 = 0 AND b.vec_id IS NOT NULL THEN list_transform(list_zip(a.embedding, b.embedding), lambda p: 0.3 * p[1]::DOUBLE + 0.7 * p[2]::DOUBLE) ELSE a.embedding::DOUBLE[] END AS e FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id - 1)"""
_CLUSTER = f"""WITH RECURSIVE {_MIXED}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 1 - 0.9::DOUBLE * 0.9 / 2),
  r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a), c AS (SELECT x AS vec_id, min(y) AS root FROM r GROUP BY x)"""
_LINES = """e AS (SELECT l_orderkey AS o, l_linenumber AS i, CASE WHEN l_linenumber <> 6 THEN max(l_suppkey) % 2 END AS k, [max(l_returnflag), max(l_linestatus)] AS a, max(l_partkey) % 2 AS t, max(l_suppkey) % 2 AS l, year(max(l_shipdate)) % 2 AS d, ['x' || (max(l_partkey) % 2), 'y'] AS n,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem GROUP BY 1, 2)"""
_ROW = "struct_pack(k := k, a := a, t := t, l := l, d := d, n := n)"
_ALIKE = """CASE WHEN x.k IS NULL THEN 0 ELSE 0.25::DOUBLE * len(list_intersect(x.a, e.a)) / len(list_distinct(x.a || e.a)) + CASE WHEN x.t = e.t THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN x.l = e.l THEN 0.20::DOUBLE ELSE 0 END
  + CASE WHEN x.k = e.k THEN 0.15::DOUBLE ELSE 0.075::DOUBLE END + CASE WHEN x.d = e.d THEN 0.10::DOUBLE ELSE 0 END END"""


QUERIES = {
    "sc7_pair_score": (sc7, f"""WITH e AS (SELECT vec_id, embedding, label, ['e' || (vec_id % 4), 'f' || (vec_id % 6)] AS t, ['e' || (label % 4), 'f' || (label % 6)] AS n FROM embeddings)
        SELECT a.vec_id AS a, b.vec_id AS b, round(0.45::DOUBLE * {_COS.format('a.embedding', 'b.embedding')} + 0.25::DOUBLE * len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) + 0.15::DOUBLE * len(list_intersect(a.n, b.n)) / len(list_distinct(a.n || b.n)) + 0.10::DOUBLE * 0.95 + 0.05::DOUBLE * CASE WHEN a.label = b.label THEN 0.8 ELSE 1.0 END, 6) AS score FROM e a JOIN e b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 5"""),
    "sc8_cosine": (sc8, f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.vec_id // 16 = b.vec_id // 16 WHERE {_COS.format('a.embedding', 'b.embedding')} >= 0.25"),
    "sc10_stage_a": (sc10, r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 3) AS w FROM documents),
        u AS (SELECT doc_id, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]) AS w FROM d),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN a.doc_id % 7 = 0 THEN []::VARCHAR[] ELSE ['x' || (a.doc_id % 3), 'y' || (a.doc_id % 5)] END AS ea, ['x' || (b.doc_id % 3), 'y' || (b.doc_id % 5)] AS eb, CASE WHEN b.doc_id % 2 = 0 THEN []::VARCHAR[] ELSE ['x' || (b.doc_id % 3)] END AS l, abs(a.doc_id - b.doc_id) AS h,
           CASE WHEN len(list_distinct(a.w || b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE ELSE 0 END AS j FROM u a JOIN u b ON b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 5),
        s AS (SELECT a, b, round(CASE WHEN len(ea) = 0 THEN 17.5 ELSE 35 * len(list_intersect(ea, eb)) / 2.0 END::DOUBLE + CASE WHEN len(l) = 0 THEN 10 WHEN len(ea) = 0 THEN 0 ELSE 20 * len(list_intersect(ea, l)) END::DOUBLE + CASE WHEN h <= 24 THEN 15 WHEN h <= 72 THEN 7.5 ELSE 0 END::DOUBLE + 20 * j + 10 * (1.0::DOUBLE - 4 * 0.2::DOUBLE), 6) AS score FROM p)
        SELECT a, b, score, CASE WHEN score >= 60 THEN 'PASS' WHEN score >= 45 THEN 'MAYBE' ELSE 'FAIL' END AS outcome FROM s"""),
    "sc11_stage_b": (sc11, f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format('a.embedding', 'b.embedding')} + 0.4 AS c, (a.vec_id + b.vec_id) % 9 - 6 AS s FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 5)
        SELECT a, b, CASE WHEN c >= 0.72 OR s >= 2 THEN 'PASS' WHEN c >= 0.67 OR s >= 1 THEN 'MAYBE' ELSE 'FAIL' END AS outcome FROM p"""),
    "jn3_candidates": (jn3, """WITH e AS (SELECT o_orderkey AS k, o_orderdate AS t, o_custkey % 5 <> 2 AS live, CASE WHEN o_orderkey % 11 > 0 THEN list(DISTINCT 'p' || (l_partkey % 500)) FILTER (l_partkey IS NOT NULL) END AS e FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
        p AS (SELECT a.k AS article, s.k AS story, s.t FROM e a JOIN e s ON a.k % 2 = 1 AND s.k % 2 = 0 AND s.k <> a.k - 1 AND s.live AND s.t <= a.t AND s.t >= a.t - INTERVAL 72 HOUR WHERE s.e IS NULL OR a.e IS NULL OR list_has_any(a.e, s.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY t DESC, story) AS rn FROM p) SELECT article, story FROM r WHERE rn <= 20"""),
    "jn4_match_cascade": (jn4, r"""WITH d AS (SELECT doc_id, embedding, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 3) AS w, ['s' || source, 'd' || (doc_id % 6)] AS e, CASE WHEN doc_id % 4 = 0 THEN ['s' || source, 'c' || lang] ELSE []::VARCHAR[] END AS l FROM documents JOIN embeddings ON doc_id = vec_id),
        u AS (SELECT doc_id, embedding, e, l, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]) AS w FROM d),
        c AS (SELECT a.doc_id AS article, s.doc_id AS story, a.doc_id - s.doc_id AS h, len(list_intersect(a.e, s.e)) AS sh, CASE WHEN len(s.l) = 0 THEN 10 ELSE 20 * len(list_intersect(a.e, s.l)) / 2.0::DOUBLE END AS lo, list_cosine_similarity(a.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS cs, CASE WHEN len(list_distinct(a.w || s.w)) > 0 THEN len(list_intersect(a.w, s.w)) / len(list_distinct(a.w || s.w))::DOUBLE ELSE 0 END AS j,
            row_number() OVER (PARTITION BY a.doc_id ORDER BY s.doc_id DESC) AS rn FROM u a JOIN u s ON a.doc_id % 2 = 1 AND s.doc_id % 2 = 0 AND a.doc_id - s.doc_id BETWEEN 0 AND 72 AND list_has_any(a.e, s.e)),
        s AS (SELECT *, round(35 * sh / 2.0::DOUBLE + lo + CASE WHEN abs(h) <= 24 THEN 15 WHEN abs(h) <= 72 THEN 7.5 ELSE 0 END::DOUBLE + 20 * j + 10 * (1.0::DOUBLE - 4 * 0.2::DOUBLE), 6) AS score FROM c WHERE rn <= 20),
        k AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY score DESC, story) AS rank, CASE WHEN cs >= 0.72 OR sh >= 2 THEN 'PASS' WHEN cs >= 0.67 OR sh >= 1 THEN 'MAYBE' ELSE 'FAIL' END AS b FROM s WHERE score >= 45),
        g AS (SELECT article, arg_min(story, rank) FILTER (b = 'PASS') AS p, arg_min(story, rank) FILTER (b = 'MAYBE' AND score >= 50) AS m FROM k WHERE rank <= 3 GROUP BY 1)
        SELECT u.doc_id AS article, coalesce(p, m) AS story, CASE WHEN p IS NOT NULL THEN 'merge' WHEN m IS NOT NULL THEN 'needs_review' ELSE 'new' END AS decision FROM u LEFT JOIN g ON article = u.doc_id WHERE u.doc_id % 2 = 1"""),
    "jn5_vector_search": (jn5, f"""WITH p AS (SELECT q.vec_id AS query, c.vec_id AS found, {_COS.format('q.embedding', 'c.embedding')} AS x FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY x DESC, found) AS rank FROM p WHERE x >= 0.2)
        SELECT query, found, round(x, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""),
    "agg4_cohesion": (agg4, f"""WITH p AS (SELECT a.vec_id // 12 AS story, {_COS.format('a.embedding', 'b.embedding')} AS c FROM embeddings a JOIN embeddings b ON a.vec_id // 12 = b.vec_id // 12 AND a.vec_id < b.vec_id), n AS (SELECT vec_id // 12 AS story, count(*) AS n FROM embeddings GROUP BY 1)
        SELECT story, n, round(coalesce(avg(c), 1.0), 5) AS mean_cosine, round(coalesce(min(c), 1.0), 5) AS least_cosine FROM n LEFT JOIN p USING (story) GROUP BY 1, 2"""),
    "agg5_centroid": (agg5, """WITH x AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
        SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(x / n, 6) AS x FROM m JOIN n USING (label)"""),
    "agg36_cluster_quality": (agg36, _CLUSTER + ", k AS (SELECT root, count(*) AS n FROM c GROUP BY 1) SELECT count(*) FILTER (n > 1) AS clusters, count(*) FILTER (n = 1) AS outliers, round(coalesce(avg(n) FILTER (n > 1), 0.0), 6) AS mean_size FROM k"),
    "clu3_fingerprint_groups": (clu3, """WITH RECURSIVE f AS (SELECT doc_id, unnest(['t' || text, 'h' || split_part(text, chr(10), 1)]) AS fp FROM documents), l AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.fp = b.fp AND a.doc_id <> b.doc_id),
        r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a) SELECT x AS doc_id, min(y) AS root FROM r GROUP BY x"""),
    "clu4_vector_clusters": (clu4, _CLUSTER + " SELECT vec_id, root FROM c"),
    "clu4_close_vectors": (clu4_close, """WITH RECURSIVE v AS (SELECT a.vec_id, CASE WHEN a.vec_id % 3 > 0 AND b.vec_id IS NOT NULL THEN list_transform(list_zip(a.embedding, b.embedding), lambda p: 0.2 * p[1]::DOUBLE + 0.8 * p[2]::DOUBLE) ELSE a.embedding::DOUBLE[] END AS e FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id - 1),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 1 - 0.35::DOUBLE * 0.35 / 2),
        r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a) SELECT x AS vec_id, min(y) AS root FROM r GROUP BY x"""),
    "jn5_recall": (jn5_recall, f"""WITH {_MIXED}, c AS (SELECT list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id)
        SELECT t.least::DOUBLE AS least, count(*) FILTER (c >= t.least) AS pairs, true AS enough FROM c, (VALUES (0.595::DOUBLE), (0.72::DOUBLE), (0.9::DOUBLE)) AS t(least) GROUP BY 1"""),
    "clu5_micro_clusters": (clu5, f"""WITH RECURSIVE {_MIXED}, a AS (SELECT vec_id // 32 AS day, vec_id, e, (vec_id + 1) // 4 % 3 AS ev, ['f' || (vec_id % 3), 'g' || ((vec_id + 1) // 4 % 5)] AS n, vec_id % 2 AS src, row_number() OVER (PARTITION BY vec_id // 32 ORDER BY vec_id) AS rn FROM v),
        r AS (SELECT day, rn, vec_id, vec_id AS leader, 0 AS part, [struct_pack(id := vec_id, e := e, ev := ev, n := n, src := src)] AS ls FROM a WHERE rn = 1
          UNION ALL SELECT day, rn, vec_id, coalesce(ls[hit].id, vec_id), coalesce(hit - 1, len(ls)), CASE WHEN hit IS NULL THEN list_append(ls, struct_pack(id := vec_id, e := e, ev := ev, n := n, src := src)) ELSE ls END
            FROM (SELECT a.day, a.rn, a.vec_id, a.e, a.ev, a.n, a.src, r.ls, nullif(list_position(list_transform(r.ls, lambda x: round(0.45::DOUBLE * list_cosine_similarity(x.e, a.e) + CASE WHEN x.ev = a.ev THEN 0.25::DOUBLE ELSE 0 END
                + 0.15::DOUBLE * len(list_intersect(x.n, a.n)) / len(list_distinct(x.n || a.n)) + 0.095::DOUBLE + CASE WHEN x.src = a.src THEN 0.04::DOUBLE ELSE 0.05::DOUBLE END, 9) >= 0.7), true), 0) AS hit FROM r JOIN a ON a.day = r.day AND a.rn = r.rn + 1)),
        g AS (SELECT leader, round(avg(e[1]), 6) AS first, list_sort(list_distinct(flatten(list(n))))[1:5] AS names FROM r JOIN a USING (vec_id) GROUP BY leader)
        SELECT r.vec_id, r.leader, CAST(part AS INTEGER) AS part, CASE WHEN r.vec_id = r.leader THEN 'e' || a.ev END AS event, CASE WHEN r.vec_id = r.leader THEN array_to_string(names, ',') END AS entities, CASE WHEN r.vec_id = r.leader THEN g.first END AS first
        FROM r JOIN a USING (vec_id) JOIN g ON g.leader = r.leader"""),
    "clu6_split_clusters": (clu6, f"""WITH RECURSIVE {_LINES},
        r AS (SELECT o, i, rn, [[{_ROW}]] AS ps, 0 AS part, 'auto' AS status FROM e WHERE rn = 1
          UNION ALL SELECT o, i, rn, CASE WHEN best > 0 THEN list_transform(ps, lambda p, j: CASE WHEN j = best THEN list_append(p, {_ROW}) ELSE p END) ELSE list_append(ps, [{_ROW}]) END, CASE WHEN best > 0 THEN best - 1 ELSE len(ps) END,
              CASE WHEN len(list_filter(CASE WHEN best > 0 THEN s[1:best] ELSE s END, lambda m: m >= 0.7 AND m < 0.9)) > 0 THEN 'needs_review' ELSE 'auto' END
            FROM (SELECT *, CASE WHEN k IS NULL THEN 0 ELSE coalesce(list_position(list_transform(s, lambda m: m >= 0.8), true), 0) END AS best FROM (SELECT e.*, r.ps, CASE WHEN e.k IS NULL THEN [] ELSE
              list_transform(r.ps, lambda p: round(list_avg(list_transform(p, lambda x: {_ALIKE} + 0.10::DOUBLE * len(list_intersect(x.n, e.n)) / len(list_distinct(x.n || e.n)))), 9)) END AS s FROM r JOIN e ON e.o = r.o AND e.rn = r.rn + 1)))
        SELECT o AS l_orderkey, i, CAST(part AS INTEGER) AS part, status FROM r"""),
    "clu7_split_story": (clu7, f"""WITH RECURSIVE {_LINES},
        r AS (SELECT o, i, rn, [[{_ROW}]] AS ps, 0 AS part FROM e WHERE rn = 1
          UNION ALL SELECT o, i, rn, CASE WHEN best > 0 THEN list_transform(ps, lambda p, j: CASE WHEN j = best THEN list_append(p, {_ROW}) ELSE p END) ELSE list_append(ps, [{_ROW}]) END, CASE WHEN best > 0 THEN best - 1 ELSE len(ps) END
            FROM (SELECT *, CASE WHEN k IS NULL THEN 0 ELSE coalesce(list_position(list_transform(s, lambda m: m >= 0.8), true), 0) END AS best FROM (SELECT e.*, r.ps, list_transform(r.ps, lambda p: round(list_avg(list_transform(p, lambda x: {_ALIKE})), 9)) AS s FROM r JOIN e ON e.o = r.o AND e.rn = r.rn + 1)))
        SELECT o AS l_orderkey, i, CAST(CASE WHEN max(part) OVER (PARTITION BY o) = 0 AND rn > 1 THEN 1 ELSE part END AS INTEGER) AS part FROM r"""),
    "clu8_duplicate_stories": (clu8, f"""WITH RECURSIVE {_MIXED},
        f AS (SELECT v.vec_id AS k, v.e, embeddings.embedding::DOUBLE[] AS av, TIMESTAMP '2024-01-01' + to_minutes(v.vec_id % 300 * 10) AS t, ['x' || ((v.vec_id + 1) // 4 % 5), 'y' || (v.vec_id % 3)] AS ents,
            CASE WHEN v.vec_id % 3 = 0 THEN ['x' || ((v.vec_id + 1) // 4 % 5)] ELSE [] END AS loc, ['w' || ((v.vec_id + 1) // 4 % 6), 'v' || (v.vec_id % 2)] AS ws, ['w' || ((v.vec_id + 1) // 4 % 6), 'u' || (v.vec_id % 2)] AS aws FROM v JOIN embeddings USING (vec_id)),
        w AS (SELECT *, CASE WHEN k % 5 = 0 THEN [] ELSE ents END AS ae, t - to_hours(k % 40) AS at FROM f WHERE t BETWEEN TIMESTAMP '2024-01-03 02:00:00' - INTERVAL 48 HOUR AND TIMESTAMP '2024-01-03 02:00:00'),
        g AS (SELECT s, x, list_cosine_similarity(s.e, x.e) AS c FROM w s JOIN w x ON s.k % 7 > x.k % 7 OR (s.k % 7 = x.k % 7 AND s.k < x.k)),
        p AS (SELECT s.k AS s, x.k AS x, c, CASE WHEN len(x.ae) = 0 THEN 17.5 ELSE 35 * len(list_intersect(x.ae, s.ents)) / 2.0 END::DOUBLE + CASE WHEN len(s.loc) = 0 THEN 10 WHEN len(x.ae) = 0 THEN 0 ELSE 20 * len(list_intersect(x.ae, s.loc)) END::DOUBLE
            + CASE WHEN abs(epoch(s.t) - epoch(x.at)) <= 86400 THEN 15 WHEN abs(epoch(s.t) - epoch(x.at)) <= 259200 THEN 7.5 ELSE 0 END::DOUBLE + 20.0::DOUBLE * len(list_intersect(x.aws, s.ws)) / len(list_distinct(x.aws || s.ws)) + 2 AS score,
            list_cosine_similarity(x.av, s.e) AS b FROM g WHERE c >= 0.6),
        q AS (SELECT s, x, c, row_number() OVER (ORDER BY c DESC, s, x) AS rn FROM p WHERE score >= 45 AND b >= 0.72),
        r AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS s, 0::BIGINT AS x, 0.0::DOUBLE AS c, false AS ok, []::BIGINT[] AS gone, []::BIGINT[] AS kept
          UNION ALL SELECT rn, s, x, c, ok, CASE WHEN ok THEN list_append(gone, x) ELSE gone END, CASE WHEN ok THEN list_append(kept, s) ELSE kept END
            FROM (SELECT q.rn, q.s, q.x, q.c, r.gone, r.kept, NOT list_contains(r.gone, q.s) AND NOT list_contains(r.gone, q.x) AND NOT list_contains(r.kept, q.x) AS ok FROM r JOIN q ON q.rn = r.rn + 1))
        SELECT s AS survivor, x AS absorbed, round(c, 6) AS cosine FROM r WHERE ok ORDER BY c DESC, s, x LIMIT 25"""),
    "clu9_coref_groups": (clu9, """WITH n AS (SELECT DISTINCT c_nationkey, ['Dr ', '', 'Ann '][c_custkey % 3 + 1] || 'Lee' || (c_custkey % 4) AS name, c_custkey % 4 AS k FROM customer)
        SELECT c_nationkey, name, first_value(name) OVER (PARTITION BY c_nationkey, k ORDER BY length(name) DESC, name DESC) AS representative FROM n"""),
    "clu10_alias_chains": (clu10, "SELECT p_partkey AS id, p_partkey - p_partkey % 8 AS target FROM part"),
}
