"""Components, vector clusters, greedy groups and aliases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, jaccard
from ..storage import cut
from .neighbours import near_links, nearby
from .scoring import stage_a, stage_b


def _are_stars(e: DataFrame) -> bool:
    """Whether every node of the different links (u, v) has one v, which itself has none."""
    ends = e.select("u", F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("up")))
    by_node = ends.groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return by_node.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("least") == 0))).agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node of its component.

    Alternating large-star and small-star steps, each a minimum by key and a join; no neighbour list is gathered. The
    number of rounds is about the logarithm of the longest path. Links that are stars already need none, and rounds end as
    soon as they are: a count by node tells, where another round would shuffle the links five times to find them unchanged.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def connected_components(nodes: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """(key, root): the least id of each node's component; ``links`` has columns a and b."""
    found = components(links).withColumnRenamed("node", key)
    return nodes.select(key).distinct().join(found, key, "left").select(key, F.coalesce("root", key).alias("root"))


def group_by_key(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Transitive groups of rows that share a key: links run from each row to the least row of its key."""
    low = df.groupBy(key).agg(F.min(id_col).alias("a"))
    return connected_components(df, df.join(low, key).select("a", F.col(id_col).alias("b")), id_col)


def cluster_vectors(vecs: DataFrame, id_col: str, vec: str, eps: float = 0.35, **kw) -> DataFrame:
    """(id, root): single linkage cut at Euclidean distance ``eps`` between unit vectors; outliers are their own cluster.

    This replaces density clustering by a plain definition: two vectors belong together if a chain of steps of at most
    ``eps`` joins them. On unit vectors that is a cosine of at least 1 - eps**2 / 2. For how neighbours are found, exactly
    or by planes with a stated recall, see ``neighbours.nearby``.
    """
    return connected_components(vecs, near_links(vecs, id_col, vec, 1 - eps * eps / 2, **kw), id_col)


def cluster_quality(assign: DataFrame) -> DataFrame:
    """Clusters, outliers and the mean size of clusters, as one row."""
    n = assign.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("clusters"), F.count_if(F.col("n") == 1).alias("outliers"), F.round(F.coalesce(F.avg(F.when(F.col("n") > 1, F.col("n"))), F.lit(0.0)), 6).alias("mean_size"))


def silhouette(assign: DataFrame, vecs: DataFrame, id_col: str, vec: str) -> float:
    """Mean silhouette, by cosine distance, of clusters with two members or more; 0 with fewer than two of them."""
    big = assign.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.xxhash64("root").cast("double").alias("prediction"))
    if len(big.limit(2).collect()) < 2:
        return 0.0
    x = assign.join(big, "root").join(vecs, id_col).select("prediction", array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return ClusteringEvaluator(distanceMeasure="cosine").evaluate(x)


def resolve_aliases(ids: DataFrame, aliases: DataFrame, key: str = "id", rounds: int = 20) -> DataFrame:
    """(key, target): where a chain of aliases (alias -> target) ends; one that runs into a cycle ends at the cycle's
    least member.

    Pointer jumping: every round doubles the length of the chain behind a step, so ``rounds`` bounds chains of
    2**rounds steps; what is open then is a cycle.
    """
    a = aliases.groupBy("alias").agg(F.min("target").alias("target")).where("alias != target")
    walk = cut(a.select("alias", "target", F.col("target").alias("least"), F.lit(True).alias("open")))
    for _ in range(rounds):
        nxt = walk.select(F.col("alias").alias("target"), F.col("target").alias("_t"), F.col("least").alias("_l"))
        walk = cut(walk.join(nxt, "target", "left").select("alias", F.coalesce("_t", "target").alias("target"), F.least("least", "_l").alias("least"), F.col("_t").isNotNull().alias("open")))
        if not walk.where("open").limit(1).count():
            break
    cycle = walk.where("open").select(F.col("alias").alias("target"), F.col("least").alias("_c"))  # a target that is open lies on its cycle
    end = walk.join(cycle, "target", "left").select(F.col("alias").alias(key), F.when(F.col("open"), F.col("_c")).otherwise(F.col("target")).alias("_end"))
    return ids.join(end, key, "left").select(key, F.coalesce("_end", key).alias("target"))


def find_duplicate_stories(stories: DataFrame, id_col: str, vec: str, size: str, sure: float = 0.72, cap: int | None = None, when: str | None = None, now: Column | None = None, hours: int = 48,
                           passes: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None, **kw) -> DataFrame:
    """(survivor, absorbed, cosine): stories with centroids at least ``sure`` alike, the larger (then older) survives; a story
    is absorbed once, and one that is absorbed absorbs none. At most ``cap`` of them are listed, best first.

    With ``when`` and ``now`` only stories of the last ``hours`` before ``now`` take part. ``passes(keep, drop)`` tests a pair
    by other columns of the stories, where ``keep("x")`` is column x of the survivor; see ``same_event``. ``kw`` says how
    neighbours are found (``neighbours.nearby``).

    The rule takes pairs by descending cosine (then ids). A pair is decided as soon as no pair before it touches the
    absorbed story or would absorb the survivor, so all such pairs are decided at once, in rounds over the table of
    pairs; no group is gathered. Without a test, stories with one vector are absorbed by the largest of them first; with
    one, each of them is compared with its neighbours, as the test may tell them apart.
    """
    if when is not None:
        stories = stories.where((F.col(when) <= now) & (F.col(when) >= now - F.expr(f"INTERVAL {int(hours)} HOURS")))
    s = stories.where(F.size(vec) > 0).select(F.col(id_col).alias("id"), F.col(size).alias("size"), F.col(vec).cast("array<double>").alias("v"))
    if passes is None:
        best = s.groupBy("v").agg(F.max_by("id", F.struct(F.col("size"), -F.col("id"))).alias("top"), F.count(F.lit(1)).alias("n"))
        same = cut(s.join(best.where("n > 1"), "v").where("id != top").select(F.col("top").alias("survivor"), F.col("id").alias("absorbed"), cosine(F.col("v"), F.col("v")).alias("cosine")))
        s = cut(s.join(same.select(F.col("absorbed").alias("id")), "id", "left_anti"))
    pairs = nearby(s, "id", "v", sure, collapse=passes is None, **kw).select("a", "b", "cosine")
    pairs = pairs.join(s.select(F.col("id").alias("a"), F.col("size").alias("na")), "a").join(s.select(F.col("id").alias("b"), F.col("size").alias("nb")), "b")
    keep = F.when((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))), F.col("a")).otherwise(F.col("b"))
    rank = F.struct((-F.col("cosine")).alias("c"), "survivor", "absorbed")
    left = pairs.select(keep.alias("survivor"), F.when(keep == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("absorbed"), "cosine")
    if passes is not None:
        whole = stories.select(F.col(id_col).alias("_id"), F.struct("*").alias("_row"))
        left = left.join(whole.select(F.col("_id").alias("survivor"), F.col("_row").alias("_keep")), "survivor").join(whole.select(F.col("_id").alias("absorbed"), F.col("_row").alias("_drop")), "absorbed")
        left = left.where(passes(lambda c: F.col("_keep")[c], lambda c: F.col("_drop")[c])).select("survivor", "absorbed", "cosine")
    left = left.withColumn("rank", rank)
    left = cut(left.join(same.select(F.col("survivor").alias("absorbed")).distinct(), "absorbed", "left_anti") if passes is None else left)
    out = same if passes is None else None
    while out is None or left.limit(1).count():
        as_absorbed = left.groupBy(F.col("absorbed").alias("s")).agg(F.min("rank").alias("lost"))
        touched = left.select(F.explode(F.array("survivor", "absorbed")).alias("t"), "rank").groupBy(F.col("t").alias("absorbed")).agg(F.min("rank").alias("first"))
        x = left.join(touched, "absorbed").join(as_absorbed, F.col("survivor") == F.col("s"), "left")
        won = cut(x.where((F.col("rank") == F.col("first")) & (F.col("lost").isNull() | (F.col("rank") < F.col("lost")))).select("survivor", "absorbed", "cosine"))
        out = won if out is None else out.unionByName(won)
        gone, stay = won.select("absorbed").distinct(), won.select("survivor").distinct()
        left = left.join(gone, "absorbed", "left_anti").join(gone.select(F.col("absorbed").alias("survivor")), "survivor", "left_anti")
        left = cut(left.join(stay.select(F.col("survivor").alias("absorbed")), "absorbed", "left_anti"))
    return out.orderBy(F.desc("cosine"), "survivor", "absorbed").limit(cap) if cap else out


def same_event(keep: Callable[[str], Column], drop: Callable[[str], Column], entities: str = "entities", locations: str = "locations", words: str = "words", time: str = "time", centroid: str = "centroid",
               article_entities: str = "article_entities", article_words: str = "article_words", article_time: str = "article_time", article_vector: str = "article_vector") -> Column:
    """Whether the first article of the story to drop belongs to the story to keep: stage A does not fail and stage B passes
    by its vector alone, as no canonical entities are resolved here."""
    apart = F.timestamp_diff("SECOND", keep(time), drop(article_time)) / 3600.0
    _, first = stage_a(drop(article_entities), keep(entities), keep(locations), apart, jaccard(drop(article_words), keep(words)))
    return (first != "FAIL") & (stage_b(cosine(drop(article_vector), keep(centroid)), F.lit(0)) == "PASS")


def _longest_of_key(rows: DataFrame, block: str, name: str, asks: str, answers: str) -> DataFrame:
    """(block, name, rep) for rows (block, name, key) that ask: of the rows of their key that answer, the longest that is
    longer, or comes before in the alphabet if it is as long; of equally long ones the last. No pairs are made: a key's
    longest name is an aggregate, and the one before a name is a window's."""
    size = F.length(name)
    top = rows.where(answers).groupBy(block, "key").agg(F.max(F.struct(size.alias("n"), F.col(name).alias("rep"))).alias("_top"))
    before = Window.partitionBy(block, "key", "_n").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumn("_n", size).withColumn("_near", F.last(F.when(F.col(answers), F.col(name)), ignorenulls=True).over(before)).where(asks)
    x = x.join(top, [block, "key"])
    return x.select(block, name, F.when(F.col("_top.n") > F.col("_n"), F.col("_top.rep")).otherwise(F.when(F.col("_top.n") == F.col("_n"), F.col("_near"))).alias("rep")).where("rep is not null")


def coref_groups(mentions: DataFrame, block: str, name: str, person: bool = True) -> DataFrame:
    """(block, name, representative): names in a block that mean the same; the longest name represents.

    Which names can mean the same follows from keys: equal cleaned names; of persons, a name of one word (titles aside) and
    names that hold the word; of organisations, names with the same words but for corporate ones, and initials. The rules
    of ``compare.same_person`` and ``same_organisation`` hold. A person's names are never paired: each asks its keys for
    the longest name. Organisations are verified within the names of a key.
    """
    from .compare import _clean, _initials, person_words, same_organisation, stripped

    m = cut(mentions.select(block, name).where(F.col(name).isNotNull()).distinct())
    clean = _clean(F.col(name))
    same = m.select(block, name, F.concat(F.lit("="), clean).alias("key"), F.lit(True).alias("asks"), F.lit(True).alias("answers"))
    if person:
        words = m.select(block, name, person_words(clean).alias("_w"))
        single = F.size("_w") == 1
        words = cut(words.select(block, name, F.explode("_w").alias("key"), single.alias("single"), F.lit(True).alias("any")))
        found = _longest_of_key(words, block, name, "single", "any").unionByName(_longest_of_key(words, block, name, "any", "single"))
        found = found.unionByName(_longest_of_key(same, block, name, "asks", "answers"))
    else:
        a = m.select(block, F.col(name).alias("_a"), F.explode(F.array(F.concat(F.lit("s:"), stripped(clean)), F.concat(F.lit("i:"), _initials(clean)), F.concat(F.lit("i:"), clean), F.concat(F.lit("="), clean))).alias("key")).where("key <> 'i:'").distinct()
        b = a.withColumnRenamed("_a", "_b")
        longer = (F.length("_b") > F.length("_a")) | ((F.length("_b") == F.length("_a")) & (F.col("_b") < F.col("_a")))
        found = a.join(b, [block, "key"]).where(longer).select(block, "_a", "_b").distinct().where(same_organisation(F.col("_a"), F.col("_b"))).select(block, F.col("_a").alias(name), F.col("_b").alias("rep"))
    hit = found.groupBy(block, name).agg(F.max_by("rep", F.struct(F.length("rep"), F.col("rep"))).alias("_rep"))
    one = cut(m.join(hit, [block, name], "left").select(block, name, F.coalesce("_rep", name).alias("representative")))
    # a representative may itself be represented; names grow on the way, so a second look-up closes the chain
    up = one.select(block, F.col(name).alias("representative"), F.col("representative").alias("_up"))
    return one.join(up, [block, "representative"], "left").select(block, name, F.coalesce("_up", "representative").alias("representative"))
