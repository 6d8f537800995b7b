"""De-duplication, hashes and keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import url_key
from ..functions.vector import jaccard
from ..storage import cut


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def url_gate(candidates: DataFrame, articles: DataFrame, bloom: DataFrame | None = None, url: str = "url", article_id: str = "article_id") -> DataFrame:
    """Each candidate URL with url_hash, status and the known article: FOUND_IN_DATABASE if an article has its key,
    FOUND_IN_BLOOM if only the filter says so, else NEW_URL."""
    known = articles.select(url_key(F.col(url)).alias("url_hash"), F.col(article_id).alias("known_id")).groupBy("url_hash").agg(F.min("known_id").alias("known_id"))
    out = candidates.withColumn("url_hash", url_key(F.col(url))).join(known, "url_hash", "left")
    hit = F.lit(False)
    if bloom is not None:
        out = probe_bloom(out, bloom, "url_hash").withColumnRenamed("maybe", "_maybe")
        hit = F.col("_maybe")
    status = F.when(F.col("known_id").isNotNull(), "FOUND_IN_DATABASE").when(hit, "FOUND_IN_BLOOM").otherwise("NEW_URL")
    return out.withColumn("status", status).drop("_maybe")


#: Bits of a block of a membership filter: eight words. A filter of up to so many bytes is broadcast.
_BLOCK, _BROADCAST = 512, 64 << 20


def bloom_rate(per_block: float, k: int) -> float:
    """Share of keys not in a filter that it takes for known, with ``per_block`` keys in a block on average and ``k`` bits a key."""
    low, high = max(0, int(per_block - 12 * per_block**0.5 - 12)), int(per_block + 12 * per_block**0.5 + 24)
    at = lambda i: math.exp(i * math.log(per_block) - per_block - math.lgamma(i + 1))
    return sum(at(i) * (1 - (1 - 1 / _BLOCK) ** (k * i)) ** k for i in range(low, high + 1))


def bloom_shape(keys: int, rate: float) -> tuple[int, int]:
    """(blocks, k): the fewest blocks that hold ``keys`` keys at no more than ``rate`` false positives."""
    if not 0 < rate < 1:
        raise ValueError("the rate must lie between 0 and 1")
    best = (0.0, 1)
    for k in range(1, 15):
        low, high = 1e-3, 600.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if bloom_rate(mid, k) <= rate else (low, mid)
        best = max(best, (low, k))
    return max(1, math.ceil(keys / best[0])), best[1]


def _bits(key: str, blocks: int, k: int) -> tuple[Column, Column]:
    """The block of a key, and the places of its bits there: nine bits of a hash each."""
    places = [F.shiftrightunsigned(F.xxhash64(key, F.lit(1 + i // 7)), 9 * (i % 7)).bitwiseAND(F.lit(_BLOCK - 1)) for i in range(k)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), F.array(*places)


def build_bloom(df: DataFrame, key: str, rate: float = 0.01, expect: int | None = None) -> DataFrame:
    """A membership filter as a table of blocks: (block, w0 ... w7, blocks, k), packed words of 64 bits.

    Its size follows from the number of keys (or of those that are ``expect``ed later, for filters that are to be merged)
    and from the rate of false positives. All bits of a key are in one block, so a key is looked up once. A filter is
    rebuilt by building it again. Null keys are not in it.
    """
    rows = df.where(F.col(key).isNotNull())
    blocks, k = bloom_shape(rows.count() if expect is None else expect, rate)
    block, places = _bits(key, blocks, k)
    bit = lambda j: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.when(F.shiftright(x, 6) == j, F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))))
    words = rows.select(block.alias("block"), places.alias("p")).select("block", *[bit(j).alias(f"w{j}") for j in range(8)])
    return words.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(8)]).withColumns({"blocks": F.lit(blocks).cast("long"), "k": F.lit(k)})


def merge_blooms(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of the keys of both; they must have been built for the same number of keys and rate."""
    shapes = a.unionByName(b).groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(8)], F.max("blocks").alias("blocks"), F.max("k").alias("k"), F.min("blocks").alias("_b"), F.min("k").alias("_k"))
    same = F.when((F.col("blocks") == F.col("_b")) & (F.col("k") == F.col("_k")), F.col("k")).otherwise(F.raise_error(F.lit("filters of different shapes cannot be merged")).cast("int"))
    return shapes.withColumn("k", same).drop("_b", "_k")


def probe_bloom(df: DataFrame, bloom: DataFrame, key: str) -> DataFrame:
    """``df`` with ``maybe``: whether all bits of the key are set. No key that was added is missed; an empty filter, and one
    that was never built, knows nothing, so all keys count as new. Null keys are not known.

    The filter is broadcast if it is small, else keys meet their blocks by a shuffle.
    """
    shape = bloom.select("blocks", "k").first()
    if shape is None:
        return df.withColumn("maybe", F.lit(False))
    block, places = _bits(key, shape["blocks"], shape["k"])
    words = bloom.select(F.col("block").alias("_block"), F.array(*[f"w{j}" for j in range(8)]).alias("_w"))
    if shape["blocks"] * 80 <= _BROADCAST:
        words = F.broadcast(words)
    x = df.withColumn("_block", F.when(F.col(key).isNotNull(), block)).withColumn("_p", places).join(words, "_block", "left")
    one = lambda p: F.call_function("getbit", F.element_at("_w", (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    return x.withColumn("maybe", F.coalesce(F.col("_w").isNotNull() & F.forall("_p", one), F.lit(False))).drop("_block", "_p", "_w")


def link_duplicates(df: DataFrame, key: Column, id_col: str, *order: Column) -> DataFrame:
    """(id, content_hash, duplicate_of): later rows point at the first with the same hash; the first at nothing.

    The first row of a hash comes from an aggregate with partial sums, so one very common text is no large window.
    """
    x = df.select(F.col(id_col), key.alias("content_hash"), F.struct(*order, F.col(id_col)).alias("_o"))
    first = x.groupBy("content_hash").agg(F.min("_o")[id_col].alias("_first"))
    return x.join(first, "content_hash").select(id_col, "content_hash", F.when(F.col("_first") != F.col(id_col), F.col("_first")).alias("duplicate_of"))


def upsert_articles(base: DataFrame, incoming: DataFrame, key: str = "url_hash") -> DataFrame:
    """(key, body, hash, version, change): a changed hash replaces the text and raises the version; a new key begins at 1."""
    b, n = base.alias("b"), incoming.alias("n")
    changed = F.col("n.hash").isNotNull() & ~F.col("n.hash").eqNullSafe(F.col("b.hash"))
    return (b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
            .select(F.coalesce(f"b.{key}", f"n.{key}").alias(key), F.when(changed, F.col("n.body")).otherwise(F.col("b.body")).alias("body"),
                    F.when(changed, F.col("n.hash")).otherwise(F.col("b.hash")).alias("hash"),
                    F.when(F.col("b.version").isNull(), F.lit(1)).when(changed, F.col("b.version") + 1).otherwise(F.col("b.version")).alias("version"),
                    F.when(F.col(f"b.{key}").isNull(), "insert").when(changed, "update").otherwise("keep").alias("change")))


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], exprs: dict[str, Column]) -> DataFrame:
    """Keyed insert or update: ``exprs`` give each result column from aliases b (base) and d (delta)."""
    b, d = base.alias("b"), delta.alias("d")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    both = b.join(d, on, "full_outer")
    return both.select(*[F.coalesce(f"b.{k}", f"d.{k}").alias(k) for k in keys], *[e.alias(c) for c, e in exprs.items()])


def group_candidates(entries: DataFrame, norm: str, day: str, url: str, source: str, headline: str, order: str, wires: Sequence[str], least: int = 10) -> DataFrame:
    """Entries of one normalised headline and day as a candidate: key, first headline, different URLs, sources, priority."""
    e = entries.where(F.length(norm) >= least)
    key = F.sha2(F.concat_ws(":", norm, F.col(day).cast("string")), 256)
    return (e.groupBy(key.alias("candidate_key"), F.col(norm).alias("norm"), F.col(day).alias("day"))
            .agg(F.min_by(headline, order).alias("headline"), F.count_distinct(url).alias("urls"), F.array_sort(F.collect_set(source)).alias("sources"),
                 F.max(F.when(F.col(source).isin(*wires), 90).otherwise(50)).alias("priority")))


def changed_clusters(members: DataFrame, previous: DataFrame, cluster: str, member: str) -> DataFrame:
    """Clusters whose members' hash is not the one of last time: (cluster, members_hash)."""
    now = members.groupBy(cluster).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), "::"), 256).alias("members_hash"))
    old = previous.select(F.col(cluster), F.col("members_hash").alias("_old"))
    return now.join(old, cluster, "left").where(~F.col("members_hash").eqNullSafe(F.col("_old"))).drop("_old")


def new_artifacts(existing: DataFrame, new: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """New artifacts whose key and content hash are not there yet; the content is JSON with its keys in order."""
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(payload)])), 256)
    n = new.withColumn("content_hash", h).dropDuplicates([*keys, "content_hash"])
    return n.join(existing.withColumn("content_hash", h).select(*keys, "content_hash").distinct(), [*keys, "content_hash"], "left_anti")


def embedding_misses(texts: DataFrame, cache: DataFrame, text: str, id_col: str, model: str) -> DataFrame:
    """Distinct cache keys to embed (cache_key, n_rows, zero): the key names model and text; empty text needs no model."""
    key = F.concat(F.lit(model + ":"), F.sha2(F.coalesce(text, F.lit("")), 256))
    t = texts.select(key.alias("cache_key"), (F.trim(F.coalesce(text, F.lit(""))) == "").alias("zero"))
    return t.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or("zero").alias("zero")).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def event_fingerprint(kind: Column, actors: Column, targets: Column, location: Column, date: Column) -> Column:
    """First 32 digits of the SHA-256 of type, sorted actors, sorted targets, place and date."""
    side = lambda a: F.array_join(F.array_sort(F.filter(F.transform(a, lambda x: F.lower(F.trim(x))), lambda x: x != "")), ",")
    return F.substring(F.sha2(F.concat_ws("::", F.coalesce(kind, F.lit("")), side(actors), side(targets), F.lower(F.trim(F.coalesce(location, F.lit("")))), F.coalesce(date.cast("string"), F.lit(""))), 256), 1, 32)


def usable_fingerprints(events: DataFrame, fp: str, when: str, cap: int = 30) -> DataFrame:
    """Events with a time, whose fingerprint has at most ``cap`` events."""
    n = events.where(F.col(when).isNotNull()).groupBy(fp).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= cap).select(fp)
    return events.where(F.col(when).isNotNull()).join(n, fp, "left_semi")


def near_duplicates(df: DataFrame, id_col: str, text: str, least: float = 0.7, shingle: int = 3, bands: int = 8, rows: int = 2, small: int = 16, rounds: int = 3) -> DataFrame:
    """Links (a, b, jaccard) of texts whose word shingles are at least ``least`` alike, found by MinHash bands.

    Equal texts count once, by their least id. All pairs of a band's bucket of up to ``small`` texts are compared. In a
    larger one every text is compared with the bucket's least id, then what is unlike that with the least of the rest,
    ``rounds`` times, so a large group of near copies makes about as many links as it has members, not their square.
    Approximate: tests hold that at least nine in ten of all links are found, or are implied by links that are.
    """
    x = df.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("_h")).agg(F.min(id_col).alias("id"), F.first(F.coalesce(text, F.lit(""))).alias(text))
    x = x.select("id", F.split(F.lower(F.trim(text)), r"\s+").alias("w"))
    runs = F.arrays_zip(*[F.slice("w", i + 1, F.greatest(F.size("w") - shingle + 1, F.lit(1))).alias(f"w{i}") for i in range(shingle)])
    grams = x.select("id", F.inline(runs)).select("id", F.xxhash64(*[f"w{i}" for i in range(shingle)]).alias("v"))
    # minima are sums of parts: one aggregate over exploded shingles, compiled, instead of a pass over an array for each
    lows = grams.groupBy("id").agg(*[F.min(F.xxhash64("v", F.lit(k))).alias(f"m{k}") for k in range(bands * rows)])
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * rows + r}") for r in range(rows)]) for b in range(bands)])
    b = lows.select("id", F.explode(keys).alias("k"))
    b = cut(b.join(b.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "k"))

    def alike(links: DataFrame) -> DataFrame:
        links = cut(links.select("a", "b").distinct())
        wanted = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = grams.join(wanted, "id").groupBy("id").agg(F.collect_set("v").alias("g"))
        y = links.join(sets.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
        return cut(y.select("a", "b", F.round(jaccard(F.col("ga"), F.col("gb")), 6).alias("jaccard")).where(F.col("jaccard") >= least))

    few = b.where(F.col("c") <= small)
    found = alike(few.select("k", F.col("id").alias("a")).join(few.select("k", F.col("id").alias("b")), "k").where("a < b"))
    rest = b.where(F.col("c") > small).select("k", "id")
    for _ in range(rounds):
        if not rest.limit(1).count():
            break
        star = cut(rest.join(rest.groupBy("k").agg(F.min("id").alias("a")), "k").where("id != a").select("k", "a", F.col("id").alias("b")))
        good = alike(star)
        found = found.unionByName(good)
        rest = cut(star.join(good, ["a", "b"], "left_anti").select("k", F.col("b").alias("id")))
    return found.distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, root): groups of texts that chains of near duplicates join, named by their least id; exact.

    Two texts are near duplicates if the sets of their runs of five words (lower case; fewer words: all of them) have
    Jaccard similarity 0.75 or more, and equal texts always are. Null texts are empty ones. Links are found as in
    ``set_join.near_duplicates``: runs stay in arrays until the few that are indexed, and those of many texts are indexed by
    combinations.
    """
    from .set_join import near_duplicates as joined

    t = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    # an empty word before or after white space counts: it is a byte that no text has
    empty, none = F.lit(bytearray(b"\xff")), F.lit(bytearray())
    space = F.lit(bytearray(b" "))
    whole = F.concat(F.when(t == "", empty).when(t.rlike(r"^\s"), F.concat(empty, space)).otherwise(none), t.cast("binary"), F.when(t.rlike(r"\s\z"), F.concat(space, empty)).otherwise(none))
    found = joined(df.select(F.col(id_col).alias("doc_id"), whole.alias("text")))
    return found.select(F.col("doc_id").alias(id_col), F.col("component_id").alias("root"))


def fabricated(df: DataFrame, fp: str, cap: int) -> DataFrame:
    """Rows whose fingerprint more than ``cap`` rows share."""
    n = df.groupBy(fp).agg(F.count(F.lit(1)).alias("shared_by")).where(F.col("shared_by") > cap)
    return df.join(n, fp)


def fabricated_links(rows: DataFrame, fp: str, cap: int, article: str, links: DataFrame, story: str) -> DataFrame:
    """(article, story) of every article with a fingerprint that more than ``cap`` rows share, as ``links`` has them; the
    story is null where the article is in none."""
    return fabricated(rows, fp, cap).select(article).distinct().join(links.select(article, story).distinct(), article, "left")
