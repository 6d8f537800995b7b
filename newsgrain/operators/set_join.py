"""Similarity join of documents on word shingles: prefixes over a global token order, with token combinations for
crowded tokens, then exact verification; classes are the components of the links."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import bounded_batches, counted_cut, cut, on_driver
from .clustering import components

GRAM, PERCENT = 5, 75
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE2 = _BYTE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TURN = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BLOCK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _TURN[0]
    x = (x ^ (x >> np.uint64(27))) * _TURN[1]
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` (A-Z lower-cased), and where the words begin."""
    out, begins, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        while end < len(data) and not _SPACE[data[end]] and not _SPACE[data[end - 1]]:
            nxt = [k for k in (data.find(b, end) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if k >= 0]
            end = min(nxt) if nxt else len(data)
        b = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).view(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers(1 << max(21, int(len(b)).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE2[b] * up[: len(b)])])
        out.append(_mix((total[stop] - total[start]) * down[start]))
        begins.append(start + at)
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(begins)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed longs; empty without words."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t) + 1
        if size >= _BLOCK or i == len(texts) - 1:
            joined = b" ".join(group)
            words, begins = word_hashes(joined)
            ends = np.cumsum([len(t) + 1 for t in group])
            upto = np.searchsorted(begins, ends)
            n = len(words) - GRAM + 1
            grams = np.zeros(0, np.uint64)
            if n > 0:
                grams = words[:n].copy()
                for k in range(1, GRAM):
                    grams = grams * _TURN[2] + words[k : k + n]
                grams = _mix(grams * _TURN[3])
            first = 0
            for last in upto:
                if last - first >= GRAM:
                    own = np.sort(grams[first : last - GRAM + 1].view(np.int64))
                    yield own if len(own) == 1 else own[np.concatenate([[True], own[1:] != own[:-1]])]
                elif last > first:
                    h = np.uint64(last - first)
                    for w in words[first:last]:
                        h = _mix(np.array([h * _TURN[4] + w]))[0]
                    yield np.array([h], np.uint64).view(np.int64)
                else:
                    yield np.zeros(0, np.int64)
                first = last
            group, size = [], 0


def set_key(s: np.ndarray) -> int:
    """A 64-bit name of a set, from its members whatever their order."""
    u = s.view(np.uint64)
    return int(_mix(np.array([_mix(u).sum(dtype=np.uint64) * _TURN[1] + np.bitwise_xor.reduce(_mix(u * _TURN[4])) + np.uint64(len(u))], np.uint64)).view(np.int64)[0])


def _texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_old = np.seterr(over="ignore")


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """In one pass over the texts: a row a document (doc_id, n, sk: the set's key, tk: a hash of the text) and, with n
    null, counts of shingles that different sets of a task share (token, cnt)."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = 1 << 22

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "sk", "tk", "token", "cnt"]
        pend, n_pend, done, id_type = [], 0, set(), None

        def counts():
            token, cnt = np.unique(np.concatenate(pend), return_counts=True)
            token, cnt = token[cnt > 1], cnt[cnt > 1]
            z = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(token), id_type), z, z, z, pa.array(token), pa.array(cnt.astype(np.int64))], names)

        for b in batches:
            id_type = b.schema.field(0).type
            n, sk = [], []
            for s in shingle_sets(_texts(b.column(1))):
                n.append(len(s))
                sk.append(set_key(s) if len(s) else None)
                if len(s) and sk[-1] not in done:  # copies would make all of their tokens look shared
                    done.add(sk[-1])
                    pend.append(s)
                    n_pend += len(s)
            z = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sk, pa.int64()), b.column(2), z, z], names)
            if n_pend >= held:
                yield counts()
                pend, n_pend, done = [], 0, set()
        if pend:
            yield counts()

    text = F.col(text_col)
    return (docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("tk"))
            .mapInArrow(run, f"doc_id {kind}, n long, sk long, tk long, token long, cnt long"))


#: A posting's ``w`` has, from its upper end: n (29 bits), the token's place in the set's order (26), how frequent the
#: set's tokens are on average (7) and whether this token is frequent (1).
_N, _PLACE, _CENT = 34, 8, 1


#: Sets have a class of crowded tokens for so many of their own.
CLASS = 96


def classes_for(n):
    """Into how many classes the crowded tokens of sets of ``n`` tokens or a few more are dealt."""
    return np.maximum(1, n // CLASS)


def postings(docs: DataFrame, text_col: str, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, sk, w): the extended prefix of each different set in the global order of tokens.

    Tokens that are not in ``frequent`` come first, by hash; then the frequent ones, rarest first (``frequent`` lists
    them so, with how often they occur in ``counts``). A set of n tokens that shares 75 % with another shares a token of
    its first n - ceil(0.75 n) + 1, and m + 1 tokens of the prefix that is longer by m = ``classes_for``(n).
    """
    spark = docs.sparkSession
    by_value = np.argsort(frequent)
    known = spark.sparkContext.broadcast((frequent[by_value], by_value, np.log2(counts[by_value] + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rank, logs = known.value
        done: set[int] = set()
        for b in batches:
            cols = [[], [], []]
            for s in shingle_sets(_texts(b.column(0))):
                n = len(s)
                if not n:
                    continue
                key = set_key(s)
                if key in done:  # only spares work: copies that others emit meet in the same bucket
                    continue
                if len(done) > 100_000:
                    done.clear()
                done.add(key)
                p = n - -(-PERCENT * n // 100) + 1 + int(classes_for(n))
                rare, own, cent = s[:p], s[:0], 0
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    hot = values[at] == s
                    if hot.any():
                        rare = s[~hot][:p]
                        own = s[hot][np.argsort(rank[at[hot]])][: p - len(rare)]
                        cent = min(127, int(3 * logs[at[hot]].sum() / n))
                k = len(rare) + len(own)
                cols[0] += [rare, own]
                cols[1].append(np.full(k, key, np.int64))
                place = np.arange(k, dtype=np.int64)
                cols[2].append((n << _N) | (place << _PLACE) | (cent << _CENT) | (place >= len(rare)))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["token", "sk", "w"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "token long, sk long, w long")


def shared_postings(docs: DataFrame, text_col: str, frequent: np.ndarray, counts: np.ndarray, salts: int = 16) -> DataFrame:
    """The postings of tokens that several sets list, once a set and token; frequent tokens are kept in any case.

    One exchange, which both sides of the join read. Frequent tokens are spread over ``salts`` places.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = F.col("w").bitwiseAND(F.lit(1)) != 0
    dealt = (postings(docs, text_col, frequent, counts).withColumn("salt", F.when(often, F.pmod("sk", F.lit(salts))).otherwise(F.lit(0)).cast("int"))
             .repartition(parts, "token", "salt"))
    several = (dealt.groupBy("token", "salt").agg(F.min("sk").alias("lo"), F.max("sk").alias("hi"), F.bit_or("w").alias("any"))
               .where((F.col("lo") != F.col("hi")) | (F.col("any").bitwiseAND(F.lit(1)) != 0)).select("token", "salt"))
    return dealt.join(several.hint("shuffle_hash"), ["token", "salt"]).groupBy("token", "salt", "sk").agg(F.min("w").alias("w")).drop("salt")


def _size() -> Column:
    return F.shiftright("w", _N)


def _fits(x: Column, y: Column) -> Column:
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _classes_of(n: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(n / CLASS))


def leaders(shared: DataFrame) -> DataFrame:
    """(a, b): every set b with the set a that it meets most often among the leaders of its tokens, if it meets it as
    often as a linked pair must.

    A token's leader is the set whose tokens are the most frequent on average: of edited copies, the one nearest to the
    common original.
    """
    cent = F.shiftright("w", _CENT).bitwiseAND(F.lit(127))
    lead = (shared.groupBy("token").agg(F.max(F.struct(cent.alias("cent"), F.xxhash64("sk").alias("turn"), F.col("sk").alias("a"), _size().alias("na"))).alias("l"), F.count(F.lit(1)).alias("c"))
            .where("c > 1").select("token", "l.a", "l.na"))
    met = shared.join(lead, "token").where((F.col("sk") != F.col("a")) & _fits(_size(), F.col("na"))).groupBy("sk", "a").agg(F.count(F.lit(1)).alias("c"), F.min(F.least(_size(), F.col("na"))).alias("n"))
    met = met.where(F.col("c") > _classes_of(F.col("n")))
    return met.groupBy(F.col("sk").alias("b")).agg(F.max(F.struct("c", "a"))["a"].alias("a")).select("a", "b")


def small(table: DataFrame, rows: int, at_once: int = 1_000_000) -> DataFrame:
    """A written table of a few long columns: broadcast if it has at most ``at_once`` rows, else left to the planner."""
    return F.broadcast(table) if rows <= at_once else table


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sk, tokens) of the sets in ``wanted`` (doc_id, tk: a document that has the set). Up to a million wanted documents
    are broadcast, so that texts stay where they are; more are joined by a shuffle."""
    ids = small(*counted_cut(wanted.select(F.col("doc_id").alias("_rep"), F.col("tk").alias("_tk")).distinct()))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t"))
    texts = texts.join(ids, F.col("_id").eqNullSafe(F.col("_rep")) & (F.xxhash64("t") == F.col("_tk")), "left_semi").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            found = {k: s for s in shingle_sets(_texts(b.column(0))) if len(s) and (k := set_key(s)) not in done}
            done |= found.keys()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["sk", "tokens"])

    return texts.mapInArrow(run, "sk long, tokens array<long>")


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of set keys whose Jaccard similarity is 0.75 or more, by their whole sets; a pair may come twice.

    Sets are made for those in ``pairs`` only and written. Pairs of a set that has many are split by the planner, which
    it may do as nothing after the joins relies on where they are.
    """
    pairs = cut(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("sk")).distinct()
    found = cut(sets_of(docs, sets.join(keys, "sk").select("doc_id", "tk"), id_col, text_col))
    both = pairs.join(found.select(F.col("sk").alias("b"), F.col("tokens").alias("tb")), "b").join(found.select(F.col("sk").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    return cut(both.where(100 * shared >= PERCENT * (F.size("ta") + F.size("tb") - shared)).select("a", "b"))


@functools.lru_cache(1)
def size_bands() -> np.ndarray:
    """The least sizes of bands that are five per cent wide (one size each below 20)."""
    edges = [1]
    while edges[-1] < 1 << 29:
        edges.append(max(edges[-1] + 1, edges[-1] * 105 // 100))
    return np.array(edges, np.int64)


def signs_of(n: int, pos: np.ndarray, token: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signs under which a set of ``n`` tokens is indexed, the places of the (first and second) tokens that make them, and
    the sign's side: -1 for partners of larger bands, 1 for those of smaller ones, else 0.

    A linked pair shares ``must`` tokens, so the first shared one has at least so many from it on in both sets, the
    next one less, and so on. Each token that few sets list is a sign of its own. The crowded ones are dealt into m
    classes: if the first m + 1 shared tokens are all crowded, two of them are in one class, so every combination of
    two in a class is a sign. Their signs also name the bands of both sets' sizes, and a combination is left out for
    partners of a band if too few tokens remain after it. So crowded tokens that come late in a set, as those of
    an original in much edited copies do, make no signs for partners of its size.
    """
    few = ~crowded
    out = [(_mix(token[few].view(np.uint64) * _TURN[2]), pos[few], pos[few], np.zeros(int(few.sum()), np.int64))]
    edges, own_pos, own = size_bands(), pos[crowded], token[crowded]
    if len(own) > 1:
        band = int(np.searchsorted(edges, n, "right")) - 1
        smallest, largest = -(-PERCENT * n // 100), 100 * n // PERCENT
        for k in range(int(np.searchsorted(edges, smallest, "right")) - 1, int(np.searchsorted(edges, largest, "right"))):
            low, high = min(band, k), max(band, k)
            m = int(classes_for(edges[low]))
            must = -(-PERCENT * (n + max(smallest, int(edges[k]))) // (100 + PERCENT))
            use = n - own_pos + m >= must
            if use.sum() < 2:
                continue
            at, t = own_pos[use], own[use].view(np.uint64)
            kind = t % np.uint64(m)
            order = np.lexsort((at, kind))
            at, t, kind = at[order], t[order], kind[order]
            ends = np.searchsorted(kind, kind, "right")
            count = ends - np.arange(len(t)) - 1
            count[n - at + m - 1 < must] = 0
            i = np.repeat(np.arange(len(t)), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
            out.append((_mix(_mix(t[i] * _TURN[3]) + t[j] * _TURN[4] + np.uint64((low << 16) | high)), at[i], at[j], np.full(len(i), (band > k) - (band < k), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signs(left: DataFrame) -> DataFrame:
    """(sign, sk, n, root, reach, x, y, side): see ``signs_of``; ``reach``: the set lists crowded tokens. ``left`` has a row a
    set (sk, root, n, ts: its open postings, in the order of their places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = b.column(3)
            flat, ends = ts.flatten(), np.cumsum(np.array([len(x) for x in ts], np.int64))
            pos, token, crowded = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            first, cols = 0, [[], [], [], [], [], [], [], []]
            for i, last in enumerate(ends):
                n, mine = b.column(2)[i].as_py(), crowded[first:last]
                s, x, y, side = signs_of(n, pos[first:last], token[first:last], mine)
                for c, v in zip(cols, (s.view(np.int64), np.full(len(s), b.column(0)[i].as_py(), np.int64), np.full(len(s), n, np.int64), np.full(len(s), b.column(1)[i].as_py(), np.int64), np.full(len(s), mine.any()), x, y, side), strict=True):
                    c.append(v)
                first = last
            if len(ends):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["sign", "sk", "n", "root", "reach", "x", "y", "side"])

    return left.select("sk", "root", "n", "ts").mapInArrow(run, "sign long, sk long, n long, root long, reach boolean, x long, y long, side long")


def candidates(shared: DataFrame, known: DataFrame, crowd: int) -> DataFrame:
    """(a, b): pairs of sets in different classes that share signs enough to be linked; ``known`` (sk, root) has the
    classes so far. Only tokens whose sets lie in different classes are indexed, and of their signs those that sets of
    different classes list. The largest class of a sign, say the copies of one text, is on one side of the join only,
    so a sign costs its other members times all of them, not the square of its size."""
    rooted = shared.join(known, "sk", "left").select("token", "sk", "w", F.coalesce("root", "sk").alias("root"))
    tokens = (rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c"))
              .where("lo != hi").select("token", (F.col("c") >= crowd).alias("crowded")))
    place = F.shiftright("w", _PLACE).bitwiseAND(F.lit((1 << 26) - 1))
    left = (rooted.join(tokens, "token").groupBy("sk", "root", _size().alias("n")).agg(F.array_sort(F.collect_list(F.struct(place.alias("pos"), "token", "crowded"))).alias("ts"))
            .where(F.size("ts") > 1))
    found = cut(signs(left))
    # of each sign the class that lists it most: its members meet the others only, not each other
    each = found.groupBy("sign", "root").agg(F.count(F.lit(1)).alias("c"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    most = (each.groupBy("sign").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .where((F.col("roots") > 1) & (F.col("lo") + F.col("hi") == 0)).select("sign", "main"))
    found = cut(found.join(most, "sign").withColumn("main", F.col("root") == F.col("main")))
    other = found.select("sign", *[F.col(c).alias(f"{c}2") for c in ("sk", "n", "root", "reach", "x", "y", "side", "main")])
    must = F.ceil(PERCENT * (F.col("n") + F.col("n2")) / F.lit(100.0 + PERCENT))
    m = _classes_of(F.least("n", "n2"))
    room = lambda c: F.least(F.col("n") - F.col(c), F.col("n2") - F.col(f"{c}2"))
    # pairs of which one lists no crowded token share m + 1 single ones
    enough = F.when(F.col("reach") & F.col("reach2"), F.lit(1).cast("long")).otherwise(F.least(m + 1, must))
    return (found.where("NOT main").join(other, "sign")
            .where((F.col("main2") | (F.col("sk") < F.col("sk2"))) & (F.col("root") != F.col("root2")) & (F.col("side") + F.col("side2") == 0) & _fits(F.col("n"), F.col("n2")) & (room("x") + m >= must) & (room("y") + m >= must))
            .groupBy(F.least("sk", "sk2").alias("a"), F.greatest("sk", "sk2").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max(room("x")).alias("room"), F.max(must).alias("must"), F.max(m).alias("m"), F.max(enough).alias("enough"))
            .where("c >= enough").select("a", "b"))


def _rooted(links: DataFrame) -> DataFrame:
    """(sk, root): the least key of the component of every key in ``links``."""
    return components(links).withColumnRenamed("node", "sk")


def classes(docs: DataFrame, id_col: str, text_col: str, often: int, most: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The profiles of all rows (doc_id, n, sk, tk), and (sk, root, component_id) of all different sets."""
    bounded_batches(docs.sparkSession)
    prof = cut(profiles(docs, id_col, text_col))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "tk")
    sets = cut(prof.where("sk is not null").groupBy("sk").agg(F.min(first).alias("x"), F.min("doc_id").alias("least")).select("sk", "least", "x.doc_id", "x.tk"))
    counted = on_driver(prof.where("token is not null").groupBy("token").agg(F.sum("cnt").alias("df")).where(F.col("df") > often)
                        .orderBy(F.desc("df"), "token").limit(most).orderBy("df", "token"))
    shared = cut(shared_postings(docs, text_col, counted["token"].to_numpy(np.int64), counted["df"].to_numpy(np.int64)))

    links = verified(docs, leaders(shared), sets, id_col, text_col)
    known = small(*counted_cut(_rooted(links)))
    more = verified(docs, candidates(shared, known, crowd), sets, id_col, text_col)
    every = _rooted(known.select(F.col("sk").alias("a"), F.col("root").alias("b")).unionByName(more))

    names = sets.select("sk", "least").join(every, "sk", "left").withColumn("root", F.coalesce("root", "sk"))
    ids = names.groupBy("root").agg(F.min("least").alias("component_id"))
    return prof.where("n is not null").select("doc_id", "n", "sk", "tk"), names.join(ids, "root").select("sk", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", often: int = 16, most: int = 1_000_000, crowd: int = 64) -> DataFrame:
    """Classes of near-duplicate texts: (doc_id, n_shingles, component_id), a row a row of ``docs``.

    Two texts link if their sets of distinct five-word shingles (A-Z lower-cased; fewer words: the whole sequence) have
    Jaccard similarity 0.75 or more; classes are the components of the links, named by their least id. All links between
    different sets count; texts with equal sets are one member of the search from the start.

    1. A pass over the texts names each set and counts shingles. The up to ``most`` shingles that occur in more than
       ``often`` sets go last in the global token order; any order is correct, and this one keeps shared passages out
       of prefixes.
    2. Every set lists its extended prefix, and is verified against one leader of its tokens. This settles large groups
       of near copies with one comparison a member.
    3. Tokens whose sets lie in different classes so far are indexed: those of ``crowd`` sets or more by combinations
       of two, the others singly. Members of a sign's largest class meet its other members only. Pairs across classes
       that pass the bounds on size and place are verified.

    Null and empty texts and those without words have 0 shingles and link with nothing; their component is their own id.
    Ids may be null or repeat: rows are told apart by their sets, and nulls are ignored where a least id is taken. An
    empty table gives an empty result. Only the two named columns are read. Sets are named by 64-bit hashes.
    """
    prof, names = classes(docs, id_col, text_col, often, most, crowd)
    out = prof.select("doc_id", F.col("n").alias("n_shingles"), "sk").join(names.select("sk", "component_id"), "sk", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
