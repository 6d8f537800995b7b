"""Neighbours of vectors: exactly, by tiles of a matrix product, or by random planes with a stated recall."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Vectors of a side of a tile: a task holds two such sides, and a slab of products of one of them, made ``_WIDE`` at a time where
#: pairs are sought; what it finds leaves it slab by slab, in batches of ``_ROWS``.
TILE, _SLAB, _WIDE = 16_384, 128, 1024
_ROWS = 100_000


@dataclass(frozen=True)
class PlanePlan:
    """``tables`` tables of ``planes`` random planes; ``recall`` is the chance that a pair with cosine ``least`` is found."""

    least: float
    planes: int
    tables: int

    def chance(self, c: float) -> float:
        """Vectors at an angle t lie on one side of a random plane with probability 1 - t / pi."""
        return 1 - (1 - (1 - math.acos(max(-1.0, min(1.0, c))) / math.pi) ** self.planes) ** self.tables

    @property
    def recall(self) -> float:
        return self.chance(self.least)


def plane_plan(least: float, recall: float, n: int, most: int = 4096) -> PlanePlan:
    """The cheapest planes and tables that find a pair with cosine ``least`` with probability ``recall`` or more.

    More planes make smaller buckets but need more tables; the cost counts a row in a table, and of the ``n`` vectors those
    that share its bucket by chance. An error says so if ``most`` tables do not suffice: such a threshold asks for the exact
    method. A recall of 1 leaves nothing to planes: all vectors are in one bucket, and all of its tiles are compared.
    """
    if not 0 < recall <= 1 or not -1 < least <= 1:
        raise ValueError("recall must lie between 0 and 1, the cosine above -1")
    if recall == 1:
        return PlanePlan(least, 0, 1)
    one = 1 - math.acos(least) / math.pi
    plans = []
    for k in range(1, 49):
        hit = one**k
        tables = 1 if hit >= recall else math.ceil(math.log1p(-recall) / math.log1p(-hit))
        plans.append((tables * (1 + n / 2**k / 256), tables, k))
    fits = [p for p in plans if p[1] <= most]
    if not fits:
        raise ValueError(f"a cosine of {least} with recall {recall} needs more than {most} tables: use method='exact'")
    _, tables, planes = min(fits)
    return PlanePlan(least, planes, tables)


def _unit(column) -> np.ndarray:
    """Rows of unit length; zero vectors stay zero, so they are like nothing."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-300)
    return x


def _sketch(u: np.ndarray) -> pa.Array:
    """Unit vectors in a byte a number, each with its step and how far off it is at most (two floats before the bytes)."""
    step = np.abs(u).max(axis=1, initial=0).astype(np.float32) / np.float32(127)
    q = np.nan_to_num(np.clip(np.rint(u / np.maximum(step, 1e-30)[:, None]), -127, 127)).astype(np.int8)
    off = (np.linalg.norm(u - step[:, None].astype(np.float64) * q, axis=1) * 1.000001 + 1e-9).astype(np.float32)
    return pa.array([x.tobytes() for x in np.concatenate([np.stack([step, off], axis=1).view(np.int8), q], axis=1)], pa.binary())


def _unsketch(column) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)
    two = np.ascontiguousarray(raw[:, :8]).view(np.float32).astype(np.float64)
    return raw[:, 8:] * two[:, :1], two[:, 1]


def _keys(dims: int, plan: PlanePlan, seed: int, sketched: bool):
    """From batches (id, v, half) rows (bucket, id, v, half): the sides of the planes of each table. ``sketched`` vectors leave as
    bytes, as a row becomes as many rows as there are tables."""
    normals = np.random.default_rng(seed).standard_normal((dims, plan.tables * plan.planes))
    weight = 1 << np.arange(plan.planes, dtype=np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                bits = (x @ normals > 0).reshape(len(x), plan.tables, plan.planes)
                yield b, ((bits * weight).sum(axis=2) * plan.tables + np.arange(plan.tables)).T.reshape(-1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, keys in keyed(batches):
            again = pa.array(np.tile(np.arange(b.num_rows), plan.tables))
            cols = [b.column(0), _sketch(_unit(b.column(1))) if sketched else b.column(1), b.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[c.take(again) for c in cols]], ["bucket", "id", "v", "half"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, keys in keyed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(2).take(pa.array(np.tile(np.arange(b.num_rows), plan.tables)))], ["bucket", "half"])

    return rows, sizes


def _dealt(rows: DataFrame, sizes: DataFrame, cap: int, two_sided: bool) -> DataFrame:
    """Rows (bucket, id, v, half) dealt to tiles (bucket, i, j): a bucket with more than ``cap`` vectors on a side is cut into
    strips, and each pair of strips is a tile of its own. In a self-join ``half`` says which strip of its tile a row is of.
    ``sizes`` has the same buckets and halves, without vectors."""
    side = ["bucket", "half"] if two_sided else ["bucket"]
    n = sizes.groupBy(*side).agg(F.count(F.lit(1)).alias("n"))
    strips = F.ceil(F.col("n") / cap).cast("int")
    if two_sided:
        at = lambda k: F.coalesce(F.max(F.when(F.col("half") == k, strips)), F.lit(0)).alias(f"g{k}")
        many = n.groupBy("bucket").agg(at(0), at(1)).where("g0 > 1 or g1 > 1")
    else:
        many = n.select("bucket", strips.alias("g0"), F.lit(1).alias("g1")).where("g0 > 1")
    rows = rows.join(cut(many), "bucket", "left").withColumns({"g0": F.coalesce("g0", F.lit(1)), "g1": F.coalesce("g1", F.lit(1))})
    mine = F.pmod(F.xxhash64("id", "half"), F.when(F.col("half") == 0, F.col("g0")).otherwise(F.col("g1")) if two_sided else F.col("g0")).cast("int")
    rows = rows.withColumn("s", mine)
    others = F.when(F.col("half") == 0, F.col("g1")).otherwise(F.col("g0")) if two_sided else F.col("g0")
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), others - 1)))
    if two_sided:
        i, j, half = F.when(F.col("half") == 0, F.col("s")).otherwise(F.col("t")), F.when(F.col("half") == 0, F.col("t")).otherwise(F.col("s")), F.col("half")
    else:
        i, j, half = F.least("s", "t"), F.greatest("s", "t"), (F.col("s") > F.col("t")).cast("int")
    return rows.select("bucket", i.alias("i"), j.alias("j"), half.alias("half"), "id", "v")


def _tiles(rows: tuple[DataFrame, DataFrame], each: Callable, schema: str, cap: int, two_sided: bool = False) -> DataFrame:
    """``each`` (ids, unit vectors, halves, diagonal) of every tile gives columns of the result, a slab of products at a time.
    Of sketches it gets the pairs (sketches, how far off they are)."""
    names = [x.split()[0] for x in schema.split(",")]
    sketched = rows[0].schema["v"].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            parts.clear()
            if t.num_rows < 2:
                return
            ids, half = t.column("id").combine_chunks(), t.column("half").to_numpy()
            diagonal = not two_sided and t.column("i")[0].as_py() == t.column("j")[0].as_py()
            if sketched:
                v = tuple(np.concatenate(x) for x in zip(*map(_unsketch, t.column("v").chunks), strict=True))
            else:
                v = np.concatenate([_unit(c) for c in t.column("v").chunks])
            del t  # of the tile only the unit vectors stay
            for cols in each(ids, v, half, diagonal):
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names)

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for x, y in zip(edges, edges[1:]):
                if last is not None and (key[x] != last).any():
                    yield from done(held)
                    held = []
                held.append(b.slice(x, y - x))
                last = key[x]
        yield from done(held)

    tiles = _dealt(*rows, cap, two_sided)
    return tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "half", "id").mapInArrow(run, schema)


def _hits(v: np.ndarray, half: np.ndarray, diagonal: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slabs of pairs (row, row, cosine) of a tile; rows of half 0 come first."""
    cut_at = len(v) if diagonal else int(np.searchsorted(half, 1))
    for a in range(0, cut_at, _SLAB):
        upto = min(cut_at, a + _SLAB)
        for first in range(a if diagonal else cut_at, len(v), _WIDE):
            s = v[a:upto] @ v[first : first + _WIDE].T
            at = np.flatnonzero(s >= least - 1e-9)
            if not len(at):
                continue
            x, y = divmod(at, s.shape[1])
            if diagonal:
                keep = y + first > x + a
                x, y = x[keep], y[keep]
            c = np.round(s[x, y], 12)
            ok = c >= least
            yield x[ok] + a, y[ok] + first, c[ok]


def _pairs(least: float):
    def each(ids, v, half, diagonal):
        for x, y, c in _hits(v, half, diagonal, least):
            for at in range(0, len(x), _ROWS):
                a, b = ids.take(pa.array(x[at : at + _ROWS])), ids.take(pa.array(y[at : at + _ROWS]))
                swap = pa.compute.greater(a, b)
                yield [pa.compute.if_else(swap, b, a), pa.compute.if_else(swap, a, b), c[at : at + _ROWS]]

    return each


def _candidates(least: float):
    """Pairs (a, b, sure) of a tile of sketches that may have cosine ``least``: what two sketches and the rounding of their
    products are off is allowed for, so none is missed, and those are sure that have it whatever they are off."""

    def each(ids, v, half, diagonal):
        near, off = v
        most = np.fmax.reduce(off, initial=0)  # a vector with NaN is near nothing and hides nothing
        rounding = 1e-6 + 1.5e-7 * near.shape[1]
        for x, y, c in _hits(near.astype(np.float32), half, diagonal, least - 2 * most - most**2 - rounding):
            slack = off[x] + off[y] + off[x] * off[y] + rounding
            maybe = c >= least - slack
            x, y, sure = x[maybe], y[maybe], (c >= least + slack)[maybe]
            for at in range(0, len(x), _ROWS):
                a, b = ids.take(pa.array(x[at : at + _ROWS])), ids.take(pa.array(y[at : at + _ROWS]))
                swap = pa.compute.greater(a, b)
                yield [pa.compute.if_else(swap, b, a), pa.compute.if_else(swap, a, b), sure[at : at + _ROWS]]

    return each


def _measured(pairs: DataFrame, vecs: DataFrame, least: float, kind: str) -> DataFrame:
    """(a, b, cosine) of the pairs (a, b) that have cosine ``least`` or more by their whole vectors (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = np.round(np.einsum("ij,ij->i", _unit(b.column(2)), _unit(b.column(3))), 12)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c)], ["a", "b", "cosine"]).filter(pa.array(c >= least))

    side = lambda c, v: vecs.select(F.col("id").alias(c), F.col("v").alias(v))
    return pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b").select("a", "b", "_x", "_y").mapInArrow(run, f"a {kind}, b {kind}, cosine double")


def _forest(least: float):
    """Of a tile's pairs only as many as join what they join: each of them links two groups that were apart."""

    def each(ids, v, half, diagonal):
        root, left, right = np.arange(len(v)), [], []
        for x, y, _ in _hits(v, half, diagonal, least):
            while len(x):
                rx, ry = root[x], root[y]
                apart = rx != ry
                x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
                high, one = np.unique(np.maximum(rx, ry), return_index=True)
                left.append(x[one])
                right.append(y[one])
                root[high] = np.minimum(rx, ry)[one]
                while (root[root] != root).any():
                    root = root[root]
        x, y = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (left, right))
        if len(x):
            yield [ids.take(pa.array(x)), ids.take(pa.array(y))]

    return each


def _best(s: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and cosines of a row's ``k`` best of at least ``floor``; of equal ones the first positions."""
    at = np.flatnonzero(s >= floor - 1e-9)
    if len(at) > k:
        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k] - 1e-9]
    c = np.round(s[at], 12)
    order = np.argsort(-c, kind="stable")[:k]
    order = order[c[order] >= floor]
    return at[order], c[order]


def _best_of_tile(k: int, least: float):
    def each(ids, v, half, diagonal):
        cut_at = int(np.searchsorted(half, 1))
        names = ids.to_pylist()
        for a in range(0, cut_at, _SLAB):
            query, found, cos = [], [], []
            s = v[a : min(cut_at, a + _SLAB)] @ v[cut_at:].T
            for q in np.flatnonzero(s.max(axis=1, initial=-2) >= least - 1e-9).tolist():
                at, c = _best(s[q], k + 1, least)  # one more, as the query itself may be among them
                for f, x in zip((at + cut_at).tolist(), c.tolist(), strict=True):
                    if names[f] != names[a + q]:
                        query.append(a + q)
                        found.append(f)
                        cos.append(x)
            if query:
                yield [ids.take(pa.array(query, pa.int64())), ids.take(pa.array(found, pa.int64())), pa.array(cos, pa.float64())]

    return each


def _vectors(df: DataFrame, id_col: str, vec: str, half: int = 0) -> DataFrame:
    floats = df.schema[vec].dataType.simpleString() == "array<float>"  # half the bytes to shuffle; products are of doubles anyway
    return df.where(F.size(vec) > 0).select(F.col(id_col).alias("id"), F.col(vec).cast(f"array<{'float' if floats else 'double'}>").alias("v"), F.lit(half).alias("half"))


def _in_buckets(x: DataFrame, n: int, dims: int, least: float, method: str, recall: float, seed: int, sketched: bool = False) -> tuple[tuple[DataFrame, DataFrame], PlanePlan | None]:
    """Rows of buckets, the same without vectors, and the plan of planes. Rows are made twice rather than written."""
    if method == "exact" or not n:
        rows = x.select(F.lit(0).cast("long").alias("bucket"), "id", "v", "half")
        return (rows, rows.select("bucket", "half")), None
    if method != "planes":
        raise ValueError("method is 'planes' or 'exact'")
    plan = plane_plan(least, recall, n)
    kinds = {c: x.schema[c].dataType.simpleString() for c in ("id", "v")}
    rows, sizes = _keys(dims, plan, seed, sketched)
    x = x.select("id", "v", "half")
    return (x.mapInArrow(rows, f"bucket long, id {kinds['id']}, v {'binary' if sketched else kinds['v']}, half int"), x.mapInArrow(sizes, "bucket long, half int")), plan


def _chance(plan: PlanePlan | None, c: Column) -> Column:
    """The chance that a pair of this cosine is found, as in ``PlanePlan.chance``."""
    if plan is None:
        return F.lit(1.0)
    return 1 - F.pow(1 - F.pow(1 - F.acos(F.least(c, F.lit(1.0))) / math.pi, F.lit(plan.planes)), F.lit(plan.tables))


def _distinct(vecs: DataFrame, id_col: str, vec: str, collapse: bool = True):
    """Vectors to compare, one for each different vector, and pairs of equal ones; how many vectors and their length."""
    x = cut(_vectors(vecs, id_col, vec))
    if not collapse:
        size = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
        return x, None, size["n"], size["dims"] or 1
    one = cut(x.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("half").alias("half")))
    size = one.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    same = x.join(one.where("n > 1").select("v", F.col("id").alias("a")), "v").where("id != a").select("a", F.col("id").alias("b"), F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double") * y).alias("q"))
    return one, same, size["n"], size["dims"] or 1


def nearby(vecs: DataFrame, id_col: str, vec: str, least: float, method: str = "planes", recall: float = 0.95, seed: int = 5, cap: int = TILE, collapse: bool = True) -> DataFrame:
    """Pairs (a, b, cosine, chance) of vectors with cosine at least ``least``, a < b; cosines have twelve decimals.

    ``exact`` compares all vectors in tiles: pairs of strips of ``cap`` vectors, each a matrix product in a task, so any
    number of vectors is spread over tasks of one size. ``planes`` compares vectors on the same side of all planes of one
    of several tables; their numbers follow from ``least``, ``recall`` and the number of vectors (``plane_plan``), and a
    bucket that is larger than a tile is cut into tiles; vectors go to their buckets as a byte a number, and pairs that are
    near by those are measured by whole vectors. ``chance`` is the probability with which a pair of that cosine
    is found, at least ``recall``: 1 divided by it weighs a pair in an unbiased count. Vectors must not be related to
    ``seed``.

    Of equal vectors only the least id is compared with others; the rest are paired with it alone, unless ``collapse`` is
    false: then all pairs count. Null and empty vectors pair with nothing, and neither do zero vectors.
    """
    one, same, n, dims = _distinct(vecs, id_col, vec, collapse)
    rows, plan = _in_buckets(one.select("id", "v", "half"), n, dims, least, method, recall, seed, sketched=True)
    kind = one.schema["id"].dataType.simpleString()
    if plan is None:
        found = _tiles(rows, _pairs(least), f"a {kind}, b {kind}, cosine double", cap)
    else:  # a pair may meet in several tables
        found = _measured(_tiles(rows, _candidates(least), f"a {kind}, b {kind}, sure boolean", cap).select("a", "b").distinct(), one, least, kind)
    if same is not None:
        found = found.unionByName(same.where("q > 0").select("a", "b", F.lit(1.0).alias("cosine")))
    return found.withColumn("chance", _chance(plan, F.col("cosine")))


def planes_pairs(vecs: DataFrame, id_col: str, vec: str, least: float, recall: float = 1.0, seed: int = 5, cap: int = TILE) -> DataFrame:
    """The pairs (a, b) of ``nearby``, without their cosines: whole vectors are asked only about pairs whose bytes leave it
    open whether they reach ``least``, so what is shuffled for pairs does not follow the vectors' length. They are all pairs,
    found without planes in tiles of vectors of a byte a number, unless the caller asks for a ``recall`` under 1."""
    one, same, n, dims = _distinct(vecs, id_col, vec)
    rows, plan = _in_buckets(one.select("id", "v", "half"), n, dims, least, "planes", recall, seed, sketched=True)
    kind = one.schema["id"].dataType.simpleString()
    found = same.where("q > 0").select("a", "b")
    if plan is None:  # there are no vectors
        return found
    near = cut(_tiles(rows, _candidates(least), f"a {kind}, b {kind}, sure boolean", cap).groupBy("a", "b").agg(F.max("sure").alias("sure")))
    return found.unionByName(near.where("sure").select("a", "b")).unionByName(_measured(near.where("not sure").select("a", "b"), one, least, kind).select("a", "b"))


def with_copies(pairs: DataFrame, vecs: DataFrame, id_col: str, vec: str) -> DataFrame:
    """Rows (a, b, n) for ``pairs`` among which equal vectors are collapsed: ``n`` pairs of vectors stand behind a pair of different
    ones, each copy with each; the pairs of a vector's own copies are one row (a, a). Cosines are kept."""
    x = _vectors(vecs, id_col, vec).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    x = cut(x.select("id", "n", (F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double") * y) > 0).alias("some")))
    side = lambda c: x.select(F.col("id").alias(c), F.col("n").alias(f"_{c}"))
    cosine = ["cosine"] if "cosine" in pairs.columns else []
    different = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *cosine, (F.col("_a") * F.col("_b")).alias("n"))
    own = x.where("n > 1 and some").select(F.col("id").alias("a"), F.col("id").alias("b"), *[F.lit(1.0).alias(c) for c in cosine], F.shiftright(F.col("n") * (F.col("n") - 1), 1).alias("n"))
    return different.unionByName(own)


def near_links(vecs: DataFrame, id_col: str, vec: str, least: float, method: str = "planes", recall: float = 0.95, seed: int = 5, cap: int = TILE) -> DataFrame:
    """Links (a, b) that join all vectors that the pairs of ``nearby`` join: of each tile's pairs no more than its rows, so
    that a large group of vectors near each other does not make all its pairs."""
    one, same, n, dims = _distinct(vecs, id_col, vec)
    rows, _ = _in_buckets(one.select("id", "v", "half"), n, dims, least, method, recall, seed)
    kind = one.schema["id"].dataType.simpleString()
    return _tiles(rows, _forest(least), f"a {kind}, b {kind}", cap).unionByName(same.where("q > 0").select("a", "b"))


def similar(queries: DataFrame, corpus: DataFrame, k: int, least: float, id_col: str = "vec_id", vec: str = "embedding", after: Column | None = None,
            method: str = "exact", recall: float = 0.95, seed: int = 5, cap: int = TILE) -> DataFrame:
    """(query, found, cosine, rank, chance): the best ``k`` vectors of the corpus for each query, at least ``least`` alike, other
    than the query's own id; of equal cosines (twelve decimals) the least id comes first.

    ``exact`` multiplies strips of queries by strips of the corpus, any number of either; each tile gives its own best
    ``k`` of a query. ``planes`` looks only at vectors that share a bucket with the query, see ``nearby``. ``after`` keeps
    rows of the corpus. Null, empty and zero vectors find and are found by nothing (unless ``least`` is 0 or less).
    """
    x, y = _vectors(queries, id_col, vec), _vectors(corpus if after is None else corpus.where(after), id_col, vec, 1)
    if x.schema["v"] != y.schema["v"]:
        x, y = (z.withColumn("v", F.col("v").cast("array<double>")) for z in (x, y))
    x = x.unionByName(y)
    if method == "planes":
        x = cut(x)
        size = x.agg(F.count_if(F.col("half") == 1).alias("n"), F.max(F.size("v")).alias("dims")).first()
    rows, plan = _in_buckets(x, size["n"] if method == "planes" else 1, size["dims"] or 1 if method == "planes" else 1, least, method, recall, seed)
    kind = corpus.schema[id_col].dataType.simpleString()
    found = _tiles(rows, _best_of_tile(k, least), f"query {kind}, found {kind}, cosine double", cap, two_sided=True)
    if plan is not None:
        found = found.groupBy("query", "found").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "found")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("chance", _chance(plan, F.col("cosine")))
