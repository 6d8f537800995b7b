"""Groups whose making depends on order: micro-clusters of a candidate, verified and manual splits of a cluster."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import EVENT, PAIR

#: Likenesses are compared with thresholds after rounding, so that sums of weights do not depend on their order.
_PLACES = 9


def _sets(lists: list) -> np.ndarray:
    """A row of marks for each list of values, a column a value."""
    names: dict = {}
    at = [(i, names.setdefault(v, len(names))) for i, x in enumerate(lists) for v in (x or ()) if v is not None]
    out = np.zeros((len(lists), max(1, len(names))), np.float32)
    if at:
        out[tuple(np.array(at).T)] = 1
    return out


def _jaccard(m: np.ndarray, i: int) -> np.ndarray:
    """Of row ``i`` with every row; 0 where both are empty."""
    both = m @ m[i]
    size = m.sum(axis=1)
    union = size + size[i] - both
    return np.divide(both, union, out=np.zeros(len(m)), where=union > 0, dtype=np.float64)


def _codes(values: list) -> np.ndarray:
    """Equal values have equal numbers; nulls have -1."""
    names: dict = {}
    return np.array([-1 if v is None else names.setdefault(v, len(names)) for v in values])


class Block:
    """Rows of one block, by column, and likenesses of one of them to all."""

    def __init__(self, cols: dict[str, list]):
        self.cols, self.n, self.made = cols, len(next(iter(cols.values()))), {}

    def made_once(self, name: str, make: Callable):
        if name not in self.made:
            self.made[name] = make(self.cols[name])
        return self.made[name]

    def jaccard(self, name: str, i: int) -> np.ndarray:
        return _jaccard(self.made_once(name, _sets), i)

    def cosine(self, name: str, i: int) -> np.ndarray:
        def unit(vectors: list) -> np.ndarray:
            size = max((len(v) for v in vectors if v is not None), default=0)
            x = np.array([v if v is not None and len(v) == size else [0.0] * size for v in vectors], np.float64).reshape(len(vectors), size)
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

        x = self.made_once(name, unit)
        return x @ x[i]

    def same(self, name: str, i: int) -> np.ndarray:
        c = self.made_once(name, _codes)
        return (c == c[i]) & (c[i] >= 0)

    def missing(self, name: str) -> np.ndarray:
        return self.made_once(name, _codes) < 0

    def places(self, i: int) -> np.ndarray:
        """0.5 if either is unknown, 1 if equal, 0.8 if one holds the other."""
        def fold(values: list) -> list:
            return [v.strip().lower() if v is not None else "" for v in values]

        x = self.made_once("location", fold)
        y = x[i]
        return np.array([0.5 if not v or not y else 1.0 if v == y else 0.8 if v in y or y in v else 0.0 for v in x])

    def events(self, i: int) -> np.ndarray:
        """Likeness of events, 0 to 0.9, as in ``scoring.event_similarity``; 0 where there is none (no kind)."""
        kind = np.where(self.same("kind", i), 1.0, np.where(self.same("parent", i), 0.5, 0.0))
        gap = self.missing("date") | self.missing("date")[i]
        day = np.where(gap, 0.5, self.same("date", i).astype(float))
        s = EVENT["actors"] * self.jaccard("actors", i) + EVENT["targets"] * self.jaccard("targets", i) + EVENT["place"] * self.places(i) + EVENT["kind"] * kind + EVENT["date"] * day
        return np.where(self.missing("kind") | self.missing("kind")[i], 0.0, s)

    def pairs(self, i: int) -> np.ndarray:
        """Likeness of articles, as in ``scoring.pair_score``."""
        source = np.where(self.same("source", i), 0.8, 1.0)
        return PAIR["embedding"] * self.cosine("vector", i) + PAIR["event"] * self.jaccard("events", i) + PAIR["entity"] * self.jaccard("entities", i) + PAIR["temporal"] * 0.95 + PAIR["source"] * source


def _by_block(df: DataFrame, block: str, order: list[str], cols: dict[str, str], each: Callable[[Block, list], dict[str, list]], schema: str) -> DataFrame:
    """``each`` of every block, whose rows come in order. Blocks come one after the other, so a task holds one at a time and
    there is no call a block. A choice that depends on all choices before it is made in one task: blocks (a candidate, a
    story, a cluster) must be small by the way they are chosen."""
    names = [x.split()[0] for x in schema.split(", ")]
    extra = [c for c in order if c not in cols.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        key, target = None, None
        for b in batches:
            if target is None:
                kinds = {block: b.schema.field(block).type, "id": b.schema.field(cols["id"]).type}
                target = pa.schema([(n, _TYPES[k.split()[1]] if k.split()[1] in _TYPES else kinds[block if n == block else "id"]) for n, k in zip(names, schema.split(", "), strict=True)])
            keys = b.column(b.schema.get_field_index(block)).to_pylist()
            got = {k: b.column(b.schema.get_field_index(c)).to_pylist() for k, c in cols.items()}
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else []
            rows: dict[str, list] = {n: [] for n in names}  # of all blocks that end in this batch
            for x, y in zip(edges, edges[1:]):
                if held and keys[x] == key:
                    for k, v in got.items():
                        held[k] += v[x:y]
                    continue
                if held:
                    for n, v in each(Block(held), [key] * len(held["id"])).items():
                        rows[n] += v
                held, key = {k: v[x:y] for k, v in got.items()}, keys[x]
            if rows[names[0]]:
                yield pa.RecordBatch.from_pydict(rows, schema=target)
        if held:
            out = each(Block(held), [key] * len(held["id"]))
            yield pa.RecordBatch.from_pydict({n: out[n] for n in names}, schema=target)

    kinds = {c: df.schema[c].dataType.simpleString() for c in (block, cols["id"])}
    told = ", ".join(f"{n} {t if t in _TYPES else kinds[block if n == block else cols['id']]}" for n, t in (x.split() for x in schema.split(", ")))
    rows = df.select(*dict.fromkeys([block, *cols.values(), *extra])).repartition(block).sortWithinPartitions(block, *order)
    return rows.mapInArrow(run, told)


_TYPES = {"int": pa.int32(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def micro_clusters(df: DataFrame, block: str, order: list[str], cols: dict[str, str], least: float = 0.70, most_entities: int = 5) -> DataFrame:
    """(block, id, leader, part, event, centroid, entities): articles of a block in order. The first that has no group leads
    one, and takes all others without one whose pair score with it is at least ``least``.

    ``cols`` names the columns id, vector, events (kinds), entities, source. Of a group the leader represents: its row
    carries the group's mean vector, the first ``most_entities`` of its entities by name and the leader's first kind of
    event; members have nulls there. Groups are numbered from 0.
    """

    def each(b: Block, keys: list) -> dict[str, list]:
        leader, part = np.full(b.n, -1), np.full(b.n, -1)
        facts: dict[str, list] = {"event": [None] * b.n, "centroid": [None] * b.n, "entities": [None] * b.n}
        groups = 0
        for i in range(b.n):
            if leader[i] >= 0:
                continue
            mine = (leader < 0) & (np.round(b.pairs(i), _PLACES) >= least)
            mine[:i] = False
            mine[i] = True
            leader[mine], part[mine] = i, groups
            groups += 1
            at = np.flatnonzero(mine)
            vectors = [v for v in (b.cols["vector"][k] for k in at) if v]
            facts["centroid"][i] = np.mean(vectors, axis=0).tolist() if vectors else None
            facts["entities"][i] = sorted({e for k in at for e in (b.cols["entities"][k] or ()) if e is not None})[:most_entities]
            facts["event"][i] = (b.cols["events"][i] or [None])[0]
        ids = b.cols["id"]
        return {block: keys, "id": ids, "leader": [ids[k] for k in leader], "part": part.tolist(), **facts}

    return _by_block(df, block, order, cols, each, f"{block} block, id id, leader id, part int, event string, centroid array<double>, entities array<string>")


def _first_fit(b: Block, score: Callable[[int], np.ndarray], fits: Callable[[float], bool], doubt: Callable[[float], bool]) -> tuple[np.ndarray, list[str]]:
    """Rows in order, each to the first part with whose members its mean likeness fits, or to a part of its own; and whether
    some likeness that decided was in doubt."""
    part, sizes, status = np.full(b.n, -1), [], []
    for i in range(b.n):
        s = score(i)
        sums = np.bincount(part[:i], s[:i], len(sizes))
        unsure, chosen = False, len(sizes)
        for k, mean in enumerate(np.round(sums / np.maximum(sizes, 1), _PLACES).tolist() if sizes else []):
            unsure |= doubt(mean)
            if fits(mean):
                chosen = k
                break
        if chosen == len(sizes):
            sizes.append(0)
        part[i] = chosen
        sizes[chosen] += 1
        status.append("needs_review" if unsure else "auto")
    return part, status


_SMALL, _MOST = 32, 200_000  # rows of a block that is compared row by row; likenesses a task keeps


class _Likeness:
    """``Block.events`` (and a tenth of the overlap of entities) of two rows at a time: in a small block that costs less than
    arrays. Rows of equal contents have one number, and what is known of two numbers is not computed again."""

    def __init__(self, names: tuple[str, ...], entities: bool):
        self.names, self.entities = names, entities
        self.number, self.rows, self.known = {}, [], {}

    def numbers(self, rows: list[str]) -> list[int]:
        """Of rows as ``_as_block`` has them."""
        if len(self.known) > _MOST or len(self.rows) > _MOST:
            self.number, self.rows, self.known = {}, [], {}
        out = []
        for row in rows:
            n = self.number.get(row)
            if n is None:
                n = self.number[row] = len(self.rows)
                r = {k: v for k, v in zip(self.names, json.loads(row), strict=True)}
                sets = {k: {v for v in r[k] or () if v is not None} for k in ("actors", "targets", "entities") if k in r}
                self.rows.append(r | sets | {"location": (r["location"] or "").strip().lower()})
            out.append(n)
        return out

    def block(self, rows: list[str]) -> Block:
        return Block(dict(zip(self.names, map(list, zip(*map(json.loads, rows), strict=True)), strict=True)))

    def __call__(self, i: int, j: int) -> float:
        at = (i, j)
        s = self.known.get(at)
        if s is None:
            s = self.known[at] = self._of(self.rows[i], self.rows[j])
        return s

    def _of(self, x: dict, y: dict) -> float:
        if x["kind"] is None:
            return -1.0
        overlap = lambda k: len(x[k] & y[k]) / len(x[k] | y[k]) if x[k] or y[k] else 0.0
        s = 0.0
        if y["kind"] is not None:
            kind = 1.0 if x["kind"] == y["kind"] else 0.5 if x["parent"] is not None and x["parent"] == y["parent"] else 0.0
            day = 0.5 if x["date"] is None or y["date"] is None else float(x["date"] == y["date"])
            p, q = x["location"], y["location"]
            place = 0.5 if not p or not q else 1.0 if p == q else 0.8 if p in q or q in p else 0.0
            s = EVENT["actors"] * overlap("actors") + EVENT["targets"] * overlap("targets") + EVENT["place"] * place + EVENT["kind"] * kind + EVENT["date"] * day
        return s + 0.10 * overlap("entities") if self.entities else s


def _as_block(df: DataFrame, block: str, order: list[str], cols: dict[str, str], names: tuple[str, ...]) -> tuple:
    """What ``_by_block`` takes, with a row's contents as one text (JSON, a list in the order of ``names``): Python takes one value
    a row, and reads each different one once."""
    parts = [F.to_json(F.array(F.col(cols[n]))) for n in names]
    inner = [F.substring(p, F.lit(2), F.length(p) - 2) for p in parts]
    return df.withColumn("_row", F.concat(F.lit("["), F.concat_ws(",", *inner), F.lit("]"))), block, order, {"id": cols["id"], "row": "_row"}


def _first_fit_small(likeness: _Likeness, rows: list[int], fits: Callable[[float], bool], doubt: Callable[[float], bool]) -> tuple[list[int], list[str]]:
    """What ``_first_fit`` gives, with plain loops."""
    part, sizes, status = [], [], []
    for i, x in enumerate(rows):
        sums = [0.0] * len(sizes)
        for j in range(i):
            sums[part[j]] += likeness(x, rows[j])
        unsure, chosen = False, len(sizes)
        for k, total in enumerate(sums):
            mean = round(total / sizes[k], _PLACES)
            unsure |= doubt(mean)
            if fits(mean):
                chosen = k
                break
        if chosen == len(sizes):
            sizes.append(0)
        part.append(chosen)
        sizes[chosen] += 1
        status.append("needs_review" if unsure else "auto")
    return part, status


_EVENT_COLS = ("kind", "parent", "actors", "targets", "location", "date")


def split_clusters(df: DataFrame, cluster: str, order: list[str], cols: dict[str, str], auto: float = 0.90, review: float = 0.70, sure: float = 0.80) -> DataFrame:
    """(cluster, id, part, status): verified parts of each cluster. A row joins the first part whose mean likeness of events, and
    a tenth of whose mean overlap of entities, make ``auto``; from ``review`` up the match needs review, and is made if it
    reaches ``sure``. A row without an event (null kind) joins nothing.

    ``cols`` names id, kind, parent, actors, targets, location, date and entities.
    """

    likeness = _Likeness((*_EVENT_COLS, "entities"), True)
    fits, doubt = lambda m: m >= min(auto, sure), lambda m: review <= m < auto

    def each(b: Block, keys: list) -> dict[str, list]:
        if b.n <= _SMALL:
            part, status = _first_fit_small(likeness, likeness.numbers(b.cols["row"]), fits, doubt)
            return {cluster: keys, "id": b.cols["id"], "part": part, "status": status}
        x = likeness.block(b.cols["row"])
        none = x.missing("kind")
        score = lambda i: np.where(none[i], -1.0, x.events(i) + 0.10 * x.jaccard("entities", i))
        part, status = _first_fit(x, score, fits, doubt)
        return {cluster: keys, "id": b.cols["id"], "part": part.tolist(), "status": status}

    return _by_block(*_as_block(df, cluster, order, cols, likeness.names), each, f"{cluster} block, id id, part int, status string")


def split_story(df: DataFrame, story: str, order: list[str], cols: dict[str, str], least: float = 0.80) -> DataFrame:
    """(story, id, part): a story split by hand. A row joins the first part whose mean likeness of events is at least
    ``least``; if all are one part, the first row leaves it. Stories of one row stay whole. ``cols`` as in
    ``split_clusters``, without entities."""

    likeness = _Likeness(_EVENT_COLS, False)
    fits, doubt = lambda m: m >= least, lambda m: False

    def each(b: Block, keys: list) -> dict[str, list]:
        if b.n <= _SMALL:
            part = _first_fit_small(likeness, likeness.numbers(b.cols["row"]), fits, doubt)[0]
        else:
            x = likeness.block(b.cols["row"])
            none = x.missing("kind")
            part = _first_fit(x, lambda i: np.where(none[i], -1.0, x.events(i)), fits, doubt)[0].tolist()
        if b.n > 1 and not any(part):
            part = [0] + [1] * (b.n - 1)
        return {story: keys, "id": b.cols["id"], "part": part}

    return _by_block(*_as_block(df, story, order, cols, likeness.names), each, f"{story} block, id id, part int")
