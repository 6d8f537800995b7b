"""Collocations by dynamic itemset counting: phrases of all lengths are counted together in cyclic scans of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_place
from .common import bounded_batches, counted_cut, cut, table

LONGEST, LEAST, SHARDS, KEEP = 5, 100, 3, 2000
_FOLD = bytes(ord(".") if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STOP = b"."
_BLOCK = 12 << 20
_TURN = np.uint64(0x9E3779B97F4A7C15)
_BUCKET = 1 << 15  # bits in a row of bitmap_construct_agg
_MOST_BITS = 25
_AT_ONCE = 500_000
_NEVER = 255
_ROWS = "part string, k int, phrase string, c long"
_CODED = ["part", "size", "words", "hashes", "codes", "shard"]
_BLOCKS = "part string, size int, words binary, hashes binary, codes binary, shard int"
_FILE = 16  # blocks of a file: what a reader holds at once


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def tokens(data: bytes) -> list[bytes]:
    """Words of a folded text, with a stop between pieces."""
    return data.replace(_STOP, b" . ").split()


def blocks(data: bytes, size: int, ahead: int) -> Iterator[tuple[bytes, bytes]]:
    """A folded text in blocks that end between words, each with what follows up to ``ahead`` words of the same piece."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        ends = [p for p in (data.find(b" ", end), data.find(_STOP, end)) if p >= 0] if end < len(data) else []
        end = min(ends) if ends else len(data)
        more, reach = b"", 256
        while end < len(data):
            more = data[end : end + reach].split(_STOP, 1)[0]
            if len(more) < reach or end + reach >= len(data):  # the piece or the text ends here
                break
            if len(found := more.split(b" ")) > 2 * ahead + 2 and len(whole := [w for w in found[:-1] if w]) >= ahead:
                more = b" " + b" ".join(whole[:ahead])
                break
            reach *= 2
        yield data[at:end], more
        at = end


def _hash_words(words: list[bytes], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def phrase_hash(phrase: bytes, seed: int) -> int:
    """The hash of a phrase as ``count_grams`` has it."""
    words = _hash_words(phrase.split(b" "), seed)
    h = words[:1]
    for w in words[1:]:
        h = _mix(h * _TURN + w)
    return int(h[0])


def encode(data: bytes, more: bytes, seed: int) -> tuple[int, bytes, bytes, bytes] | None:
    """A block as numbers, so that no scan splits its text again: how many of its tokens are its own, its different words
    (space-joined; they hold no spaces), their hashes, and the tokens as places among the words; two bytes each where these do."""
    own = tokens(data)
    if not own:
        return None
    coded = pa.array(own + tokens(more), pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint16 if len(words) <= 1 << 16 else np.int32)
    return len(own), b" ".join(words), _hash_words(words, seed).tobytes(), codes.tobytes()


def count_grams(data: bytes, more: bytes, seed: int, t: int, marks: np.ndarray | None, shards: int, longest: int = LONGEST) -> list[tuple[int, pa.Array, np.ndarray]]:
    """What ``count_coded`` gives for a block that is still text."""
    coded = encode(data, more, seed)
    return count_coded(*coded, t, marks, shards, longest) if coded else []


def count_coded(size: int, words: bytes, hashes: bytes, codes: bytes, t: int, marks: np.ndarray | None, shards: int, longest: int = LONGEST) -> list[tuple[int, pa.Array, np.ndarray]]:
    """(k, phrases, counts) of a block at visit ``t``: in the first cycle its number of words (k 0) and each word (k 1); and the
    longer phrases that begin in it and are being counted: whose subphrases, and theirs, were all marked before ``t``, the
    last of them at most ``shards`` visits ago.

    Phrases are told apart by the numbers of their words, not by their hashes.
    """
    hashes = np.frombuffer(hashes, np.uint64)
    codes = np.frombuffer(codes, np.uint16 if len(hashes) <= 1 << 16 else np.int32).astype(np.int64)
    words = pa.array(words.split(b" "), pa.binary())
    stop = pa.compute.equal(words, _STOP).to_numpy(zero_copy_only=False)
    out = []
    if t < shards:
        times = np.bincount(codes[:size], minlength=len(words))
        times[stop] = 0
        some = np.flatnonzero(times)
        out += [(0, pa.array([b""], pa.binary()), times.sum(keepdims=True)), (1, words.take(pa.array(some)), times[some])]
    if marks is None:
        return out
    mask = np.uint64(len(marks) - 1)
    since = np.where(stop, _NEVER, marks[(hashes & mask).astype(np.int64)])[codes]
    at = np.flatnonzero(since != _NEVER)  # phrases of k - 1 words whose own subphrases are marked, where they begin
    h, since = hashes[codes[at]], since[at].astype(np.int64)
    for k in range(2, longest + 1):
        front = np.flatnonzero(at[1:] == at[:-1] + 1)  # the next one begins one word later: it is the other subphrase
        if not len(front):
            break
        start = np.maximum(since[front], since[front + 1])
        at, h = at[front], _mix(h[front] * _TURN + hashes[codes[at[front] + k - 1]])
        now = at[(start >= t - shards) & (at < size)]
        if len(now):
            number = codes[now]
            for j in range(1, k):
                number = pa.array(number * len(words) + codes[now + j]).dictionary_encode().indices.to_numpy().astype(np.int64)
            times = np.bincount(number)
            one = np.empty(len(times), np.int64)
            one[number] = now  # any place of a phrase
            texts = pa.compute.binary_join_element_wise(*[words.take(pa.array(codes[one + j])) for j in range(k)], b" ")
            out.append((k, texts, times))
        if k < longest:  # a place that another phrase marked before the subphrases were must not make an earlier start
            since = marks[(h & mask).astype(np.int64)].astype(np.int64)
            since = np.where(since == _NEVER, _NEVER, np.maximum(since, start))
            keep = since != _NEVER
            at, h, since = at[keep], h[keep], since[keep]
    return out


def _encoded(longest: int, block: int):
    """From rows (part, text, shard): rows of blocks (part, size, words, hashes, codes, shard), see ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(part: str, shard: int, data: bytes, more: bytes = b"") -> Iterator[pa.RecordBatch]:
            coded = encode(data, more, xxhash.xxh64_intdigest(part.encode()))
            if coded:
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([coded[0]], pa.int32()), *[pa.array([c], pa.binary()) for c in coded[1:]], pa.array([shard], pa.int32())], _CODED)

        held, sizes = {}, {}
        for b in batches:
            for part, text, shard in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = (text or b"").translate(_FOLD)
                if len(data) > block:
                    for x in blocks(data, block, longest - 1):
                        yield from told(part, shard, *x)
                    continue
                key = part, shard
                held.setdefault(key, []).append(data)
                sizes[key] = sizes.get(key, 0) + len(data) + 1
                if sizes[key] >= block or sum(sizes.values()) >= 2 * block:
                    full = max(sizes, key=sizes.get)
                    sizes.pop(full)
                    yield from told(*full, _STOP.join(held.pop(full)))
        for key, texts in held.items():
            yield from told(*key, _STOP.join(texts))

    return run


def _scan(t: int, step, shards: int, longest: int):
    """From rows of blocks: counts of a shard at visit ``t``, see ``count_coded``; ``step`` is a broadcast array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(step.value, np.uint8) if step is not None else None
        for b in batches:
            for i in range(b.num_rows):
                part, *coded = [c[i].as_py() for c in b.columns]
                for k, texts, times in count_coded(*coded, t, marks, shards, longest):
                    n = len(times)
                    yield pa.RecordBatch.from_arrays([pa.repeat(part, n), pa.repeat(pa.scalar(k, pa.int32()), n), texts.cast(pa.string()), pa.array(times, pa.int64())], ["part", "k", "phrase", "c"])

    return run


_KEY = ["part", "k", "phrase"]


class _Visits:
    """Counts of each visit, as tables in two parts: phrases that one visit alone shows to be worth adding up, and others."""

    def __init__(self, spark, least: int, shards: int):
        self.spark, self.least, self.shards, self.places = spark, least, shards, []

    def add(self, found: DataFrame) -> None:
        """A phrase that occurs ``least`` times in a cycle occurs ``least / shards`` times in one of its shards."""
        found = found.withColumn("hot", (F.col("k") == 0) | (F.col("c") * self.shards >= self.least))
        self.places.append(new_place(self.spark))
        found.write.partitionBy("hot").parquet(self.places[-1])

    def frequent(self, since: int = 0) -> DataFrame:
        """(part, k, phrase, c): what occurs ``least`` times or more in the visits from ``since`` on, and rows with k 0."""
        every = None
        for place in self.places[since:]:
            x = self.spark.read.schema(f"{_ROWS}, hot boolean").parquet(place)
            every = x if every is None else every.unionByName(x)
        hot = every.where("hot").drop("hot")
        names, n = counted_cut(hot.select(*_KEY).distinct())
        if n <= _AT_ONCE:
            names = F.broadcast(names)
        found = hot.unionByName(every.where("not hot").drop("hot").join(names, _KEY, "left_semi"))
        return found.groupBy(*_KEY).agg(F.sum("c").alias("c")).where((F.col("k") == 0) | (F.col("c") >= self.least))


def _bits(reached: DataFrame, bits: int) -> np.ndarray:
    """The places of the hashes of ``reached`` among 2**bits, at most 2**10 rows of 4 KB on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [phrase_hash(p.encode(), xxhash.xxh64_intdigest(x.encode())) for x, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], ["h"])

    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = reached.select("part", "phrase").mapInArrow(run, "h long").groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(_BUCKET - 1))).alias("set")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["bucket"] * _BUCKET // 8 : (r["bucket"] + 1) * _BUCKET // 8] = np.frombuffer(bytes(r["set"]), np.uint8)
    return np.unpackbits(out, bitorder="little").astype(bool)


def frequent_phrases(docs: DataFrame, part: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, block: int = _BLOCK) -> DataFrame:
    """(part, k, phrase, a): all phrases of up to ``longest`` words that occur ``least`` times or more in a part; the row with
    k 0 has the number of words.

    Texts (null: empty; A-Z lower-cased) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words; phrases do not
    leave a piece, and overlapping occurrences count. A null part is ``und``.

    Dynamic itemset counting: documents are dealt once into ``shards``, as blocks of numbered words, which are scanned in a cycle. Words are counted from
    the first scan on; a longer phrase from the scan after both its subphrases (all but the last, all but the first word)
    have reached ``least`` in what was counted so far, whatever its length, until it has seen each shard once. Scans end
    when no phrase is counted any more: after at most ``longest`` cycles.

    When a phrase reached ``least`` is marked at the place of its hash in an array of up to 2**25 bytes, fixed after the
    first scan, which every scan reads. Where places collide, a phrase starts earlier, or phrases are counted that need
    not be; a phrase's start is the same in all scans, so every phrase sees one full cycle and counts are exact. Phrases
    are told apart by their words. Counts of a scan are shuffled and written once; of what a scan counts, only phrases
    with a fair share of ``least`` in some scan are added up. The driver sees numbers of rows and sets of bits. Long
    texts are counted in blocks. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    place = new_place(spark)
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("und")).alias("part"), F.col(text_col).cast("string").alias("text"), (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
    rows.mapInArrow(_encoded(longest, block), _BLOCKS).write.option("maxRecordsPerFile", _FILE).partitionBy("shard").parquet(place)
    rows = spark.read.schema(_BLOCKS).parquet(place)
    if longest * shards >= _NEVER:
        raise ValueError("longest * shards must be under 255")
    visits, marks, step, t, last = _Visits(spark, least, shards), None, None, 0, shards - 1
    while t <= last:
        found = rows.where(F.col("shard") == t % shards).select(*_CODED[:-1]).mapInArrow(_scan(t, step, shards, longest), _ROWS)
        visits.add(found.groupBy(*_KEY).agg(F.sum("c").alias("c")))
        reached = visits.frequent(max(0, t - shards + 1)).where(F.col("k").between(1, longest - 1))
        if marks is None:
            bits = min(_MOST_BITS, max(16, (512 * reached.count()).bit_length()))
            marks = np.full(1 << bits, _NEVER, np.uint8)
        new = _bits(reached, bits) & (marks == _NEVER)
        if new.any():
            marks[new] = t
            last = max(last, t + shards)
        if step is not None:
            step.destroy()
        step = spark.sparkContext.broadcast(marks.tobytes())
        t += 1
    return visits.frequent().select("part", "k", "phrase", F.col("c").alias("a"))


def collocations(docs: DataFrame, part: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, keep: int = KEEP, shards: int = SHARDS) -> DataFrame:
    """(part, rank, phrase, a, l, r, n, score): the ``keep`` best phrases of each part; see ``frequent_phrases``.

    Cut after its first words, a phrase has the score floor(1000 * a * n / (l * r)), by exact decimals of 38 digits; the
    lowest-scoring cut counts, the first of equal ones. A phrase that lies in a longer one of the same count is dropped:
    counts fall with the length, so one word more is enough to look at. Ranks are by score, count and phrase (bytes);
    each part is cut to its best in 64 buckets before they meet.
    """
    every = cut(frequent_phrases(docs, part, text_col, least, longest, shards))
    count = every.where("k > 0").select("part", "phrase", "a")
    phrases = every.where("k > 1")
    inside = phrases.where("k > 2").select("part", "a", F.explode(F.expr("array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k))")).alias("phrase"))
    inside = inside.groupBy("part", "phrase").agg(F.max("a").alias("around"))
    kept = phrases.join(inside, ["part", "phrase"], "left").where("around is null or around < a")
    cuts = kept.select("part", "phrase", "a", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("at"))
    cuts = cuts.withColumns({"front": F.expr("substring_index(phrase, ' ', at)"), "back": F.expr("substring_index(phrase, ' ', at - k)")})
    cuts = cuts.join(count.select("part", F.col("phrase").alias("front"), F.col("a").alias("l")), ["part", "front"])
    cuts = cuts.join(count.select("part", F.col("phrase").alias("back"), F.col("a").alias("r")), ["part", "back"])
    total, parts = counted_cut(every.where("k = 0").select("part", F.col("a").alias("n")))
    scored = cuts.join(F.broadcast(total) if parts <= 100_000 else total, "part")
    scored = scored.withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
    best = scored.groupBy("part", "phrase").agg(F.min(F.struct("score", "at", "l", "r", "a", "n")).alias("x")).select("part", "phrase", "x.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= keep)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    return best.select("part", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    """The 2,000 best phrases of each language."""
    return collocations(table(spark, sf_dir, "documents")).withColumnRenamed("part", "lang")


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
d AS (SELECT DISTINCT b.lang, b.phrase FROM c b JOIN c x ON b.lang = x.lang AND x.k > b.k AND 100 * x.a >= 100 * b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')),
s AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n.n, j, CAST((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM c JOIN range(1, 5) AS t(j) ON j < c.k JOIN n ON n.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b ANTI JOIN d USING (lang, phrase) QUALIFY rank <= 2000
"""
