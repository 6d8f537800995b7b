"""Token counts without moving pre-tokens: a broadcast table of frequent ones, then a cache in each worker."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

VOCABULARY = "word_bpe_49k.json"
#: Texts of these characters only are normalised by lower-casing alone; any other goes to the library whole.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(161, 173), *range(174, 256)])
#: The split pattern of the vocabulary file's pre-tokenizer.
_PRE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return table


def plain(text: str) -> bool:
    """Whether a text may be looked up by chunks: nothing but common Latin characters, and no start of a special string."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not raw.translate(None, _PLAIN) and "<|" not in text


class WordCoder:
    """Ids of texts by white-space chunks: a chunk's ids do not depend on its neighbours, so they can be looked up.

    A chunk is looked up whole, then by its pre-tokens, and only an unknown pre-token is encoded. A full cache (``keep``
    entries) becomes the old one and gives way to an empty one, into which old entries are taken as they are met; so
    either cache holds at most twice ``keep``.
    """

    def __init__(self, path: str, keep: int = 600_000, lengths: dict[str, int] | None = None):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.find = regex.compile(_PRE).findall
        self.letters, self.keep = _byte_letters(), keep
        self.four = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.frequent = lengths or {}
        self.chunks: dict = {}
        self.old_chunks: dict = {}
        self.pre: dict[str, bytes] = {}
        self.old_pre: dict[str, bytes] = {}

    def _pre_ids(self, word: str) -> bytes:
        got = self.pre.get(word)
        if got is None:
            got = self.old_pre.get(word)
            if got is None:
                spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
                four = self.four
                got = b"".join([four[t.id] for t in self.model.tokenize(spelt)])
            if len(self.pre) >= self.keep:
                self.old_pre, self.pre = self.pre, {}
            self.pre[word] = got
        return got

    def _split(self, low: str) -> list[str]:
        if low.isalpha():
            return [low]
        if low[-1] in ",." and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.find(low)

    def _keep(self, chunk: str, got):
        if len(self.chunks) >= self.keep:
            self.old_chunks, self.chunks = self.chunks, {}
        self.chunks[chunk] = got
        return got

    def chunk_ids(self, chunk: str) -> bytes:
        return self._keep(chunk, self.old_chunks.get(chunk) or b"".join([self._pre_ids(w) for w in self._split(chunk)]))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids, as the library gives them without special tokens added."""
        if not plain(text):
            return b"".join([self.four[i] for i in self.whole.encode(text, add_special_tokens=False).ids])
        known, own = self.chunks.get, self.chunk_ids
        return b"".join([known(c) or own(c) for c in text.lower().split()])

    def chunk_length(self, chunk: str) -> int:
        return self._keep(chunk, self.old_chunks.get(chunk) or sum([len(self._pre_ids(w)) for w in self._split(chunk)]) // 4)

    def count(self, text: str) -> int:
        if not plain(text):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        first, second, own = self.frequent.get, self.chunks.get, self.chunk_length
        return sum([first(c) or second(c) or own(c) for c in text.lower().split()])


def frequent_chunks(docs: DataFrame, text_col: str = "text", top: int = 65_536, per_task: int = 8_192, held: int = 200_000) -> DataFrame:
    """The most frequent white-space chunks of all texts, lower-cased as they are looked up (chunk, n), at most ``top`` rows.

    Each task counts its own texts and hands on its ``per_task`` largest counts; the chunks themselves are never
    shuffled. A task that holds more than ``held`` different chunks drops its rarest: the table only saves work, so a
    missing entry costs time and never changes a count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(t.lower().split())
            if len(seen) > held:
                seen = Counter(dict(seen.most_common(held // 4)))
        best = [x for x in seen.most_common(per_task) if x[1] > 1 and len(x[0]) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["chunk", "n"])

    bounded_batches(docs.sparkSession)
    return (docs.select(F.col(text_col).alias("t")).mapInArrow(count, "chunk string, n long")
            .groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(top))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 path: str | None = None, top: int = 65_536) -> DataFrame:
    """Tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit).

    First tier: the lengths of up to ``top`` frequent chunks, counted over all texts and broadcast (bounded by ``top``).
    Second tier: a cache in each worker for what that table misses. Nothing but the bounded summaries is shuffled.
    Null and empty texts have 0 bytes and 0 tokens; rows keep their multiplicity; ids may be null or repeat; an empty
    table gives an empty result. Only the two named columns are read.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    coder = WordCoder(path)
    words = [r[0] for r in frequent_chunks(docs, text_col, top).select("chunk").collect()]
    lengths = spark.sparkContext.broadcast({w: coder.count(w) for w in words if plain(w)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(path, lengths=lengths.value)
        for b in batches:
            n = [coder.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir):
    """Tokens of every whole text."""
    return token_counts(table(spark, sf_dir, "documents"))
