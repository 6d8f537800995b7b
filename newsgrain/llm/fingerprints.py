"""Document fingerprints: SimHash by SQL functions, and permuted block tables for the search within a Hamming radius."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

SHINGLE, BITS = 3, 128
_LANES = 32
_MASK = 0x0000000100000001  # two counters of 32 bits in a long


def _votes(hashed: str, weight: str) -> list[Column]:
    """Sums of signed bits, two bits of the hash a long: bit i in the lower half and bit i + 32 in the upper."""
    return [F.sum(F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(_MASK)) * F.col(weight)).alias(f"{hashed}{i}") for i in range(_LANES)]


def _signed(hashed: str) -> Column:
    """64 bits, set where votes for one outnumber those for nought, as 16 hexadecimal digits."""
    bits = F.lit(0).cast("long")
    for i in range(_LANES):
        low = F.col(f"{hashed}{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"{hashed}{i}", 32)
        one = F.lit(1).cast("long")
        for count, at in ((low, i), (high, i + 32)):
            bits = bits.bitwiseOR(F.when(2 * count > F.col("total"), F.shiftleft(one, at)).otherwise(F.lit(0).cast("long")))
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def simhash(texts: DataFrame, key: list[str], text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key columns, carried columns, fingerprint): ``key`` must tell different texts apart; ``carry`` names columns of
    longs that depend on the key.

    Terms are the runs of three words of the lower-cased text (shorter texts: all their words). A term votes with weight
    1 + its length in code points / 8, at most 8, once an occurrence, on 128 signed bits. Votes are summed where the text
    is and only the sums are shuffled, so a text of any length, or a term of any frequency, is one small row a text.
    Counters hold 2**32 weighted votes. Texts without words, null ones too, have fingerprint 0.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    w = texts.select(*key, *carry, words.alias("_w"))
    pad = F.concat("_w", F.array_repeat(F.lit(""), F.greatest(F.lit(SHINGLE) - F.size("_w"), F.lit(0))))
    w = w.select(*key, *carry, pad.alias("_w")).withColumn("_n", F.size("_w") - (SHINGLE - 1))
    terms = w.select(*key, *carry, F.inline(F.slice(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.col("_n")).alias("b"), F.slice("_w", 3, F.col("_n")).alias("c")), F.lit(1), F.col("_n"))))
    size = F.length("a") + F.length("b") + F.length("c")
    terms = terms.select(*key, *carry, F.xxhash64("a", "b", "c").alias("p"), F.xxhash64("c", "b", "a", F.lit(1)).alias("q"),
                         F.when(size == 0, 0).otherwise(F.least(F.lit(8), 1 + F.floor(size / 8))).cast("long").alias("weight"))
    votes = terms.groupBy(*key).agg(*[F.max(c).alias(c) for c in carry], F.sum("weight").alias("total"), *_votes("p", "weight"), *_votes("q", "weight"))
    return votes.select(*key, *carry, F.concat(_signed("p"), _signed("q")).alias("fingerprint"))


ZERO = "0" * (BITS // 4)


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints (hexadecimal) differ."""
    half = lambda x, i: F.conv(F.substring(x, 16 * i + 1, 16), 16, -10).cast("long")
    return sum((F.bit_count(half(a, i).bitwiseXOR(half(b, i))) for i in range(BITS // 64)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    return (1 - distance(a, b) / F.lit(float(BITS))).cast("double")


def within_radius(asked: DataFrame, corpus: DataFrame, radius: int = 7, extra: int = 2) -> DataFrame:
    """All pairs (asked, found, distance) of different fingerprints at most ``radius`` bits apart.

    ``asked`` and ``corpus`` have a column fingerprint; each different value is looked up once, so copies cost nothing.
    The bits are cut into ``radius + extra`` blocks. Two fingerprints within the radius agree on at least ``extra``
    blocks, so there is a table for every choice of ``extra`` blocks, keyed by them: the permutations of the block
    table. Every pair found is verified, and it is kept from the first table only that finds it.
    """
    blocks = radius + extra
    cuts = [round(i * BITS / 4 / blocks) for i in range(blocks + 1)]
    part = lambda i: F.substring("fingerprint", cuts[i] + 1, cuts[i + 1] - cuts[i])
    tables = list(combinations(range(blocks), extra))
    keys = F.explode(F.array(*[F.concat(F.lit(f"{k}:"), *[part(i) for i in t]) for k, t in enumerate(tables)])).alias("key")
    a = asked.select("fingerprint").where("fingerprint is not null").distinct().select(F.col("fingerprint").alias("asked"), keys)
    b = corpus.select("fingerprint").where("fingerprint is not null").distinct().select(F.col("fingerprint").alias("found"), keys)
    hits = a.join(b, "key").where(F.col("asked") != F.col("found")).withColumn("distance", distance(F.col("asked"), F.col("found")))
    return hits.where(F.col("distance") <= radius).select("asked", "found", "distance").distinct()


def next_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, next_id, need): the next smaller id (after the smallest: the largest) and how much of its text is asked for.

    Ids are range-partitioned, so each partition knows the successors of all but its last id; that one's is the first id
    of the next partition that has any. Only one row a partition passes through the step that links the partitions.
    """
    ids = (docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
           .agg(F.max(F.floor(F.length(F.coalesce(F.col(text_col), F.lit(""))) / 3)).alias("need")))
    ids = cut(ids.repartitionByRange(F.desc("doc_id")).withColumn("_p", F.spark_partition_id()))
    down = Window.partitionBy("_p").orderBy(F.desc("doc_id"))
    heads = ids.groupBy("_p").agg(F.max("doc_id").alias("_head"))
    every = Window.orderBy("_p")
    heads = heads.withColumn("_after", F.coalesce(F.lead("_head").over(every), F.first("_head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).drop("_head")
    return (ids.withColumn("_next", F.lead("doc_id").over(down)).join(heads, "_p")
            .select("doc_id", F.coalesce("_next", "_after").alias("next_id"), "need"))


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, edited, next_id) of the rows with an id, in partitions by it, and of those without one.

    In ``edited`` the last third of the text's code points (rounded down) is replaced by as many first ones of the next
    document's text, or by all of it if it is shorter. The next document is the one with the next smaller id; after the
    smallest comes the largest. If rows share an id, each is edited, and the least of their texts serves as the text of
    the next document. Rows with a null id are edited with nothing. Texts are shuffled once, and of the next texts only
    what is used: both readers of the exchange ask for the same rows under names of their own, so it is written once.
    """
    texts = docs.select(F.col(id_col).alias("_i"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    links = cut(next_ids(docs, id_col, text_col))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_id = texts.where("_i is not null").repartition(n, "_i")
    asked = links.select(F.col("next_id").alias("_i"), F.col("doc_id").alias("_for"), "need").hint("shuffle_hash")
    heads = (by_id.join(asked, "_i").select("_for", F.substr("_t", F.lit(1), F.col("need").cast("int")).alias("_head"), F.col("_i").alias("next_id"))
             .groupBy(F.col("_for").alias("_i")).agg(F.min(F.struct("_head", "next_id")).alias("_x")).select("_i", "_x._head", "_x.next_id"))
    named = by_id.join(heads.hint("shuffle_hash"), "_i", "left")
    nameless = texts.where("_i is null").select("_i", "_t", F.lit(None).cast("string").alias("_head"), F.col("_i").alias("next_id"))
    size = F.length("_t")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substr("_t", F.lit(1), size - third), F.substr(F.coalesce("_head", F.lit("")), F.lit(1), third))
    return tuple(x.select(F.col("_i").alias("doc_id"), F.col("_t").alias("text"), edited.alias("edited"), "next_id") for x in (named, nameless))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint) of every whole text; rows equal in id and text give one row. See ``simhash``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return simhash(rows.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"])


def _as_longs(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(f"_s{i}") for i in range(4)]


def _both_forms(pairs: DataFrame) -> DataFrame:
    """Fingerprints of texts and edited texts, a row for each different text of an id, in the partitions of ``pairs``."""
    pairs = pairs.select("doc_id", "next_id", F.xxhash64("text").alias("_h"), F.length("text").cast("long").alias("n_chars"), *_as_longs(F.sha2("edited", 256)),
                         F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("text")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("text")))).alias("f"))
    facts = ("n_chars", *[f"_s{i}" for i in range(4)])
    prints = simhash(pairs.select("doc_id", "next_id", "_h", *facts, "f.form", "f.text"), ["doc_id", "next_id", "_h", "form"], carry=facts)
    pick = lambda k: F.max(F.when(F.col("form") == k, F.col("fingerprint")))
    return prints.groupBy("doc_id", "next_id", "_h").agg(*[F.max(c).alias(c) for c in facts], pick(0).alias("fingerprint"), pick(1).alias("edited_fingerprint"))


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited forms, and how alike they and those of the next documents are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row a row of ``docs``:
    rows that are equal in id and text are hashed once and then repeated. An empty table gives an empty result. With one
    document the next is itself. Both forms of a text are built and hashed in one pass; what else is asked of them
    travels with the votes, as numbers.
    """
    named, nameless = edited_texts(docs, id_col, text_col)
    out = cut(_both_forms(named).unionByName(_both_forms(nameless)))
    again = (docs.groupBy(F.col(id_col).alias("_i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_t")).agg(F.count(F.lit(1)).alias("_times"))
             .where("_times > 1"))
    out = out.join(again, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_t")), "left")
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_times", F.lit(1).cast("long")))))
    after = out.groupBy(F.col("doc_id").alias("_n")).agg(F.min("fingerprint").alias("_next"))
    out = out.join(after, out.next_id == after["_n"], "left")
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"_s{i}")), 16, "0") for i in range(4)])
    return out.select("doc_id", "n_chars", sha.alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.coalesce("_next", F.lit(ZERO))).alias("near_next"))


def op1_fingerprints(spark, sf_dir):
    """Fingerprints of all texts and of their edited forms, and their likenesses."""
    return edit_study(table(spark, sf_dir, "documents"))


def op1_radius_search(spark, sf_dir):
    """Fingerprints at most 7 bits from those of the documents whose ids are divisible by 100, their own included, by
    the permuted block tables: (asked_id, fingerprint, found, distance, found_docs), where ``found_docs`` counts the
    documents that have it."""
    prints = cut(fingerprints(table(spark, sf_dir, "documents")))
    asked = prints.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("asked_id"), "fingerprint")
    counts = prints.groupBy(F.col("fingerprint").alias("found")).agg(F.count(F.lit(1)).alias("found_docs"))
    hits = within_radius(asked, prints).select(F.col("asked").alias("fingerprint"), "found", "distance")
    hits = hits.unionByName(asked.select("fingerprint", F.col("fingerprint").alias("found"), F.lit(0).alias("distance")).distinct())
    return asked.join(hits, "fingerprint").join(counts, "found").select("asked_id", "fingerprint", "found", "distance", "found_docs")
