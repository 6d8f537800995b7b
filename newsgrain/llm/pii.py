"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that reveal them. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: In the order in which spans that begin together are listed.
KINDS = ("email", "ip", "card", "phone")
# The patterns find what the plain ones find, but cannot run long: runs are taken whole (possessive), and a run is entered
# at its first character only. An address may begin right after the one before it, hence \G.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SPAN = "array<struct<start:int,end:int,kind:int>>"


def _no_spans() -> Column:
    return F.array().cast(_SPAN)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    each = F.split(F.reverse(digits), "")
    worth = F.transform(each, lambda d, i: F.when(i % 2 == 0, F.coalesce(d.try_cast("int"), F.lit(0)))
                        .otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(d.try_cast("int"), F.lit(0)) + 1)))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + v) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # a part of over 3 digits may still be small: 0001
        return F.forall(F.split(found, r"\."), lambda p: F.regexp_replace(p, r"\A0+(?=[0-9])", "").rlike(r"\A([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    n = F.length(_digits(found))
    if kind == "card":
        return n.between(12, 19) & luhn(F.when(n <= 19, _digits(found)).otherwise(F.lit("1")))
    return n.between(9, 15)


def running(sizes: Column, block: int = 64) -> Column:
    """For each element of an array the sum of those before it, by blocks, so that long arrays take no quadratic time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, v: a + v)
    inner = F.transform(blocks, lambda xs: F.transform(xs, lambda _, i: total(F.slice(xs, F.lit(1), i))))
    base = F.aggregate(F.transform(blocks, total), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
                       lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
    return F.when(F.size(sizes) > 0, F.flatten(F.zip_with(inner, base, lambda xs, b: F.transform(xs, lambda x: x + b)))).otherwise(F.array().cast("array<int>"))


def kind_spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of one kind that hold, as (start, end, kind) in code points.

    The pieces between matches give the places: a match begins after all pieces and matches before it.
    """
    pattern, need = PATTERNS[kind], NEEDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    before = running(F.zip_with(gaps, found, lambda g, m: g + F.coalesce(F.length(m), F.lit(0))))
    begin = F.zip_with(before, gaps, lambda b, g: b + g)
    spans = F.filter(F.zip_with(found, begin, lambda m, s: F.struct(m.alias("m"), s.alias("s"))), lambda x: x["m"].isNotNull() & _holds(kind, x["m"]))
    spans = F.transform(spans, lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), F.lit(KINDS.index(kind)).alias("kind")))
    tried = text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}") if kind == "card" else F.contains(text, F.lit(need))
    if kind == "ip":
        tried = tried & text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    return F.when(F.coalesce(tried, F.lit(False)), spans.cast(_SPAN)).otherwise(_no_spans())


def base_spans(text: Column) -> Column:
    """The spans of all kinds by start, then in the order of ``KINDS``."""
    whole = F.concat(*[kind_spans(text, k) for k in KINDS])
    return F.transform(F.array_sort(F.transform(whole, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))),
                       lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def spell(spans: Column) -> Column:
    """``kind:start:end``, comma-joined; the kind after the patterns' is "term"."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def near_terms(found: DataFrame, reach: int = 48) -> DataFrame:
    """Words at most ``reach`` code points before or after a span, with their places: (key columns, kind, term, start, end).

    ``found`` has _id, _h, text and spans; a word that touches a span is part of it and no term.
    """
    s = found.where(F.size("spans") > 0).select("_id", "_h", "text", F.explode("spans").alias("s"))
    before = F.substr(F.col("text"), F.greatest(F.col("s.start") - reach, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(reach)))
    after = F.substr(F.col("text"), F.col("s.end") + 1, F.lit(reach))
    sides = s.select("_id", "_h", "s.kind", F.explode(F.array(
        F.struct(F.greatest(F.col("s.start") - reach, F.lit(0)).alias("at"), before.alias("piece"), F.lit(True).alias("left"), (F.col("s.start") > reach).alias("torn")),
        F.struct(F.col("s.end").alias("at"), after.alias("piece"), F.lit(False).alias("left"), (F.length(after) == reach).alias("torn")))).alias("p")).select("_id", "_h", "kind", "p.*")
    # words between white space; the outer end may be torn by the window, the inner end may touch the span
    clean = F.when(F.col("left"), F.regexp_replace(F.when(F.col("torn"), F.regexp_replace("piece", r"\A\S+", "")).otherwise(F.col("piece")), r"\S+\z", "")) \
        .otherwise(F.regexp_replace(F.when(F.col("torn"), F.regexp_replace("piece", r"\S+\z", "")).otherwise(F.col("piece")), r"\A\S+", ""))
    lead = F.when(F.col("left") & F.col("torn"), F.length("piece") - F.length(F.regexp_replace("piece", r"\A\S+", ""))) \
        .when(~F.col("left"), F.length("piece") - F.length(F.regexp_replace("piece", r"\A\S+", ""))).otherwise(0)
    w = sides.select("_id", "_h", "kind", (F.col("at") + lead).alias("at"), clean.alias("piece"))
    words = F.regexp_extract_all(F.col("piece"), F.lit(r"[\p{L}\p{M}]{3,}"), F.lit(0))
    gaps = F.transform(F.split(F.col("piece"), r"[\p{L}\p{M}]{3,}", -1), lambda x: F.length(x))
    place = F.aggregate(F.zip_with(words, gaps, lambda m, g: F.struct(F.coalesce(F.length(m), F.lit(0)).alias("m"), g.alias("g"), m.alias("w"))),
                        F.struct(F.col("at").alias("at"), F.array().cast("array<struct<w:string,s:int>>").alias("all")),
                        lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"),
                                              F.concat(a["all"], F.array(F.struct(x["w"].alias("w"), (a["at"] + x["g"]).alias("s")))).alias("all")))["all"]
    return (w.select("_id", "_h", "kind", F.explode(F.filter(place, lambda x: x["w"].isNotNull())).alias("t"))
            .select("_id", "_h", "kind", F.lower("t.w").alias("term"), F.col("t.s").alias("start"), (F.col("t.s") + F.length("t.w")).alias("end")))


def disclosing_terms(docs: DataFrame, near: DataFrame, text_col: str = "text", min_near: int = 5, min_bits: float = 3.0, min_share: float = 0.2) -> DataFrame:
    """Terms that reveal protected entities: (term, n, near, bits).

    Over all texts, ``n`` counts a term's occurrences and ``near`` those beside an entity (each occurrence once, however
    many entities it is near). A term's share near/n against the share of all words gives the pointwise information
    ``bits`` that seeing the term yields about an entity beside it. A term discloses if it is near one at least
    ``min_near`` times, in ``min_share`` of its occurrences, with ``min_bits`` bits.
    """
    by_near = near.select("_id", "_h", "term", "start").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("near"))
    by_near = cut(by_near.where(F.col("near") >= min_near))
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = docs.select(F.explode(F.split(text, r"[^\p{L}\p{M}]+")).alias("term")).where(F.length("term") >= 3)
    every = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # all counts pass the partial sums; only candidates and the two totals leave the aggregation
    joined = cut(every.join(by_near, "term", "left").groupBy(F.when(F.col("near").isNotNull(), F.col("term")).alias("term"))
                 .agg(F.sum("n").alias("n"), F.max("near").alias("near")))
    total = joined.agg(F.sum("n").alias("all_n")).first()["all_n"] or 0
    all_near = near.select("_id", "_h", "start").distinct().count()
    if not total or not all_near:
        return joined.where(F.col("term").isNotNull() & F.lit(False)).select("term", "n", "near", F.lit(0.0).alias("bits"))
    bits = F.log2((F.col("near") / F.col("n")) / F.lit(all_near / total))
    return (joined.where(F.col("term").isNotNull()).withColumn("bits", bits)
            .where((F.col("near") >= min_share * F.col("n")) & (F.col("bits") >= min_bits)))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_near: int = 5, min_bits: float = 3.0, min_share: float = 0.2) -> DataFrame:
    """Spans of every whole text: (_id, _h, base, spans): ``base`` holds the patterns' spans, ``spans`` also the terms
    beside them that disclose them. ``_h`` is a hash of the text, so that rows which share an id stay apart.

    Null and empty texts have no spans. Rows that are equal in id and text give equal rows; ids may be null. Counts are
    taken over all texts. Only places, never texts, are shuffled. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("spans", base_spans(F.col("text")))
    near = cut(near_terms(rows))
    bad = disclosing_terms(docs, near, text_col, min_near, min_bits, min_share)
    more = (near.join(bad.select("term"), "term").select("_id", "_h", "start", "end").distinct()
            .groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "end", F.lit(len(KINDS)).alias("kind"))).alias("terms")))
    more = more.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "terms")
    slim = rows.select("_id", "_h", F.col("spans").alias("base"))
    both = slim.join(more, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left")
    # a term inside a span of another entity is covered already
    terms = F.filter(F.coalesce(F.col("terms").cast(_SPAN), _no_spans()), lambda t: ~F.exists(F.col("base"), lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    ordered = F.array_sort(F.transform(F.concat("base", terms), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return both.select("_id", "_h", "base", F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans, what begins later loses the shared part."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(
        s["end"].alias("at"),
        F.concat(a["out"], F.array(F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.element_at(labels, s["kind"] + 1))).alias("out"))))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), F.substr(text, done["at"] + 1)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with personal data replaced by its kind and disclosing terms by [TERM]; n_chars follows the text.

    Rows without spans keep their text (null stays null). Rows and columns are those of ``docs``, whatever their names.
    """
    spans = find_personal(docs, id_col, text_col, **kw).where(F.size("spans") > 0).select(F.struct("_id", "_h").alias("key"), F.col("spans")).distinct()
    spans = cut(spans)
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    out = own.join(spans.hint("shuffle_hash"), F.col("i").eqNullSafe(F.col("key._id")) & (F.col("h") == F.col("key._h")), "left")
    old = F.col(f"row.`{text_col}`")
    text = F.when(F.col("spans").isNotNull(), masked(old, F.col("spans"))).otherwise(old)
    new = {text_col: text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_pii(spark, sf_dir):
    """Spans of personal data and of the terms that disclose it, in every whole text."""
    found = find_personal(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    n = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("_id").alias("doc_id"), *n, F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))
