"""Text normalisers as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes that a headline loses, and words that a first word must not be to count as a proper noun.
HEADLINE_PREFIXES = ("breaking", "live", "exclusive", "update", "watch", "live updates", "just in")
STOP_FIRST_WORDS = ("the", "a", "an", "this", "what", "how", "why", "who", "when", "where", "if", "in", "on", "at", "by", "for", "with")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an outer expression is computed for every element."""
    return F.transform(F.array(value), body)[0]


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(col: Column) -> Column:
    """NFKC, which no built-in function offers; a pandas UDF, so apply it to rows that need it only."""
    return F.pandas_udf(_nfkc, "string")(col)


def has_non_ascii(col: Column) -> Column:
    return col.rlike(r"[^\x00-\x7F]")


def normalize_headline(col: Column) -> Column:
    """Headline as a search key; null and empty give "". Compatibility forms must be folded before (see ``nfkc``)."""
    x = F.lower(F.coalesce(col, F.lit("")))
    x = F.regexp_replace(x, rf"^({'|'.join(HEADLINE_PREFIXES)})\s*:\s*", "")
    x = F.regexp_replace(x, r"\s+[-|—–]\s+[^-|—–]+$", "")
    x = F.regexp_replace(x, r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def fold(col: Column) -> Column:
    """NFKC, then case folding, by the Unicode library that Spark has for its collations; null gives "". Spark takes such calls
    for nondeterministic, so they stand in a select, not within an aggregate."""
    x = F.coalesce(col, F.lit(""))
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return F.when(has_non_ascii(x), F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))).otherwise(F.lower(x))


def normalize_fact(col: Column) -> Column:
    """Comparison key of a short fact: compatibility forms and case folded, no leading article, no points or apostrophes,
    other punctuation as space."""
    x = F.trim(fold(col))
    x = F.regexp_replace(x, r"^(the|a|an)\s+", "")
    x = F.regexp_replace(x, r"[.'’]", "")
    x = F.regexp_replace(x, r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def proper_nouns(title: Column) -> Column:
    """Words of a title that begin with a capital, the first only if it is no stop word."""
    words = F.transform(F.split(F.trim(F.coalesce(title, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"""[:,.\-!"']+$""", ""))
    capital = lambda w: F.length(w) > 0
    return F.size(F.filter(words, lambda w, i: capital(w) & w.rlike(r"^\p{Lu}") & ((i > 0) | ~F.lower(w).isin(*STOP_FIRST_WORDS))))


def salted_hash(value: Column, salt: str) -> Column:
    """SHA-256 of a personal value behind a salt, as logs of consent keep it; null stays null."""
    return F.sha2(F.concat(F.lit(salt), value), 256)


def parse_event_time(raw: Column) -> Column:
    """The date that a free-form event time names, in either of two usual forms; null if in none."""
    return F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")), F.try_to_timestamp(raw, F.lit("MM/dd/yyyy"))).cast("date")


def first_line(col: Column) -> Column:
    return F.substring_index(F.coalesce(col, F.lit("")), "\n", 1)


def display_slug(col: Column, year: int) -> Column:
    """Lower-case words joined by hyphens, 50 characters at most, and the year."""
    s = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, 50), r"-+$", "")
    return F.concat(s, F.lit(f"-{year}"))


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit(""))), 256)


def embedding_text(title: Column, description: Column, content: Column, most: int = 4000) -> Column:
    return F.translate(F.concat_ws(" ", title, description, F.substring(content, 1, most)), "\n", " ")


def extract_context(text: Column, most: int = 6000, marker: str = "[...]") -> Column:
    """Shorten by paragraphs: the first, as many of the middle as fit, the last, and a marker where some are left out.

    Texts of at most ``most`` characters are unchanged. If first and last do not fit, the text is cut.
    """
    every = F.filter(F.transform(F.split(text, r"\n+"), lambda p: F.trim(p)), lambda p: p != "")

    def shorten(parts: Column) -> Column:
        head, tail = parts[0], F.element_at(parts, -1)
        middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
        return let(F.lit(most - len(marker) - 6) - F.length(head) - F.length(tail), lambda room: F.when(room < 0, F.lit(None)).otherwise(fill(parts, middle, room)))

    def fill(parts: Column, middle: Column, room: Column) -> Column:
        start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.lit(0).alias("kept"))
        taken = F.aggregate(middle, start, lambda a, p: F.when(a["full"] | (a["used"] + F.length(p) + 2 > room), F.struct(a["used"].alias("used"), F.lit(True).alias("full"), a["kept"].alias("kept")))
                            .otherwise(F.struct((a["used"] + F.length(p) + 2).alias("used"), F.lit(False).alias("full"), (a["kept"] + 1).alias("kept"))))
        return let(taken, lambda t: F.array_join(F.concat(F.array(parts[0]), F.slice(parts, F.lit(2), t["kept"]), F.when(t["full"], F.array(F.lit(marker))).otherwise(F.array().cast("array<string>")), F.array(F.element_at(parts, -1))), "\n\n"))

    short = let(every, lambda parts: F.when(F.size(parts) >= 2, shorten(parts)))
    return F.when(F.length(text) <= most, text).otherwise(F.coalesce(short, F.substring(text, 1, most)))


def equal_keys(x: Column, y: Column, tx: Column, ty: Column, least: int = 5) -> Column:
    """``facts_equivalent`` of two keys of ``normalize_fact`` and their words, for callers that have them ready."""
    long = (F.length(x) >= least) & (F.length(y) >= least)
    return (x != "") & (y != "") & ((x == y) | (long & (F.contains(x, y) | F.contains(y, x) | (F.size(F.array_except(tx, ty)) == 0) | (F.size(F.array_except(ty, tx)) == 0))))


def facts_equivalent(a: Column, b: Column, least: int = 5) -> Column:
    """Whether two facts are the same by the tiers that need no spelling distance: equal, contained, or token subset.
    ``match_facts`` has all four."""
    x, y = normalize_fact(a), normalize_fact(b)
    return equal_keys(x, y, F.split(x, " "), F.split(y, " "), least)


def match_facts(pairs: DataFrame, a: str, b: str, least: int = 5, ratio: float = 0.90) -> DataFrame:
    """``pairs`` with ``tier``: equal, contained, subset, spelling, or null where two facts differ.

    Spelling is compared last, and only of pairs that are open then, hold no digit and are of lengths that can reach
    ``ratio``, so Python sees few rows. Null and empty facts match nothing.
    """
    x = pairs.withColumns({"_x": normalize_fact(F.col(a)), "_y": normalize_fact(F.col(b))})
    tx, ty = F.split("_x", " "), F.split("_y", " ")
    both = (F.col("_x") != "") & (F.col("_y") != "")
    long = (F.length("_x") >= least) & (F.length("_y") >= least)
    x = x.withColumn("tier", F.when(~both, F.lit(None)).when(F.col("_x") == F.col("_y"), "equal").when(long & (F.contains("_x", "_y") | F.contains("_y", "_x")), "contained")
                     .when(long & ((F.size(F.array_except(tx, ty)) == 0) | (F.size(F.array_except(ty, tx)) == 0)), "subset"))
    near = 2 * F.least(F.length("_x"), F.length("_y")) >= ratio * (F.length("_x") + F.length("_y"))
    may = both & F.col("tier").isNull() & near & ~F.concat("_x", F.lit(" "), "_y").rlike("[0-9]")
    rest = x.where(~may)
    tried = x.where(may).withColumn("tier", F.when(spelling_ratio(F.col("_x"), F.col("_y")) >= ratio, "spelling"))
    return rest.unionByName(tried).drop("_x", "_y")


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")


def spelling_ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two strings; a pandas UDF, so apply it to survivors of cheaper tests only."""
    return F.pandas_udf(_ratio, "double")(a, b)


def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    def one(x, y):
        s, t = set(x.split()), set(y.split())
        if not s or not t:
            return 0.0
        both = " ".join(sorted(s & t))
        l, r = f"{both} {' '.join(sorted(s - t))}".strip(), f"{both} {' '.join(sorted(t - s))}".strip()
        return 100.0 * max(SequenceMatcher(None, p, q).ratio() for p, q in ((both, l), (both, r), (l, r)) if p and q) if both else 100.0 * SequenceMatcher(None, l, r).ratio()

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def token_set_ratio(a: Column, b: Column) -> Column:
    """0..100 likeness of two token sets, whatever their order."""
    return F.pandas_udf(_token_set, "double")(a, b)


def html_to_text(col: Column) -> Column:
    """Text of an HTML page: tags, comments, scripts, styles and navigation dropped, white space collapsed."""

    def strip(pages: pd.Series) -> pd.Series:
        from html.parser import HTMLParser

        class Text(HTMLParser):
            SKIP = frozenset(("script", "style", "nav", "noscript"))

            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.parts, self.depth = [], 0

            def handle_starttag(self, tag, attrs):
                self.depth += tag in self.SKIP

            def handle_endtag(self, tag):
                self.depth -= tag in self.SKIP and self.depth > 0

            def handle_data(self, data):
                if not self.depth:
                    self.parts.append(data)

        def one(page):
            t = Text()
            t.feed(page)
            t.close()
            return " ".join(" ".join(t.parts).split())

        return pages.map(one, na_action="ignore")

    return F.pandas_udf(strip, "string")(col)
