"""Mixing, token counts, packing, media and URL filters against brute force on small tables."""

import hashlib
import io
import re
import wave
import zlib
from collections import defaultdict

import duckdb
import random

import pytest

from newsgrain.llm import media, mixing, packing, tokens, urls

ODD = [None, "", " ", "a", "Hello, WORLD! it's 42 <|endoftext|> ok", "é e\u0301 \u0085x\u00a0y z\u3000w ẞß İi", "the\tthe\nthe  the " * 3000, "x" * 3000,
       "don't we'll I'M you've \u2028 \x1c \x1f … — ½²³ 12345 !!??", "日本語 テキスト 😀😀", "a", "Ω" * 50]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i % 4 == 0 else f"src{i % 3}", -1, "x") for i, t in enumerate(ODD)] + [(None, "null id", None, None, None, None), (1, "", "en", "src1", 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_token_counts_equal_the_library(spark, sf, odd, empty, library):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()), key=str)
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs).collect()), key=str)
        assert got == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in tokens.token_counts(docs).collect())
    assert tokens.token_counts(empty).count() == 0


def test_token_caches_may_overflow(library):
    small = tokens.WordCoder(tokens.vocabulary_path(), keep=3)
    text = "one two three four five six seven eight one two " * 3
    ids = [int.from_bytes(small.encode(text)[i : i + 4], "little") for i in range(0, len(small.encode(text)), 4)]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert tokens.WordCoder(tokens.vocabulary_path(), keep=3).count(text) == len(ids)


def pieces_are_whole(docs, rows, library, size=4096):
    text_ids = defaultdict(list)
    for r in docs:
        text_ids[r.doc_id].append(library.encode(r.text or "", add_special_tokens=False).ids + [2])
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(text_ids)
    for doc, pieces in got.items():
        ends = sorted((p.start, p.start + p.length, p.ids_crc32, p.doc_tokens) for p in pieces)
        want = sorted(text_ids[doc], key=len)
        assert sum(b - a for a, b, *_ in ends) == sum(map(len, want))
        for a, b, crc, total in ends:
            assert any(len(ids) == total and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])) == crc for ids in want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    short = 0
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == size or (at < size and at & (at - 1) == 0)
        short += at < size
    return len(by), short


def test_pack(spark, sf, odd, empty, library):
    pieces_are_whole(odd.collect(), packing.pack(odd).collect(), library)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    n, short = pieces_are_whole(docs.collect(), packing.pack(docs).collect(), library)
    assert short <= 12 < n
    pieces_are_whole(docs.collect(), packing.pack(docs, size=64, space=3, group=2).collect(), library, 64)
    assert packing.pack(empty).count() == 0


def test_media_round_trip(odd, empty):
    texts = defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add((r.text or "").encode())
    rows = media.media_features(odd).collect()
    stored = {(r.doc_id, bytes(r.media)) for r in media.encode_media(odd).collect()}
    assert len(rows) == odd.count()
    seen = set()
    for doc, wav in stored:
        with wave.open(io.BytesIO(wav)) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            p = w.readframes(w.getnframes())
        assert p.rstrip(b"\0") in {t.rstrip(b"\0") for t in texts[doc]} and len(p) % 64 == 0 and p
        seen.add((doc, hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-64:]), hashlib.sha256(wav).hexdigest(), len(wav)))
    assert {(r.doc_id, r.payload_sha256, r.payload_bytes, r.tail_crc32, r.media_sha256, r.media_bytes) for r in rows} == seen
    assert media.media_features(empty).count() == 0
    a, b = [r for r in rows if r.doc_id in (3, 10)]  # the same text
    assert a.peaks == b.peaks


def test_peaks_follow_the_signal():
    import numpy as np

    t = np.arange(16384) / media.RATE
    loud = (np.sin(2 * np.pi * 500 * t) * (np.sin(2 * np.pi * 3 * t) > 0) * 60 + 128).astype(np.uint8)
    frames, peaks = media.peak_pairs(media.power_spectrum(loud))
    assert frames == 127
    again, parts = media.peak_pairs(media.power_spectrum(loud, block=10))
    assert again == frames and (parts == peaks).all()
    bins = (peaks >> 20) & 0xFFF
    assert len(peaks) and (abs(bins[bins <= 20] - 16) <= 5).any()
    assert (np.diff(peaks >> 32) >= 0).all()
    assert len(media.peak_pairs(media.power_spectrum(np.full(64, 128, np.uint8)))[1]) == 0


def plain_peaks(payload):
    """Peaks by sums of cosines and sines, frame by frame, and pairs by loops."""
    import numpy as np

    x = [(b - 128) / 128 for b in payload]
    frames = 1 if len(x) <= 256 else -(-(len(x) - 256) // 128) + 1
    x = np.array(x + [0.0] * ((frames - 1) * 128 + 256 - len(x)))
    at = np.arange(256)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * at / 256)
    best = []
    for k in range(frames):
        w = x[128 * k : 128 * k + 256] * hann
        power = [(w * np.cos(2 * np.pi * b * at / 256)).sum() ** 2 + (w * np.sin(2 * np.pi * b * at / 256)).sum() ** 2 for b in range(124)]
        best.append([max((power[b], -b) for b in range(*band)) for band in ((4, 16), (16, 44), (44, 124))])
    peaks = sorted((k, -best[k][j][1]) for k in range(frames) for j in range(3)
                   if best[k][j][0] > 1e-3 and (k == 0 or best[k][j][0] > best[k - 1][j][0]) and (k == frames - 1 or best[k][j][0] > best[k + 1][j][0]))
    return frames, sorted((t << 32) | (f << 20) | (g << 8) | (u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 4] if u - t <= 63)


def test_feature_of_texts_by_plain_sums(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").orderBy("doc_id").limit(12)
    rows = {r.doc_id: r for r in media.media_features(docs).collect()}
    for r in docs.collect():
        raw = r.text.encode()
        assert (rows[r.doc_id].n_frames, list(rows[r.doc_id].peaks)) == plain_peaks(raw + bytes(-len(raw) % 64))


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for says, r in urls.RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (says, r)
    return host, path, best


def test_urls(spark, sf):
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com?en/", "http://com/", "http://xcom/", "x://a.net/es/1", "x://É.net/fr/", "a://b://c.com/d", "http://\n/\n#", "http://net/es", "http://org/" + "a/" * 5000]
    rows = [(i, u, "h") for i, u in enumerate(odd)] + [(1000 + r.page_id, r.url, "h") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    want = {i: brute_url(u) for i, u, _ in rows}
    for r in got:
        host, path, best = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), r
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mined_rules_against_brute_force(spark):
    rows = [(1, "http://a.com/en/spam/x"), (2, "http://b.example.com/en/spam/y"), (3, "http://c.example.com/en/spam"), (4, "http://d.example.com/en/good"), (5, "http://www.example.com/en/spam"),
            (6, "http://x.org/spam/en"), (7, "http://y.org/good"), (8, "http://z.net/es/spam"), (9, "http://q.org/spam")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    host, path = urls.url_parts(pages.url)
    rule, verdict = urls.rule_of(host, path)
    lab = [(set(r.items_), r.v) for r in pages.select(urls.url_items(host, path, pages.url).alias("items_"), verdict.alias("v")).collect()]
    mined = urls.mine_rules(pages.select(urls.url_items(host, path, pages.url).alias("items"), verdict.alias("verdict")).where("verdict is not null"), 0.1, 0.8).collect()
    known = [(s, v) for s, v in lab if v]
    assert mined
    for m in mined:
        have = [v for s, v in known if set(m["items"]) <= s]
        assert abs(m.confidence - have.count("block") / len(have)) < 1e-9 and m.confidence >= 0.8
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, min_support=0.1, min_confidence=0.8).collect()}
    for (i, _), (s, v) in zip(rows, lab, strict=True):
        assert got[i] == (v or ("block" if any(set(m["items"]) <= s for m in mined) else "allow"))


def every_rule(known, support, confidence, longest):
    """All combinations of tokens by counting, and pruning by comparing every rule with its parts."""
    from itertools import combinations

    tokens_ = sorted({t for s, _ in known for t in s})
    rules = {}
    for k in range(1, longest + 1):
        for items in combinations(tokens_, k):
            have = [v for s, v in known if set(items) <= s]
            hits = have.count("block")
            if hits and hits >= support * len(known) and hits / len(have) >= confidence:
                rules[items] = hits / len(have)
    return {r: c for r, c in rules.items() if not any(rules.get(p, -1) >= c for k in range(1, len(r)) for p in combinations(r, k))}


def test_all_rules_are_mined_and_pruned(spark):
    import random

    r = random.Random(3)
    known = [({t for t in "abcdefgh" if r.random() < 0.5}, r.choice(["block", "allow"])) for _ in range(80)]
    known = [(s, "block" if {"a", "b"} <= s or ("c" in s and r.random() < 0.8) else v) for s, v in known] + [(set(), "allow")]
    df = spark.createDataFrame([(sorted(s), v) for s, v in known], "items array<string>, verdict string")
    for support, confidence in ((0.05, 0.6), (0.02, 0.85)):
        got = {tuple(x["items"]): x.confidence for x in urls.mine_rules(df, support, confidence, 3).collect()}
        want = every_rule(known, support, confidence, 3)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert urls.mine_rules(df.limit(0)).count() == 0


def test_long_shared_paths_do_not_explode(spark):
    path = "/".join(f"word{chr(97 + k)}" for k in range(25))
    rows = [(i, f"http://h{i % 7}.example.com/en/{path}/x{i}") for i in range(300)] + [(1000 + i, f"http://www.example.com/en/{path.replace('worda', 'fine')}") for i in range(50)] + [(2000, f"http://org/{path}")]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0] == "block" and got[1000] == "allow" and got[2000] == "block"


def test_url_rules_equal_sql(spark, sf):
    import duckdb as db

    con = db.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = sorted(map(tuple, urls.op8_url_rules(spark, sf).collect()), key=str)
    assert got == sorted(con.execute(urls.OP8_RULES_SQL).fetchall(), key=str)


def test_mixing_equals_sql(spark, odd, empty):
    got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_sources(odd).collect()), key=str)
    con = duckdb.connect()
    documents = odd.select("doc_id", "text", "source").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    want = sorted(((a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(mixing.OP9_SQL).fetchall()), key=str)
    assert got == want
    assert mixing.mix_sources(empty).count() == 0


def test_mixture_holds_what_was_taken(spark, odd):
    taken = sum(r.taken for r in mixing.mix_sources(odd).collect())
    drawn = mixing.draw(odd.withColumn("size", mixing.F.lit("s")).withColumn("taken", mixing.F.lit("t")))
    assert drawn.columns == [*odd.columns, "size", "taken"]
    rows = drawn.collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows) == taken
    assert all(r.n_chars == len(r.text) for r in rows)
    per = {(r.source_size, r.target): 0 for r in mixing.mix_sources(odd).collect()}
    for r in mixing.mix_sources(odd).collect():
        per[r.source_size, r.target] += r.taken
    assert all(abs(t - target) < 1 and t <= 3 * size for (size, target), t in per.items())


def test_very_long_texts(spark, library):
    import random

    r = random.Random(1)
    long = " ".join("".join(r.choice("abcdefghij,.") for _ in range(r.randint(1, 12))) for _ in range(200_000))
    docs = spark.createDataFrame([(1, long, "s"), (2, "short", "s"), (3, long[::-1], None)], "doc_id long, text string, source string").repartition(2)
    rows = {x.doc_id: x for x in media.media_features(docs).collect()}
    assert rows[1].n_bytes == len(long) and rows[1].payload_sha256 == hashlib.sha256(long.encode() + bytes(-len(long) % 64)).hexdigest()
    counts = {x.doc_id: x.n_tokens for x in tokens.token_counts(docs).collect()}
    assert counts[1] == len(library.encode(long, add_special_tokens=False).ids)
    pieces_are_whole(docs.collect(), packing.pack(docs).collect(), library)
    taken = {x.doc_id: (x["size"], x.taken) for x in mixing.mix_sources(docs).collect()}
    assert taken[1][0] == len(long.split()) and all(t <= 3 * n for n, t in taken.values())


def test_rules_that_tie(spark):
    rules = (("allow", "a.com/x"), ("block", "a.com/x"), ("block", "com/"))
    df = spark.createDataFrame([("a.com", "/x/y"), ("b.com", "/"), ("b.org", "/x")], "host string, path string")
    rule, verdict = urls.rule_of(df.host, df.path, rules)
    assert [tuple(r) for r in df.select(rule, verdict).collect()] == [("a.com/x", "block"), ("com/", "block"), (None, None)]  # of equal rules the last


def test_hot_null_ids_are_spread(spark):
    rows = [(None, f"text {i} of many words", "s") for i in range(400)] + [(i, "other words here", "t") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix_sources(docs, in_range=0.001)
    assert taken.where("doc_id is null").count() == 400
    fine, coarse = (sorted(map(tuple, mixing.mix_sources(docs, in_range=n).collect()), key=str) for n in (0.001, 10**9))
    assert fine == coarse  # how many ranges there are changes nothing


def test_rules_use_all_tokens_of_a_url(spark):
    """Twenty tokens a URL, more than were mined once, and rules of up to three: those of a loop over all combinations."""
    from itertools import combinations

    r = random.Random(3)
    rows = [[f"t{i:02}" for i in range(20) if r.random() < 0.8] for _ in range(80)]
    rows = [(x, "block" if {"t18", "t19"} <= set(x) or r.random() < 0.3 else "allow") for x in rows]
    least = 0.2 * len(rows)
    rules = {}
    for k in (1, 2, 3):
        for c in combinations([f"t{i:02}" for i in range(20)], k):
            verdicts = [v for items, v in rows if set(c) <= set(items)]
            hits = verdicts.count("block")
            if hits >= least and hits >= 0.85 * len(verdicts):
                rules[c] = hits / len(verdicts)
    want = {c: x for c, x in rules.items() if not any(rules.get(s, -1) >= x for k in range(1, len(c)) for s in combinations(c, k))}
    got = {tuple(x["items"]): x.confidence for x in urls.mine_rules(spark.createDataFrame(rows, "items array<string>, verdict string"), 0.2, 0.85, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want) and len(want) > 5
