"""Personal data against plain regular expressions, and the disclosure counts against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsgrain.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


CASES = [None, "", "a@b", "a@b.c", "a@b.c.d..e@f.g", "a@b.com_x@y.zz", "x@@y.z", "a@b.c@d.e", "é😀 mail: é.x@y-z.org,", "a.b.c@d.e.", "%+-@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "0001.2.3.255", "256.1.1.1", "1.2.3.4.5", "300.1.2.3.4",
         "4111 1111 1111 1111", "4111-1111-1111-1111 9", "4111111111111112", "79927398713", "0000 0000 0000", "1 2 3 4 5 6 7 8 9 0 1 2 3", "0" * 19, "0" * 20, "12  4111111111111111", "4111111111111111 -5", "é4111111111111111é",
         "+1 (743) 555-3824 x", "+12", "+1 2", "+1 23456789", "+1" + "2" * 14, "+1" + "2" * 15, "++1 234 567 890", "+1-800-555 0199 +44 20 7946 0958", "+1 234.567.890.123 x", "x+1@y.zz +1 (234) 567 890 1.1.1.1",
         "1 " * 30000, "a" * 100000, "a." * 20000 + "@b.c", "x@" + "a." * 20000, "1.2.3.4 " * 300, "9" * 50000, "+1" + " " * 20000, "@" * 1000]


def fuzz(n, seed):
    r = random.Random(seed)
    parts = ["a", "b.", "@", "x@y.z", ".", "-", "+", " ", "1", "12", "255", "4111111111111111", "(", ")", "é", "%", "\n", "+1 555", "0", "_", "1.1.1.1", "😀"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    texts = CASES + fuzz(1500, 5)
    return spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "q@r.st", "d"), (3, "a@b.c", "e"), (3, "other@b.c", "f")], "doc_id long, text string, spans string").repartition(4)


def test_base_spans(odd):
    rows = odd.select("doc_id", "text", pii.spell(pii.base_spans(F.coalesce("text", F.lit("")))).alias("got")).collect()
    for r in rows:
        assert r.got == plain_spans(r.text), (r.doc_id, (r.text or "")[:80])


def test_query_over_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op10_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        assert [x for x in r.spans.split(",") if not x.startswith("term")] == base.split(",") or not base


def disclosure(texts, reach, min_near, min_bits, min_share):
    n, near = Counter(), set()
    for i, t in enumerate(texts):
        n.update(w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 3)
        for s in plain_spans(t).split(","):
            if s:
                _, a, b = s.split(":")
                a, b = int(a), int(b)
                lo = max(0, a - reach)
                hi = min(len(t), b + reach)
                for m in re.finditer(r"[^\W\d_]{3,}", t):
                    chunk_start = max((k for k in range(m.start() + 1) if k == 0 or t[k - 1].isspace()), default=0)
                    chunk_end = next((k for k in range(m.end(), len(t) + 1) if k == len(t) or t[k].isspace()), len(t))
                    if chunk_end <= a and chunk_start >= lo and (lo == 0 or chunk_start > lo) or chunk_start >= b and (chunk_end < hi or chunk_end == hi == len(t) and hi < b + reach):
                        near.add((i, m.start(), m[0].lower()))
    by = Counter(w for *_, w in near)
    total, all_near = sum(n.values()), len(near)
    return {w: (n[w], k, round(math.log2((k / n[w]) / (all_near / total)), 9)) for w, k in by.items()
            if k >= min_near and k >= min_share * n[w] and math.log2((k / n[w]) / (all_near / total)) >= min_bits}


def test_disclosing_terms(spark):
    r = random.Random(3)
    common = ["alpha", "beta", "gamma", "delta", "omega", "of", "été"]
    texts = []
    for i in range(120):
        w = [r.choice(common) for _ in range(r.randint(5, 60))]
        if i % 3 == 0:
            w.insert(r.randint(0, len(w)), r.choice(["Contact", "contact,", "reach"]) + f" u{i}@mail.example.com now")
        if i % 7 == 0:
            w.append("reach")
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("_id"), "text").withColumn("_h", F.xxhash64("text")).withColumn("spans", pii.base_spans(F.col("text")))
    found = pii.disclosing_terms(docs, pii.near_terms(rows), min_near=5, min_bits=1.0, min_share=0.2).collect()
    want = disclosure(texts, 48, 5, 1.0, 0.2)
    assert {x.term: (x.n, x.near, round(x.bits, 9)) for x in found} == want
    assert "contact" in want and "now" in want and "alpha" not in want
    clean = pii.sanitise(docs, min_bits=1.0)
    assert clean.columns == docs.columns
    for x in clean.collect():
        assert not plain_spans(x.text) and ("[EMAIL]" in x.text) == bool(plain_spans(texts[x.doc_id]))
        if "[EMAIL]" in x.text:
            assert "[TERM]" in x.text


def test_sanitised_texts(odd, spark):
    rows = pii.sanitise(odd).collect()
    assert len(rows) == odd.count()
    before = {(r.doc_id, r.spans): r.text for r in odd.collect()}
    for r in rows:
        old = before[r.doc_id, r.spans]
        if not plain_spans(old):
            assert r.text == old
        else:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal(none).count() == 0 and pii.sanitise(none).count() == 0


def test_native_operators_run_no_python(spark, sf, monkeypatch):
    """Fingerprints and personal data: no Python function is given to Spark, in any step that leads to the result."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from newsgrain.llm import fingerprints, pii

    def forbidden(*args, **kw):
        raise AssertionError("a Python function on the main path")

    for name in ("mapInArrow", "mapInPandas", "toPandas"):
        monkeypatch.setattr(DataFrame, name, forbidden)
    for name in ("udf", "pandas_udf"):
        monkeypatch.setattr(F, name, forbidden)
    for query in (fingerprints.op1_fingerprints, pii.op10_pii):
        df = query(spark, sf)
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "InArrow"))
        assert df.count() > 0
