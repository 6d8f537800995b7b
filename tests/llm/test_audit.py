"""The filter audit against brute force: texts by plain rules, orders one by one."""

import itertools
import re

import duckdb
import pytest

from newsgrain.llm import audit

LONG = " ".join(f"word{i}" for i in range(120))
TEXTS = [LONG, LONG, LONG + " #", "SHOUT " * 150, None, "", " \t\n", "short", "short", "a b " * 100, "É" * 9 + "A", "E" * 1 + "é" * 9, "a" * 9 + "B", LONG.upper(), "x\x0by\x0cz " * 40, "w " * 300000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "", "de"][i % 4], 7) for i, t in enumerate(TEXTS)]
    rows += [(None, LONG, "en", 7), (None, "short", None, 7), (0, LONG, None, 7), (0, LONG, "de", 7), (1, "other text of a repeated id", "en", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, mask int").repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, None, 1), (3, 0, 1), (13, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def plain(rows, labels):
    def says(i, k):
        return i is not None and any(x[0] == i and x[k] == 1 for x in labels)

    facts = []
    for r in rows:
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": r.doc_id is not None and any(x.doc_id is not None and x.doc_id < r.doc_id and (x.text or "") == t for x in rows)}
        facts.append((r.lang or "", fails, says(r.doc_id, 1), says(r.doc_id, 2)))
    out = {}
    for part in {f[0] for f in facts}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [f for f in facts if f[0] == part]
            every = left
            for step, c in enumerate(order, 1):
                gone = [f for f in left if f[1][c]]
                left = [f for f in left if not f[1][c]]
                shapley[c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f[1][c] for f in every) - len(gone), sum(f[1][c] and sum(f[1].values()) == 1 for f in every),
                                                   sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_every_order_by_hand(docs, labels):
    want = plain(docs.collect(), [tuple(x) for x in labels.collect()])
    rows = audit.audit(docs, labels).collect()
    assert len(rows) == 600 * 3
    assert {(r.part, r.filter_order, r.step): [r[m] for m in (*audit.MEASURES, "shapley")] for r in rows} == want


def test_empty_table(spark, labels):
    assert audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0


def test_fields_hold_large_counts_without_overflow(spark):
    big = 1 << 55
    counts = spark.createDataFrame([("p", m, 1, 1, big) for m in range(4)] + [(f"q{i}", 3, 0, 0, i + 1) for i in range(200)], "part string, mask int, good int, toxic int, n long").repartition(7)
    got = {(r.part, r.filter_order, r.step): r for r in audit.interactions(counts, "AB").collect()}
    assert len(got) == 201 * 4
    r = got["p", "AB", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == (big, big, big, big, big, big, 3 * big)
    assert got["q41", "BA", 1].removed == 42 and got["q41", "BA", 2].redundant == 42


def test_one_integer_a_mask_has_a_field_a_step():
    unit = audit.packed("ABCDE")
    assert len(unit) == 128
    for k in (0, 5, 77, 127):
        x = audit.unpack(unit[k] * 12345, "ABCDE")
        assert len(x["step"]) == 600 and set(x["kept"]) <= {0, 12345} and set(x["removed"]) <= {0, 12345}


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = audit.op12_filter_audit(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({audit.OP12_SQL})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
