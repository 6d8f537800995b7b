"""The pipeline stage by stage against the plain versions of its operators."""

import re
from collections import Counter

import duckdb
import pytest
from test_jaccard import brute
from test_pii import plain_spans
from test_simple_ops import pieces_are_whole

import corpus_pipeline as cp
from newsgrain.llm import mixing, tokens, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_stages(spark, library):
    names = [n for n, _ in cp.STAGES]
    assert len(names) == len(set(names)) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = cp.common.table(spark, SF, "labels").where(~cp.common.held_out())

    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    clean = cp.common.cut(cp.STAGES[0][1](spark, docs, SF))
    assert clean.columns == COLUMNS
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.3}

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    single = cp.common.cut(cp.STAGES[1][1](spark, clean, SF))
    assert single.columns == COLUMNS
    assert {r.doc_id for r in single.collect()} == {i for i, _, c in brute(rows) if c == i}

    private = {r.doc_id: r.text for r in single.collect()}
    safe = cp.common.cut(cp.STAGES[2][1](spark, single, SF))
    assert safe.columns == COLUMNS
    for r in safe.collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(private[r.doc_id]):
            assert r.text == private[r.doc_id]
    assert {r.doc_id for r in safe.collect()} == set(private)

    mixed = cp.common.cut(cp.STAGES[3][1](spark, safe, SF))
    assert mixed.columns == COLUMNS
    con = duckdb.connect()
    con.register("documents", safe.select("doc_id", "text", "source").toPandas())
    want = {i: (size, taken) for i, size, _, _, taken in con.execute(mixing.OP9_SQL).fetchall()}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == Counter({i: t for i, (_, t) in want.items() if t})

    pieces_are_whole_of_copies(mixed.collect(), cp.STAGES[4][1](spark, mixed, SF).collect(), library)
    final = cp.run(spark, SF)
    assert final.groupBy().sum("length").first()[0] == cp.STAGES[4][1](spark, mixed, SF).groupBy().sum("length").first()[0]


def pieces_are_whole_of_copies(docs, rows, library):
    pieces_are_whole(docs, rows, library)


def test_stages_take_odd_tables(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (None, "x y z " * 10, "en", "a", 5), (3, "mail a@b.cd now", "en", "b", 1), (3, "mail a@b.cd now", "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = cp.common.cut(stage(spark, docs, SF))
            assert docs.columns == COLUMNS
        packed = cp.STAGES[-1][1](spark, docs, SF)
        assert (packed.count() > 0) == bool(data)
