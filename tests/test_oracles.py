"""Every query that has SQL returns what the SQL returns."""

import duckdb
import pytest

from newsgrain import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    c = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in c.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(c.fetchall(), names)


def test_every_name_is_registered_once():
    names = [n for m in catalog.MODULES for n in __import__(m, fromlist=["QUERIES"]).QUERIES]
    assert len(names) == len(set(names)) == len(catalog.queries())


def test_native_operators_run_no_python(spark, sf):
    python = {"src12_html_text", "win3_rank_results", "sc19_fact_tiers", "clu1_unique_facts", "jn5_vector_search", "jn5_recall", "clu4_vector_clusters", "clu4_close_vectors", "agg36_cluster_quality", "clu5_micro_clusters", "clu6_split_clusters", "clu7_split_story", "clu8_duplicate_stories"}
    for name, query in catalog.queries().items():
        if name not in python and not name.startswith("str"):
            plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
            assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInArrow")), name
