import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "nation", "benchmark", "events", "part", "conversations"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["query_id", "rank", "doc_id", "score"]


def test_every_query_has_oracle_or_is_documented():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(q) - set(o) <= set(E._llm()[0])


@pytest.mark.parametrize("name", ["search_bm25", "tree_counts", "apply_changes_rejects", "search_phrase",
                                  "similar_entities", "backlinks", "search_snippets"])
def test_oracle_agrees_at_smallest_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    s_rows = sorted((tuple(_n(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in res.description]
    idx = [names.index(c) for c in cols]
    o_rows = sorted((tuple(_n(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert s_rows == o_rows


def _n(v):
    return round(v, 6) if isinstance(v, float) else v
