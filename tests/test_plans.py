"""Physical-plan properties the operators rely on at scale."""

import tempfile

from vellum.operators import index as ix
from vellum.operators import meta as me
from vellum.operators import search as se
from vellum.sources import tables as tb

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_search_plan_over_persisted_index(spark):
    path = tempfile.mkdtemp(prefix="plan-test-")
    ix.write_index(tb.documents(spark, SF), path, buckets=8)
    idx = ix.read_index(spark, path)
    df = se.search(idx, tb.or_queries(spark, SF))
    plan = _plan(df)
    formatted = _formatted(spark, df)
    assert "WindowGroupLimit" in plan                    # partial top-k before the shuffle
    assert "dynamicpruningexpression(tb" in formatted    # only the query terms' buckets are read
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # the postings scan reads only what BM25 needs
    assert "ReadSchema: struct<field:string,term:string,doc_id:string,dl:int,tf:int>" in formatted


def test_tree_aggregates_before_join(spark):
    docs = tb.documents(spark, SF, with_tags=False)
    plan = _plan(me.tree_counts(tb.entities(spark, SF), docs))
    join_at = min(i for i, line in enumerate(plan.splitlines()) if "Join" in line)
    agg_at = max(i for i, line in enumerate(plan.splitlines()) if "HashAggregate" in line and "entity_id" in line)
    assert agg_at > join_at  # the documents aggregate sits below (after, in the tree text) the join
    assert "labels" not in plan  # the unused tags join is eliminated
