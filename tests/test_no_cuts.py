"""Inputs that a cut, a cap or a loose pattern would get wrong."""
import pytest
from builders import make_docs
from pyspark.sql import functions as F

from vellum.functions.paths import valid_segment
from vellum.operators import index as ix
from vellum.operators import search as se
from vellum.operators.meta import parse_rfc3339, rfc3339
from vellum.sources.tables import doc_key
from vellum.sources.vault import header_tags, header_value


def test_long_ids_stay_apart(spark):
    got = [r[0] for r in spark.range(99_999_998, 100_000_002).select(doc_key(F.col("id"))).collect()]
    assert got == ["D99999998", "D99999999", "D100000000", "D100000001"]


@pytest.fixture(scope="module")
def idx(spark):
    docs = make_docs(spark, [{"id": f"d{i:02d}", "entity": "e", "name": f"n{i}", "content": "alpha beta" if i % 2 else "gamma"} for i in range(30)])
    return ix.build_index(docs)


def _clauses(spark, rows):
    return spark.createDataFrame(rows, "query_id long, clause_no int, occur string, kind string, terms array<string>, k int")


def test_mixed_limits(spark, idx):
    hits = se.search(idx, _clauses(spark, [(1, 0, "should", "term", ["alpha"], None), (2, 0, "should", "term", ["alpha"], 3)])).collect()
    assert sum(h.query_id == 1 for h in hits) == 10 and sum(h.query_id == 2 for h in hits) == 3


def test_every_word_of_a_clause_counts(spark, idx):
    hits = se.search(idx, _clauses(spark, [(1, 0, "should", "term", ["zzz", "alpha"], 50), (2, 0, "must", "term", ["gamma", "alpha"], 50)])).collect()
    assert sum(h.query_id == 1 for h in hits) == 15 and sum(h.query_id == 2 for h in hits) == 30
    with pytest.raises(ValueError, match="unknown"):
        se.search(idx, _clauses(spark, [(1, 0, "should", "tern", ["alpha"], 5)]))


@pytest.mark.parametrize("text,back", [
    ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z"), ("2024-01-02T03:04:05.120Z", "2024-01-02T03:04:05.120Z"),
    ("2024-01-02T03:04:05.123456Z", "2024-01-02T03:04:05.123456Z"), ("2024-01-02T03:04:05.123456789Z", "2024-01-02T03:04:05.123456Z"),
    ("2024-01-02T05:04:05.1+02:00", "2024-01-02T03:04:05.100Z"), ("garbage", None), ("2024-01-02", None)])
def test_times_keep_their_fraction(spark, text, back):
    assert spark.createDataFrame([(text,)], "t string").select(rfc3339(parse_rfc3339(F.col("t")))).first()[0] == back


def test_segments_end_where_they_end(spark):
    rows = [("rust", True), ("rust\n", False), ("", False), ("a b", False), (None, False)]
    got = spark.createDataFrame(rows, "s string, ok boolean").select(valid_segment(F.col("s")), "ok").collect()
    assert all(a == b for a, b in got)


def test_header_lines_and_flow_tags(spark):
    header = 'id: "x"\ntitle: "one two\x85three"\ntags: ["p, q", r, \'it\'\'s, so\', "a\\"b"]'
    row = spark.createDataFrame([(header,)], "h string").select(header_value(F.col("h"), "title").alias("t"), header_tags(F.col("h")).alias("g")).first()
    assert row.t == "one two\x85three" and row.g == ["p, q", "r", "it's, so", 'a"b']
