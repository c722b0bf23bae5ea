import math
from collections import Counter

import duckdb
import pytest

from vellum.llm import mixing

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    res = con.execute(mixing.ORACLE)
    names = [d[0] for d in res.description]
    want = Counter(res.fetchall())
    got = Counter(tuple(r[c] for c in names) for r in mixing.op5_mixing(spark, SF).collect())
    assert got == want and sum(got.values()) > 800


def _cdf(rate, k):
    return sum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k + 1))


@pytest.mark.parametrize("rate", [0.01, 1.0, 7.5, 900.0])
def test_steps_are_the_poisson_distribution(spark, rate):
    from pyspark.sql import functions as F
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("s")).first().s
    assert abs(steps[-1] - 1) < 1e-9 and all(a <= b for a, b in zip(steps, steps[1:]))
    for k in (0, 1, int(rate), int(rate + 3 * rate ** 0.5)):
        assert abs(steps[k] - _cdf(rate, k)) < 1e-9


def test_shares_follow_the_weights(make):
    rows = [(i, "x" * 19, "en", "hot" if i % 3 else ("a" if i % 2 else None)) for i in range(12_000)]
    docs = make(rows)
    out = mixing.mix(docs, {"hot": 1.0, "a": 2.0, None: 1.0})
    n = Counter(r.source for r in out.select("source").collect())
    total = sum(n.values())
    assert abs(total - 12_000) < 600
    for s, share in (("hot", 0.25), ("a", 0.5), (None, 0.25)):
        assert abs(n[s] / total - share) < 0.03
    again = mixing.mix(docs, {"hot": 1.0, "a": 2.0, None: 1.0})
    assert again.select("doc_id", "copy").exceptAll(out.select("doc_id", "copy")).count() == 0


def test_salted_join_gives_the_same(make, monkeypatch):
    docs = make([(i, "ab" * i, "en", f"s{i % 7}") for i in range(200)])
    want = Counter(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == want


def test_odd_rows(make):
    docs = make([(None, None, "en", None), (1, "", "en", "b"), (1, "", "en", "b"), (2, "z" * 500_000, None, "c")])
    out = mixing.mix_sources(docs.sparkSession, docs, "")
    assert out.columns == docs.columns
    n = Counter(r.doc_id for r in out.collect())
    assert n[1] % 2 == 0
    assert mixing.mix(docs, {}).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.withColumn("copy", docs.text)).columns == [*docs.columns, "copy"]
