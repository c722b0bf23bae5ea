import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import topk

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(topk.ORACLE).fetchall())
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op4_topk(spark, SF).collect())
    assert got == want and len(got) == 25 * 20


@pytest.mark.parametrize("big", [1, 10 ** 6])
def test_against_brute_force(spark, big):
    rng = random.Random(big)
    rows = []
    for i in range(120):
        v = [float(rng.choice([0, 0, 0, 1, -2, 3])) * big / 64 for _ in range(rng.randrange(0, 6))]
        rows.append((i // 2 if i < 20 else i, v, "x"))
    rows += [(200, None, "x"), (220, [1.0, None], "x"), (240, [float("nan")], "x"), (260, [float("inf")], "x"), (None, [1.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    vectors = topk.integer_vectors(frame).persist()
    table = [(r.uid, r.vec_id, r.v) for r in vectors.collect()]
    assert len(table) == 121
    want = []
    for u, q, v in table:
        if q is not None and q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), c is None, c or 0, x) for x, c, w in table if x != u)[:7]
            want += [(q, k + 1, None if none else c, -score) for k, (score, none, c, _) in enumerate(s)]
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, 7, 2, 30).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_accumulation_is_the_product():
    rng = np.random.default_rng(0)
    c, q = rng.integers(-5, 5, (50, 9)), rng.integers(-5, 5, (7, 9))
    terms = lambda m: (*np.nonzero(m), m[np.nonzero(m)])
    assert (topk.accumulate(terms(c), terms(q), 50, 7, np.int16) == q @ c.T).all()


@pytest.mark.parametrize("big", [1e8, 1e300])
def test_what_64_bits_cannot_hold_is_refused(spark, big):
    rows = spark.createDataFrame([(1, [big, 1.0]), (20, [big * 10, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(topk.integer_vectors(rows), F.col("vec_id") == 20).collect()
