import hashlib

import duckdb
import numpy as np
import pyarrow.parquet as pq

from vellum.llm import exact

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(exact.ORACLE).fetchall()
    got = [tuple(r) for r in exact.op6_exact_dedup(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_directory_doubles_until_buckets_fit(spark):
    rng = np.random.default_rng(1)
    keys = np.r_[rng.integers(0, 1 << 63, 2000), np.full(500, 77), rng.integers(0, 1 << 50, 500)].astype(np.int64)
    frame = spark.createDataFrame([(int(k), 10) for k in keys], "key long, bytes long")
    bounds = exact.directory(frame, 400)
    assert bounds[0] == 0 and (np.diff(bounds.astype(object)) > 0).all()
    place = np.searchsorted(bounds, keys.view(np.uint64), "right") - 1
    for b in np.unique(place):
        own = keys[place == b]
        assert len(own) * 10 <= 400 or len(set(own)) == 1
    assert list(exact.directory(frame.limit(0))) == [0]


def test_small_buckets_and_odd_rows(make):
    rows = [(1, "Aa"), (2, "aA"), (2, "aA"), (None, "aa"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "z" * 3_000_000)]
    docs = make(rows)
    for size in (1, exact.BUCKET_BYTES):
        out = exact.exact_groups(docs, size).collect()
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out), key=str)
        assert got == sorted([(1, 2, 4, False), (2, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False), (3, 4, 2, False),
                              (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)], key=str)
        assert {r.text_sha256 for r in out if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}
    kept = exact.drop_exact_duplicates(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7]
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_equal_keys_with_other_bytes_stay_apart(make, monkeypatch):
    monkeypatch.setattr(exact, "_unsigned", lambda digest: 9)
    out = exact.exact_groups(make([(i, f"t{i % 5}") for i in range(40)])).collect()
    assert {(r.keep_id, r.group_size) for r in out} == {(35 + i, 8) for i in range(5)}


def test_ids_cover_the_table(spark):
    n = pq.read_table(f"{SF}/documents.parquet").num_rows
    assert exact.op6_exact_dedup(spark, SF).select("doc_id").distinct().count() == n
