"""Rows keep their identity when the splits of a table change between two scans of it, as when executors are lost."""

import itertools
import random

import pytest

from vellum.llm import common, exact, lines, packing, pii, simhash

SETTINGS = {"spark.sql.files.maxPartitionBytes": ("2k", "64m", "9k"), "spark.sql.leafNodeDefaultParallelism": ("2", "8", "3"),
            "spark.sql.files.openCostInBytes": ("0", "4m", "1k")}


@pytest.fixture
def restless(spark, monkeypatch):
    """Every table that is stored changes how the next scans are split."""
    real, turn = common.keep, itertools.count()
    before = {k: spark.conf.get(k, None) for k in SETTINGS}

    def keep(df, label):
        out = real(df, label)
        n = next(turn)
        for k, values in SETTINGS.items():
            spark.conf.set(k, values[n % 3])
        return out

    monkeypatch.setattr(common, "keep", keep)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(7)) for _ in range(4)) + f" {i}" for i in range(120)]
    texts += [f"Mail bob{i}@example.com or 192.168.{i}.7, card 4111 1111 1111 1111." for i in range(40)]
    return [(rng.randrange(60) if rng.random() < 0.9 else None, rng.choice(texts)) for _ in range(600)]


def _plain(df):
    return sorted(map(str, df.drop("uid").collect()))


CASES = {
    "exact": lambda s, d: exact.drop_exact_duplicates(s, d, ""),
    "simhash": lambda s, d: simhash.drop_near_duplicates(s, d, ""),
    "lines": lambda s, d: lines.line_dedup(d),
    "clean": lambda s, d: lines.clean(d),
    "pii": lambda s, d: pii.replace_pii(d, "k"),
    "packing": lambda s, d: packing.pack_documents(d, window=16, group=50).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
}


@pytest.mark.parametrize("case", CASES)
def test_changed_splits(spark, make, request, monkeypatch, case):
    monkeypatch.setattr(pii, "BROADCAST", 0)  # the way beyond it
    docs = make(_rows(), 16)
    want = _plain(CASES[case](spark, docs))
    request.getfixturevalue("restless")
    got = CASES[case](spark, docs)
    assert _plain(got) == want and len(want) >= 50


def test_identity_is_of_the_row(spark, make):
    docs = make([(1, str(i)) for i in range(300)], 7)
    seen = []
    for size in ("1k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        d, uid = common.with_uid(docs)
        seen.append({r[uid]: r["text"] for r in d.collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len(seen[0]) == 300
    named = docs.withColumnRenamed("score", common.UID)
    d, uid = common.with_uid(named)
    assert uid != common.UID and d.drop(uid).columns == named.columns and d.select(uid).distinct().count() == 300
    kept = exact.drop_exact_duplicates(spark, named, "")
    assert kept.columns == named.columns and kept.count() == 300 and common.UID in kept.columns
    assert common.with_uid(docs.where("false"))[0].count() == 0
