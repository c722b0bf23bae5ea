import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
import corpus_pipeline
from vellum.llm import exact, simhash
from vellum.llm.common import store

SF = "/root/testdata/sf0.01"


def test_registration():
    q, o = E.queries(), E.oracle_sql()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert "pipeline" in q and set(o) <= set(q)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]


def test_stages_against_plain_versions(spark):
    """Each stage on what the one before it kept, held against a plain restatement."""
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    docs = {}
    now = raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = store(stage(spark, now, SF), "test-stage")
        assert now.columns == raw.columns
        docs[name] = now.collect()
    before = {r.doc_id: r for r in raw.collect()}
    tame = docs["toxicity"]
    assert all(before[r.doc_id] == r for r in tame)
    gone = set(before) - {r.doc_id for r in tame}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in gone for i in clean) <= 0.1 * len(clean)
    keep = {}
    for r in tame:
        t = exact.normalised(r.text)
        keep[t] = max(keep.get(t, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in docs["exact_dedup"]) == sorted(keep.values())
    rows = sorted(docs["exact_dedup"], key=lambda r: r.doc_id)
    fps = [simhash.fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            low = min(group[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4)
            if low < group[i]:
                group[i], changed = low, True
    assert [r.doc_id for r in sorted(docs["simhash_near_dedup"], key=lambda r: r.doc_id)] == [rows[i].doc_id for i in sorted(set(group))]
    mixed = {r.doc_id for r in docs["mixing"]}
    assert mixed <= {r.doc_id for r in docs["simhash_near_dedup"]} and len(docs["mixing"]) > 0.5 * len(set(group))
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    starts = [r for r in packed if r.start == 0]
    assert sorted(r.doc_id for r in starts) == sorted(r.doc_id for r in docs["mixing"])
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in starts)


@pytest.mark.parametrize("rows", [0, 5])
def test_stages_take_odd_tables(make, tmp_path, rows):
    docs = make([(None, None), (1, ""), (1, ""), (2, "a b"), (2, "A b"), (3, "word " * 20_000)][:rows + 1]).limit(rows)
    spark = docs.sparkSession
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = store(docs, "odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = store(stage(spark, now, str(tmp_path)), "odd")
        assert now.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() <= 10
