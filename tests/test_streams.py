import os
import tempfile

from builders import make_docs, make_entities
from test_changes import log
from vellum.operators import changes as chg
from vellum.streaming import streams as st


def test_change_stream_equals_batch(spark):
    ents = make_entities(spark, ["rust"])
    docs = make_docs(spark, [dict(id="D1", entity="rust", name="anyhow")])
    rows = [dict(seq=1, op="update", id="D1", title="t1"), dict(seq=2, op="delete", id="D1"),
            dict(seq=3, op="save", id="N1", entity="rust", name="anyhow", title="a"),
            dict(seq=4, op="save", id="N2", entity="rust", name="anyhow"),
            dict(seq=5, op="update", id="N1", content="c"), dict(seq=6, op="delete", id="N1"),
            dict(seq=7, op="save", id="N3", entity="rust", name="anyhow")]
    root = tempfile.mkdtemp(prefix="stream-test-")
    src = os.path.join(root, "src")
    st.write_in_order(log(spark, rows), src, "seq", 3)
    q = st.start_change_stream(spark, src, root, docs, ents, compact_every=2)
    q.awaitTermination()
    streamed = sorted((r.id, r.title, r.content) for r in st.latest_snapshot(spark, root).collect())
    batch, _ = chg.apply_changes(docs, ents, log(spark, rows))
    assert streamed == sorted((r.id, r.title, r.content) for r in batch.collect())
    assert [r[0] for r in streamed] == ["N3"]
    assert os.path.isdir(os.path.join(root, "compacted", "upto=1"))  # compaction ran and is used


def test_segments_of_several_files_stay_in_order(spark):
    ents = make_entities(spark, ["rust"])
    docs = make_docs(spark, [dict(id=f"D{i}", entity="rust", name=f"n{i}") for i in range(40)]).repartition(6)
    rows = [dict(seq=1, op="update", id="D1", title="t1"), dict(seq=2, op="delete", id="D1"),
            dict(seq=3, op="save", id="N1", entity="rust", name="n1", title="a"), dict(seq=4, op="update", id="N1", title="b")]
    root = tempfile.mkdtemp(prefix="stream-test-")
    src = os.path.join(root, "src")
    st.write_in_order(log(spark, rows), src, "seq", 2, files=3)  # two rows a segment: a file of each stays empty
    assert len([f for f in os.listdir(src) if f.endswith(".parquet")]) == 6
    st.start_change_stream(spark, src, root, docs, ents, 3).awaitTermination()
    assert sorted(os.listdir(os.path.join(root, "upserts")))[-1] == "batch=1"  # a micro-batch a segment
    batch, _ = chg.apply_changes(docs, ents, log(spark, rows))
    assert sorted((r.id, r.title) for r in st.latest_snapshot(spark, root).collect()) == sorted((r.id, r.title) for r in batch.collect())
    base = os.path.join(root, "upserts", "batch=-1")
    for bucket in [d for d in os.listdir(base) if d.startswith("idb=")]:  # not one for every writing task
        assert len([f for f in os.listdir(os.path.join(base, bucket)) if f.endswith(".parquet")]) == 1
