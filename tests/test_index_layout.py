import os
import tempfile

from pyspark.sql import functions as F

from vellum.operators import index as ix
from vellum.operators import search as se
from vellum.sources import tables as tb
from vellum.streaming import streams as st

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_persisted_layout_equals_in_memory(spark):
    docs = tb.documents(spark, SF)
    path = tempfile.mkdtemp(prefix="index-test-")
    ix.write_index(docs, path, buckets=8)
    disk = ix.read_index(spark, path)
    mem = ix.build_index(docs)
    for form in ["term", "phrase", "phrase_slop", "phrase_prefix", "entity", "range", "not"]:
        q = tb.benchmark_clauses(spark, SF, form)
        assert _rows(se.search(disk, q)) == _rows(se.search(mem, q)), form
    assert sorted(disk.corpus.collect()) == sorted(mem.corpus.collect())


def test_document_stream_index_equals_build(spark):
    docs = tb.documents(spark, SF)
    root = tempfile.mkdtemp(prefix="stream-index-test-")
    src = os.path.join(root, "src")
    base = docs.withColumn("version", F.xxhash64("id"))
    st.write_in_order(base, src, "version", 2)
    # a new version of one document arrives last
    changed = docs.where(F.col("id") == "D00000003").withColumn("content", F.lit("replaced text zzzq")) \
        .withColumn("version", F.lit(None).cast("long"))
    changed.coalesce(1).write.mode("append").parquet(src)
    q = st.start_index_stream(spark, src, os.path.join(root, "index"), spark.read.parquet(src).schema,
                              compact_every=2)
    q.awaitTermination()
    live = st.read_stream_index(spark, os.path.join(root, "index"))
    upserted = docs.where(F.col("id") != "D00000003").unionByName(changed.drop("version"))
    want = ix.build_index(upserted).term_stats
    assert sorted(live.term_stats.collect()) == sorted(want.collect())
    assert os.path.isdir(os.path.join(root, "index", "compacted", "upto=1"))
