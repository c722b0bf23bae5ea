from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import index as ix
from vellum.operators import meta as me
from vellum.operators import search as se
from vellum.sources import tables as tb

SF = "/root/testdata/sf0.001"


def test_every_hit_contains_a_query_term(spark):
    docs = tb.documents(spark, SF)
    q = tb.or_queries(spark, SF)
    hits = se.search(ix.build_index(docs), q)
    terms = q.groupBy("query_id").agg(F.flatten(F.collect_list("terms")).alias("qt"))
    d = docs.select(F.col("id").alias("doc_id"), F.array_union(
        F.array_union(tx.terms(F.col("title")), tx.terms(F.col("content"))),
        tx.terms(tx.tags_text(F.col("tags")))).alias("dt"))
    bad = (hits.join(terms, "query_id").join(d, "doc_id")
           .where(F.size(F.array_intersect("qt", "dt")) == 0))
    assert hits.count() > 0 and bad.count() == 0


def test_phrase_hits_contain_the_phrase(spark):
    docs = tb.documents(spark, SF)
    q = tb.benchmark_clauses(spark, SF, "phrase")
    hits = se.search(ix.build_index(docs), q)
    words = q.select("query_id", F.array_join("terms", " ").alias("phrase"))
    text = docs.select(F.col("id").alias("doc_id"), F.concat_ws(
        " | ", F.array_join(tx.terms(F.col("title")), " "), F.array_join(tx.terms(F.col("content")), " "),
        F.array_join(tx.terms(tx.tags_text(F.col("tags"))), " ")).alias("t"))
    joined = hits.join(words, "query_id").join(text, "doc_id")
    # dropped long tokens leave gaps, so the joined text may be looser than the
    # positional match, never stricter
    assert joined.where(~F.col("t").contains(F.col("phrase"))).count() == 0


def test_tree_totals_equal_document_count(spark):
    docs = tb.documents(spark, SF, with_tags=False)
    t = me.tree(me.tree_counts(tb.entities(spark, SF), docs))
    assert t.agg(F.sum("document_count")).first()[0] == docs.count()


def test_incremental_equals_rebuild(spark):
    docs = tb.documents(spark, SF)
    a = docs.where(F.col("id") < "D00000100")
    b = docs.where(F.col("id") >= "D00000100")
    inc = ix.upsert(ix.build_index(a), b)
    full = ix.build_index(docs)
    assert sorted(inc.term_stats.collect()) == sorted(full.term_stats.collect())
    assert sorted(inc.corpus.collect()) == sorted(full.corpus.collect())
