import math

from pyspark.sql import functions as F

from builders import make_docs
from vellum.operators import index as ix
from vellum.operators import search as se
from vellum.operators import snippet as sn


def clauses(spark, rows):
    return spark.createDataFrame([se.clause(**r) for r in rows],
                                 "query_id long, clause_no int, occur string, kind string, field string, "
                                 "terms array<string>, slop int, boost double").withColumn("entity", F.lit(None).cast("string"))


def run(spark, docs, rows, entity=None, k=10):
    c = clauses(spark, rows)
    if entity:
        c = c.withColumn("entity", F.lit(entity))
    c = c.withColumn("k", F.lit(k))
    return [(r.doc_id, r.score) for r in se.search(ix.build_index(docs), c).orderBy("rank").collect()]


def test_two_word_query_hits_one(spark):
    docs = make_docs(spark, [dict(id="01HZZZZ00001", entity="rust", name="anyhow-guide", title="Anyhow Guide",
                                  content="anyhow is a Rust crate that simplifies error handling",
                                  tags=["error-handling"])])
    q = [dict(query_id=1, clause_no=0, kind="term", terms=["error"]),
         dict(query_id=1, clause_no=1, kind="term", terms=["handling"])]
    hits = run(spark, docs, q)
    assert [h[0] for h in hits] == ["01HZZZZ00001"]
    assert run(spark, docs, [dict(query_id=1, clause_no=0, kind="term", terms=["python"])]) == []


def test_entity_filter(spark):
    docs = make_docs(spark, [
        dict(id="01", entity="rust", name="trait-guide", title="Trait Guide", content="Rust traits"),
        dict(id="02", entity="go", name="interface-guide", title="Interface Guide", content="Go interfaces and traits")])
    q = [dict(query_id=1, clause_no=0, kind="term", terms=["traits"])]
    assert sorted(h[0] for h in run(spark, docs, q)) == ["01", "02"]
    assert [h[0] for h in run(spark, docs, q, entity="rust")] == ["01"]


def test_bm25_value_by_hand(spark):
    docs = make_docs(spark, [dict(id="a", entity="e", name="a", title="x", content="cat cat dog", tags=[]),
                             dict(id="b", entity="e", name="b", title="y", content="dog", tags=[])])
    got = dict(run(spark, docs, [dict(query_id=1, clause_no=0, kind="term", field="content", terms=["cat"])]))
    n, df_, tf, dl, avgdl = 2, 1, 2, 3, 2.0
    idf = math.log(1 + (n - df_ + 0.5) / (df_ + 0.5))
    want = idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert abs(got["a"] - round(want, 6)) < 1e-9


def test_boolean_phrase_and_forms(spark):
    docs = make_docs(spark, [
        dict(id="1", entity="e", name="d1", content="the quick brown fox"),
        dict(id="2", entity="e", name="d2", content="brown quick the fox"),
        dict(id="3", entity="e", name="d3", content="quick fox jumps")])
    ph = run(spark, docs, [dict(query_id=1, clause_no=0, kind="phrase", terms=["quick", "brown"])])
    assert [h[0] for h in ph] == ["1"]
    sloppy = run(spark, docs, [dict(query_id=1, clause_no=0, kind="phrase", terms=["quick", "fox"], slop=1)])
    assert sorted(h[0] for h in sloppy) == ["1", "2", "3"]  # one word between is allowed
    exact = run(spark, docs, [dict(query_id=1, clause_no=0, kind="phrase", terms=["quick", "fox"])])
    assert [h[0] for h in exact] == ["3"]
    both = run(spark, docs, [dict(query_id=1, clause_no=0, kind="term", terms=["quick"], occur="must"),
                             dict(query_id=1, clause_no=1, kind="term", terms=["brown"], occur="must")])
    assert sorted(h[0] for h in both) == ["1", "2"]
    excl = run(spark, docs, [dict(query_id=1, clause_no=0, kind="term", terms=["quick"]),
                             dict(query_id=1, clause_no=1, kind="term", terms=["brown"], occur="must_not")])
    assert [h[0] for h in excl] == ["3"]
    only_not = run(spark, docs, [dict(query_id=1, clause_no=0, kind="term", terms=["brown"], occur="must_not")])
    assert only_not == []
    pp = run(spark, docs, [dict(query_id=1, clause_no=0, kind="prefix", terms=["quick", "br"])])
    assert [h[0] for h in pp] == ["1"]  # "quick brown", not "brown quick"
    pre = run(spark, docs, [dict(query_id=1, clause_no=0, kind="prefix", terms=["ju"])])
    assert [h[0] for h in pre] == ["3"]
    rng = run(spark, docs, [dict(query_id=1, clause_no=0, kind="range", field="content", terms=["jumps", "jumps"])])
    assert [h[0] for h in rng] == ["3"]
    st = run(spark, docs, [dict(query_id=1, clause_no=0, kind="set", field="content", terms=["jumps", "brown"])])
    assert sorted(h[0] for h in st) == ["1", "2", "3"] and len({h[1] for h in st}) == 1
    ex = run(spark, docs, [dict(query_id=1, clause_no=0, kind="exact", field="name", terms=["d2"])])
    assert [h[0] for h in ex] == ["2"]
    assert len(run(spark, docs, [dict(query_id=1, clause_no=0, kind="all", terms=[])], k=2)) == 2
    assert run(spark, docs, [dict(query_id=1, clause_no=0, kind="term", terms=["fox"])], k=0) == []


def test_upsert_remove_rebuild(spark):
    old = make_docs(spark, [dict(id="01", entity="rust", name="doc", title="Old Title", content="old content here")])
    new = make_docs(spark, [dict(id="01", entity="rust", name="doc", title="New Title", content="new content here")])
    idx = ix.upsert(ix.build_index(old), new)
    q = lambda t: clauses(spark, [dict(query_id=1, clause_no=0, kind="term", terms=[t])])
    assert [r.doc_id for r in se.search(idx, q("content")).collect()] == ["01"]
    assert se.search(idx, q("old")).count() == 0
    idx = ix.remove(idx, spark.createDataFrame([("01",)], "id string"))
    assert se.search(idx, q("content")).count() == 0
    three = make_docs(spark, [dict(id=i, entity="rust", name=f"doc-{i}", content=f"{w} content")
                              for i, w in [("01", "alpha"), ("02", "beta"), ("03", "gamma")]])
    idx = ix.remove(ix.build_index(three), spark.createDataFrame([("01",)], "id string"))
    assert sorted(r.doc_id for r in se.search(idx, q("content")).collect()) == ["02", "03"]


def test_snippet_highlight(spark):
    docs = make_docs(spark, [dict(id="01", entity="rust", name="doc",
                                  content="The quick brown fox jumps over the lazy dog")])
    c = clauses(spark, [dict(query_id=1, clause_no=0, kind="term", terms=["fox"])]).withColumn("k", F.lit(10))
    idx = ix.build_index(docs)
    out = sn.with_snippets(se.search(idx, c), docs, idx, c).first()
    assert out.snippets == ["The quick brown <<fox>> jumps over the lazy dog"]
    c2 = clauses(spark, [dict(query_id=1, clause_no=0, kind="term", field="title", terms=["title"])]).withColumn("k", F.lit(10))
    assert sn.with_snippets(se.search(idx, c2), docs, idx, c2).first().snippets == []


def test_snippet_fragments():
    from vellum.functions.snippet import best_fragment
    text = ("aaa " * 50) + "target word " + ("bbb " * 50)
    s = best_fragment(text, {"target": 0.5})
    assert "<<target>>" in s and len(s.replace("<<", "").replace(">>", "")) <= 150
    assert best_fragment("nothing here", {"zzz": 1.0}) is None
