"""Queries folded in blocks of documents, and postings counted where documents are read."""

import random
from dataclasses import replace

import numpy as np
from builders import make_docs
from pyspark.sql import functions as F

from vellum.operators import index as ix
from vellum.operators import search as se
from vellum.operators.fold import phrase_hits


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _docs(spark):
    return make_docs(spark, [dict(id=f"d{i:03d}", entity="e", name=f"n{i}", content="the of " + f"w{i % 3}") for i in range(40)])


def test_no_row_for_a_pair_of_query_and_document(spark):
    q = spark.createDataFrame([(i, 0, "must", "term", [w], 3) for i in range(30) for w in ("the", "of")],
                              "query_id long, clause_no int, occur string, kind string, terms array<string>, k int")
    hits = se.search(ix.build_index(_docs(spark)), q)
    assert "Aggregate [query_id" not in _plan(hits)
    got = hits.collect()
    assert len(got) == 90 and all([r.doc_id for r in got if r.query_id == i] == ["d000", "d001", "d002"] for i in range(30))


def test_postings_take_no_shuffle_of_tokens(spark):
    postings = ix.build_index(_docs(spark)).postings
    assert "Aggregate" not in _plan(postings)
    assert sorted(postings.where("term = 'of' and field = 'content'").select("positions").first()[0]) == [1]


def test_copies_of_an_id_are_counted_together(spark):
    docs = make_docs(spark, [dict(id="a", entity="e", name="n", content="x y x")] * 2 + [dict(id="b", entity="e", name="m", content="x")])
    got = ix.build_index(docs).postings.where("field = 'content'").select("doc_id", "term", "tf", "positions").collect()
    assert sorted((r.doc_id, r.term, r.tf, r.positions) for r in got) == [
        ("a", "x", 4, [0, 0, 2, 2]), ("a", "y", 2, [1, 1]), ("b", "x", 1, [0])]


def test_batches_cut_within_an_id(spark):
    docs = make_docs(spark, [dict(id=f"d{i % 7}", entity="e", name="n", content="x y x") for i in range(21)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = ix.build_index(docs).postings.where("field = 'content' and term = 'x'").select("tf").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.tf for r in got] == [6] * 7


def test_phrases_against_brute_force():
    rng = random.Random(5)
    texts = [[rng.choice("abcde") for _ in range(rng.randrange(1, 25))] for _ in range(40)]
    words = [b"a", b"b", b"c", b"d", b"e"]
    rows = sorted({(words.index(w.encode()), d) for d, t in enumerate(texts) for w in t})
    places = [[i for i, w in enumerate(texts[d]) if w.encode() == words[t]] for t, d in rows]
    phrases = {(tuple(rng.choice(words) for _ in range(n)), slop, False) for n in (1, 2, 3, 4) for slop in (0, 1, 3) for _ in range(12)}
    phrases |= {((rng.choice(words), rng.choice(words)), 0, True) for _ in range(5)}
    got = phrase_hits(phrases, words, np.repeat(np.arange(len(rows)), [len(p) for p in places]), np.concatenate(places),
                      np.array([d for _, d in rows]), np.array([len(texts[d]) for _, d in rows]), np.array([t for t, _ in rows]))

    def ends(text, terms, slop):
        """Last places of the phrase in ``text``."""
        walks = {(i, i) for i, w in enumerate(text) if w.encode() == terms[0]}
        for t in terms[1:]:
            walks = {(a, j) for a, i in walks for j in range(i + 1, len(text)) if text[j].encode() == t}
        return {b for a, b in walks if b - a <= len(terms) - 1 + slop}

    for terms, slop, by_prefix in phrases:
        want = {d: len(e) for d, t in enumerate(texts) if (e := ends(t, terms, slop))}
        doc, dl, n = got.get((terms, slop, by_prefix), ([], [], []))
        assert dict(zip(map(int, doc), map(int, n), strict=True)) == want, (terms, slop)
        assert all(len(texts[d]) == x for d, x in zip(doc, dl, strict=True))


def test_range_prefix_and_set_in_a_block(spark):
    docs = make_docs(spark, [dict(id=f"d{i}", entity="e", name="n", title="t", content=w) for i, w in enumerate(["ab", "abc", "b", "é", "éa", "zz"])])
    rows = [(1, "range", ["ab", "b"]), (2, "prefix", ["ab"]), (3, "set", ["é", "zz", "zz"]), (4, "prefix", ["é"]), (5, "range", ["c", "a"])]
    q = spark.createDataFrame([(i, 0, k, "content", t, 9) for i, k, t in rows],
                              "query_id long, clause_no int, kind string, field string, terms array<string>, k int")
    got = se.search(ix.build_index(docs), q).groupBy("query_id").agg(F.sort_array(F.collect_list("doc_id")).alias("d")).collect()
    assert {r.query_id: r.d for r in got} == {1: ["d0", "d1", "d2"], 2: ["d0", "d1"], 3: ["d3", "d5"], 4: ["d3", "d4"]}


def test_phrases_in_copies_of_an_id_as_match_counts_them(spark):
    docs = make_docs(spark, [dict(id="a", entity="e", name="n", content="x y z x")] * 2 + [dict(id="b", entity="e", name="m", content="z x y")])
    phrases = [["x", "y"], ["y", "x"], ["z", "x"], ["x", "z"]]
    q = spark.createDataFrame([(i, 0, "phrase", "content", t, 9) for i, t in enumerate(phrases)],
                              "query_id long, clause_no int, kind string, field string, terms array<string>, k int")
    idx = ix.build_index(docs)
    whole = se.match(idx, q).select("query_id", "doc_id", F.round("score", 6).alias("score")).collect()
    assert sorted(whole) == sorted(se.search(idx, q).select("query_id", "doc_id", "score").collect())


def test_a_search_analyses_each_document_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    docs = make_docs(spark, [dict(id=f"d{i}", entity=f"e{i % 2}", name=f"n{i}", content=f"alpha w{i} beta") for i in range(20)])
    docs = docs.withColumn("content", F.udf(read, "string")("content"))
    rows = [(1, 0, "exact", "name", ["n3"], None), (1, 1, "term", None, ["w3"], None), (2, 0, "term", None, ["alpha"], "e1"),
            (3, 0, "all", None, [], None), (4, 0, "phrase", "content", ["alpha", "w5"], None)]
    q = spark.createDataFrame(rows, "query_id long, clause_no int, kind string, field string, terms array<string>, entity string")
    got = {}
    for r in se.search(ix.build_index(docs), q).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got[1] == ["d3"] and got[4] == ["d5"] and len(got[2]) == 10 and len(got[3]) == 10
    assert seen.value == 20


def test_postings_are_the_tokens_counted(spark):
    texts = ["", "none", " ", "x", "--a b--", "x" * 39 + " " + "y" * 40 + " x", "İstanbul ΣΑΣ ΑΣ.Β Été", "Ⱥ" * 19 + " z"]
    docs = make_docs(spark, [dict(id=f"d{i}", entity="e", name="n", title="", content=t, tags=["A-b", "c"]) for i, t in enumerate(texts)])
    docs = docs.withColumn("content", F.nullif("content", F.lit("none")))
    want = {}
    for r in ix.text_tokens(docs).collect():
        want.setdefault((r.field, r.term, r.doc_id, r.dl), []).append(r.pos)
    rows = ix.build_index(docs).postings.where(F.col("field").isin("title", "content", "tags")).collect()
    assert {(r.field, r.term, r.doc_id, r.dl): r.positions for r in rows} == {k: sorted(v) for k, v in want.items()}
    assert len(rows) == len(want)


def test_phrases_with_a_prefix_take_only_places_of_neighbours(spark, monkeypatch):
    """F2 (search_phrase_prefix): the postings stored for a batch are those of its pairs; hits are those from all postings, copies of an id included."""
    rng = random.Random(3)
    words = ["ab", "abc", "b", "ba", "é", "éa", "x" * 45, "c", "日本", "日"]
    rows = [dict(id=f"d{i % 50:02d}", entity="e", name="n", title="ab b", content=" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(55)]
    rows += [dict(id=f"f{i}", entity="e", name="n", title="t", content="noise " * 20) for i in range(20)] + [rows[7]] * 2
    docs = make_docs(spark, rows)
    phrases = [["ab", "b"], ["b", "a"], ["ab", "é", "b"], ["日", "日"], ["c", ""], ["ba", "c", "ab", "a"], ["zz", "a"], ["b", "zz"]]
    made = [(i, 0, "prefix", None, t, 99) for i, t in enumerate(phrases)] + [(90, 0, "prefix", "content", ["ab", "b"], 99), (90, 1, "term", None, ["ab"], 99)]
    q = spark.createDataFrame(made, "query_id long, clause_no int, kind string, field string, terms array<string>, k int")
    idx, stored, stage = ix.build_index(docs), [], se._staged
    monkeypatch.setattr(se, "_staged", lambda df: stored.append(out := stage(df)) or out)
    got = se.search(idx, q).select("query_id", "doc_id", "score").collect()
    whole = se.search(replace(idx, docs=None), q).select("query_id", "doc_id", "score").collect()
    assert sorted(whole) == sorted(got) and len({r.query_id for r in got}) > 5
    kept = next(d for d in stored if "positions" in d.columns).where("term IS NOT NULL")
    assert kept.where("term = 'noise'").count() == 0
    assert kept.where("term = '日本'").count() < idx.postings.where("term = '日本'").count()
