"""The index stored by document shards: maintenance, ranking with bounds, query texts, whole hits."""

import os
import random
import tempfile

import pytest
from builders import make_docs
from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.operators import index as ix
from vellum.operators import ranking as rk
from vellum.operators import search as se
from vellum.operators import snippet as sn

WORDS = [f"w{i}" for i in range(40)]


def corpus(spark, seed, n, first=0, stop=True):
    rng = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        body = [rng.choice(WORDS[: rng.randrange(2, 40)]) for _ in range(rng.randrange(0, 30))]
        rows.append(dict(id=f"d{i:04d}", entity=f"e{i % 3}", name=f"n{i}", title=" ".join(body[:3]), tags=body[:1],
                         content=" ".join((["the"] * rng.randrange(1, 4) if stop else []) + body)))
    return make_docs(spark, rows)


def stored(spark, docs, buckets=4, shards=3):
    path = tempfile.mkdtemp(prefix="stored-index-")
    ix.write_index(docs, path, buckets=buckets, shards=shards)
    return ix.read_index(spark, path)


def tables(idx):
    return (sorted((r.field, r.term, r.doc_id, r.tf, r.dl, tuple(r.positions)) for r in idx.postings.collect()),
            sorted((r.field, r.doc_id, r.dl) for r in idx.doc_stats.collect()),
            sorted((r.field, r.term, r.df) for r in idx.term_stats.collect()),
            sorted((r.field, r.n_docs, round(r.avgdl, 9)) for r in idx.corpus.collect()))


def queries(spark, seed, n=12, k=5):
    rng = random.Random(seed)
    rows = []
    for q in range(n):
        for c in range(rng.randrange(1, 9)):
            rows.append((q, c, "should", "term", rng.choice([None, None, "title", "content"]), [rng.choice([*WORDS, "the", "nowhere"])], None,
                         rng.choice([1.0, 1.0, 2.0, 0.5, 0.0]), None, 0 if q == 3 else k + q))
    return spark.createDataFrame(rows, "query_id long, clause_no int, occur string, kind string, field string, terms array<string>, "
                                       "slop int, boost double, entity string, k int")


def test_maintenance_equals_a_build(spark):
    idx = stored(spark, corpus(spark, 1, 40))
    changed = corpus(spark, 2, 12, first=35)  # five known ids, seven new ones
    gone = spark.createDataFrame([("d0003",), ("d0036",), ("unknown",)], "id string")
    ix.upsert_stored(spark, idx.path, changed)
    got = ix.remove_stored(spark, idx.path, gone)
    docs = corpus(spark, 1, 40).join(changed.select("id"), "id", "left_anti").unionByName(changed).join(gone, "id", "left_anti")
    assert tables(got) == tables(stored(spark, docs))
    assert tables(ix.read_index(spark, idx.path)) == tables(got)


def test_only_touched_shards_are_rewritten_and_may_empty(spark):
    docs = corpus(spark, 4, 30)
    idx = stored(spark, docs, shards=5)

    def files():
        return {(d.split("shard=")[1].split("/")[0], f) for d, _, names in os.walk(f"{idx.path}/postings") for f in names if f.endswith(".parquet")}

    before = files()
    shard_of = {r["id"]: r["s"] for r in docs.select("id", ix.doc_shard(F.col("id"), 5).alias("s")).collect()}
    victims = [i for i, s in shard_of.items() if s == shard_of["d0001"]]
    got = ix.remove_stored(spark, idx.path, spark.createDataFrame([(v,) for v in victims], "id string"))
    after = files()
    mine = str(shard_of["d0001"])
    assert {f for f in before if f[0] != mine} == {f for f in after if f[0] != mine}
    assert not {f for f in before if f[0] == mine} & after
    rest = docs.where(~F.col("id").isin(victims))
    assert tables(got) == tables(stored(spark, rest, shards=5))
    assert se.search(got, queries(spark, 1)).where(F.col("doc_id").isin(victims)).count() == 0
    empty = ix.remove_stored(spark, idx.path, docs.select("id"))
    assert tables(empty)[:3] == ([], [], []) and rk.ranked(empty, queries(spark, 1)).count() == 0
    back = ix.upsert_stored(spark, idx.path, docs)
    assert tables(back) == tables(stored(spark, docs, shards=5))


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounds_lose_nothing(spark, seed, monkeypatch):
    docs = corpus(spark, seed, 60)
    idx = stored(spark, docs)
    q = queries(spark, seed)
    monkeypatch.setattr(rk, "PROBE", 1)
    for weak in (0.0, 0.5, 1.0):
        monkeypatch.setattr(rk, "WEAK", weak)
        assert rows_of(rk.ranked(idx, q)) == rows_of(se.search(ix.build_index(docs), q))
    longer = corpus(spark, seed + 9, 30, first=50).withColumn("content", F.concat(F.repeat(F.lit("zzz "), 200), "content"))
    idx = ix.upsert_stored(spark, idx.path, longer)  # fields are longer on average than when impacts were taken
    docs = docs.join(longer.select("id"), "id", "left_anti").unionByName(longer)
    assert rows_of(rk.ranked(idx, q)) == rows_of(se.search(ix.build_index(docs), q))


def test_bounds_leave_out_documents(spark):
    docs = corpus(spark, 5, 200)
    idx = stored(spark, docs)
    q = spark.createDataFrame([(0, i, [t]) for i, t in enumerate(["w38", "w39", "w37", "the"])], "query_id long, clause_no int, terms array<string>").withColumn("k", F.lit(2))
    c = se.normalize(q)
    w = rk.term_weights(idx, c, True)
    terms = rk._staged(rk.split_terms(w, rk.floors(idx, w, 2, True)))
    assert rk.candidates(idx, terms, True).count() < 50 < rk.scored(idx, w, True).count()
    assert rows_of(rk.ranked(idx, q)) == rows_of(se.search(idx, q))


def test_no_exchange_of_uncut_matches(spark):
    idx = stored(spark, corpus(spark, 1, 30), shards=4)
    weights = rk.term_weights(idx, se.normalize(queries(spark, 1)), True)
    plan = rk.scored(idx, weights, True)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan
    first = rk.cut(rk.scored(idx, weights, True), 5, weights.select("query_id", "k").distinct(), True)
    plan = first._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    limit = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line)
    above = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(query_id" in line)
    assert above < limit  # exchanged after the cut of each task


def test_query_texts(spark):
    docs = make_docs(spark, [
        dict(id="1", entity="rust", name="a", topic="err", title="Error handling", content="anyhow makes error handling simple", tags=["x"]),
        dict(id="2", entity="go", name="b", title="Errors", content="handling an error in Go"),
        dict(id="3", entity="rust", name="c", title="Traits", content="trait objects")])
    idx = stored(spark, docs)
    q = spark.createDataFrame([(1, "Error", None, 10), (2, "error-handling", None, 10), (3, "  ERROR\ttraits ", "rust", 10), (4, "...", None, 10),
                               (5, None, None, 10), (6, "error", None, 0), (7, "python", None, 10), (8, "error", "nobody", None)],
                              "query_id long, text string, entity string, k int")
    hits = {}
    for r in rk.search_text(idx, q).orderBy("query_id", "rank").collect():
        hits.setdefault(r.query_id, []).append(r.doc_id)
    assert sorted(hits[1]) == ["1", "2"] and hits[2] == ["1"] and sorted(hits[3]) == ["1", "3"] and set(hits) == {1, 2, 3}
    clauses = se.analyse(q)
    whole = {(r.query_id, r["rank"]): r for r in sn.whole_hits(rk.search_text(idx, q), docs, idx, clauses).collect()}
    top = whole[2, 1]
    assert (top.id, top.entity, top.topic, top.name, top.tags) == ("1", "rust", "err", "a", ["x"]) and isinstance(top.score, float)
    assert top.snippets == ["anyhow makes <<error>> <<handling>> simple"]
    third = next(r for (q, _), r in whole.items() if q == 3 and r.id == "3")
    assert third.topic is None and third.snippets == []
    text = sn.hit_text(sn.whole_hits(rk.search_text(idx, q), docs, idx, clauses)).where("query_id = 2").first()["text"]
    assert text == f"[{top.score:.2f}] a  (rust/err)\n       anyhow makes <<error>> <<handling>> simple"


def test_match_all_without_all_pairs(spark):
    docs = corpus(spark, 11, 70)
    rng = random.Random(2)
    rows = []
    for q in range(14):
        rows.append((q, 0, rng.choice(["should", "must", "should", "must_not" if q == 5 else "should"]), "all", None, [], 1.5, f"e{q % 3}" if q == 7 else None, 0 if q == 9 else rng.randrange(1, 30)))
        for c in range(1, rng.randrange(1, 5)):
            rows.append((q, c, rng.choice(["should", "must", "must_not", "should"]), "term", None, [rng.choice([*WORDS, "the", "nowhere"])], 1.0, f"e{q % 3}" if q == 7 else None, 9))
    q = spark.createDataFrame(rows, "query_id long, clause_no int, occur string, kind string, field string, terms array<string>, boost double, entity string, k int")
    q = q.withColumn("k", F.max("k").over(Window.partitionBy("query_id")))
    for idx in (ix.build_index(docs), stored(spark, docs)):
        whole, k = se._match(idx, q)
        want = rows_of(se.top_k(whole, k))
        assert rows_of(se.search(idx, q)) == want and len(want) > 60
    found, _ = se._match(idx, q, cut=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() < whole.count() and "NestedLoop" not in plan and "Cartesian" not in plan


def test_hits_read_only_their_buckets(spark):
    docs = corpus(spark, 7, 80)
    idx = stored(spark, docs)
    sn.write_documents(docs, idx.path, buckets=8)
    store = sn.read_documents(spark, idx.path)
    assert sorted(store.collect()) == sorted(docs.collect())
    q = queries(spark, 4, n=1, k=2)
    ranked = rk.ranked(idx, q)
    want = sorted(sn.whole_hits(ranked, docs, idx, q).collect())
    mine = {r["s"] for r in ranked.select(ix.doc_shard(F.col("doc_id"), 8).alias("s")).collect()}
    kept = 0
    for f in os.listdir(f"{idx.path}/documents"):
        if f.endswith(".parquet") and int(f.split("_")[-1].split(".")[0]) not in mine:
            os.replace(f"{idx.path}/documents/{f}", f"{idx.path}/documents/.{f}.away")  # read, it would fail
            kept += 1
    assert want and kept >= 5 and sorted(sn.whole_hits(ranked, store, idx, q).collect()) == want
    for f in os.listdir(f"{idx.path}/documents"):
        if f.endswith(".away"):
            os.replace(f"{idx.path}/documents/{f}", f"{idx.path}/documents/{f[1:-5]}")
    name = ix.table_name(idx.path, "documents")
    spark.sql(f"DROP TABLE {name}")  # as another session finds it
    assert sorted(sn.read_documents(spark, idx.path).collect()) == sorted(docs.collect())


def brute_slop(words, phrase, slop):
    n, out = len(phrase), 0
    for e, w in enumerate(words):
        if w == phrase[-1]:
            best, stack = None, [(e, n - 2)]
            while stack:  # every way to place the words before, latest first
                at, i = stack.pop()
                if i < 0:
                    best = at if best is None else max(best, at)
                    continue
                stack += [(p, i - 1) for p in range(at) if words[p] == phrase[i]]
            out += best is not None and e - best <= n - 1 + slop
    return out


def test_one_slop_budget_against_brute_force(spark):
    rng = random.Random(8)
    texts = {f"t{i}": [rng.choice("abc") for _ in range(rng.randrange(1, 11))] for i in range(60)}
    docs = make_docs(spark, [dict(id=i, entity="e", name=i, title="", content=" ".join(t)) for i, t in texts.items()])
    phrases = [("abc", 2), ("aba", 1), ("aa", 3), ("abca", 2), ("ab", 1)]
    q = spark.createDataFrame([(i, 0, "phrase", "content", list(p), s, 100) for i, (p, s) in enumerate(phrases)],
                              "query_id long, clause_no int, kind string, field string, terms array<string>, slop int, k int")
    for idx in (ix.build_index(docs), stored(spark, docs)):
        got = {}
        for r in se.search(idx, q).collect():
            got.setdefault(r.query_id, set()).add(r.doc_id)
        for i, (p, s) in enumerate(phrases):
            assert got.get(i, set()) == {d for d, t in texts.items() if brute_slop(t, list(p), s)}, p
    a = make_docs(spark, [dict(id="1", entity="e", name="n", title="", content="a x b y c")])
    one = q.limit(1).withColumn("slop", F.lit(1))
    assert se.search(ix.build_index(a), one).count() == 0  # two words between, in all
    assert se.search(ix.build_index(a), one.withColumn("slop", F.lit(2))).count() == 1


def test_dictionary_cuts_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abé日z0") for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    docs = make_docs(spark, [dict(id=f"{i}", entity="e", name=f"n{i}", title="", content=w) for i, w in enumerate(words)])
    pats = [("range", sorted(rng.sample(words, 2), key=str.encode)) for _ in range(12)] + [("range", ["z", "a"]), ("range", ["b", "b"])]
    pats += [("prefix", [w]) for w in ("a", "é", "ab", "日z", "zz0", "q", "")]
    q = spark.createDataFrame([(i, 0, kind, "content", t, 500) for i, (kind, t) in enumerate(pats)],
                              "query_id long, clause_no int, kind string, field string, terms array<string>, k int")
    got = {}
    for r in se.search(ix.build_index(docs), q).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    for i, (kind, t) in enumerate(pats):
        takes = (lambda w: w.startswith(t[0])) if kind == "prefix" else (lambda w: t[0].encode() <= w.encode() <= t[1].encode())
        assert got.get(i, set()) == {str(j) for j, w in enumerate(words) if takes(w)}, (kind, t)
    plan = se._expand(ix.build_index(docs), se._with_fields(se.normalize(q)), True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_maintenance_keeps_whole_shards_without_a_shuffle(spark, tmp_path):
    docs = make_docs(spark, [dict(id=f"k{i}", entity="rust", name=f"k{i}", content=f"word{i} common") for i in range(12)])
    path = str(tmp_path / "whole")
    ix.write_index(docs, path, buckets=2, shards=3)
    table = spark.table(ix.table_name(path, "postings"))
    with ix.bucketed_scans(spark):
        assert table.select("doc_id", "shard").rdd.getNumPartitions() == 3  # a task a shard
    left = ix.remove_stored(spark, path, docs.where("id <> 'k3'").select("id"))
    assert {r.doc_id for r in left.postings.select("doc_id").distinct().collect()} == {"k3"}
    assert spark.read.parquet(f"{path}/postings").select("shard", "tb").distinct().count() == 6  # folders that lost all rows are kept


def test_maintenance_writes_kept_postings_once(spark, tmp_path, monkeypatch):
    """F5 (index_upsert_corpus): no copy of the postings kept is stored before they are written."""
    docs = make_docs(spark, [dict(id=f"k{i}", entity="rust", name=f"k{i}", content=f"word{i} common") for i in range(12)])
    path = str(tmp_path / "once")
    ix.write_index(docs, path, buckets=2, shards=3)
    stored, stage = [], ix._staged
    monkeypatch.setattr(ix, "_staged", lambda df: stored.append(out := stage(df)) or out)
    changed = docs.where("id IN ('k1', 'k2')").withColumn("content", F.lit("fresh common"))
    ix.upsert_stored(spark, path, changed)
    got = ix.remove_stored(spark, path, docs.where("id = 'k3'").select("id"))
    assert {r.doc_id for d in stored if "positions" in d.columns for r in d.select("doc_id").collect()} == {"k1", "k2"}
    rest = docs.where("id NOT IN ('k1', 'k2', 'k3')").unionByName(changed)
    ix.write_index(rest, str(tmp_path / "again"), buckets=2, shards=3)
    assert tables(got) == tables(ix.read_index(spark, str(tmp_path / "again")))
