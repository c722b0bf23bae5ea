"""Hot keys: results stay exact when one term, entity or name dominates."""

import math

from pyspark.sql import functions as F

from builders import make_docs, make_entities
from test_changes import apply, simulate
from vellum.operators import index as ix
from vellum.operators import search as se


def test_hot_term_and_hot_entity_bm25_exact(spark):
    rows = []
    for i in range(60):
        ent = "hot" if i < 50 else f"cold{i}"
        words = ["the"] * (1 + i % 5) + [f"w{i % 7}"] * (i % 3) + ["rare"] * (1 if i == 42 else 0)
        rows.append(dict(id=f"D{i:03d}", entity=ent, name=f"d{i}", title="t", content=" ".join(words), tags=[]))
    docs = make_docs(spark, rows)
    q = spark.createDataFrame([se.clause(1, 0, "term", ["the"], field="content"),
                               se.clause(2, 0, "term", ["rare"], field="content")],
                              "query_id long, clause_no int, occur string, kind string, field string, "
                              "terms array<string>, slop int, boost double").withColumn("k", F.lit(100))
    got = {(r.query_id, r.doc_id): r.score for r in se.search(ix.build_index(docs), q).collect()}
    # brute force over the same definition
    toks = {r["id"]: r["content"].split() for r in rows}
    n = len(rows)
    avgdl = sum(len(t) for t in toks.values()) / n
    for qid, term in [(1, "the"), (2, "rare")]:
        df = sum(term in t for t in toks.values())
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        for d, t in toks.items():
            tf = t.count(term)
            if tf:
                want = idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
                assert abs(got[(qid, d)] - round(want, 6)) < 1e-9
    assert sum(1 for (qid, _) in got if qid == 1) == 60


def test_hot_name_many_cycles(spark):
    ents = make_entities(spark, ["rust"])
    base = [dict(id="D1", entity="rust", name="hot", title="Title")]
    docs = make_docs(spark, base)
    rows, seq = [], 1
    for cycle in range(12):            # save, duplicate save, update, delete ... on one name
        rows.append(dict(seq=seq, op="save", id=f"N{seq}", entity="rust", name="hot", title=f"t{seq}"))
        rows.append(dict(seq=seq + 1, op="save", id=f"N{seq + 1}", entity="rust", name="hot"))
        target = "D1" if cycle == 0 else f"N{seq - 4}"
        rows.append(dict(seq=seq + 2, op="update", id=target, title=f"u{seq}"))
        rows.append(dict(seq=seq + 3, op="delete", id=target))
        seq += 4
    out, rej = apply(spark, docs, ents, rows)
    want_docs, want_rej = simulate(base, {"rust"}, rows)
    assert {k: v.title for k, v in out.items()} == want_docs
    assert rej == want_rej
