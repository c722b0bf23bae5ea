import numpy as np
import pyarrow.parquet as pq

from vellum.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = langid.op2_langid(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 200 and np.mean(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


EN, DE = "the house and the garden with that thing", "der garten und das haus mit dem ding auch"


def _model(make):
    return langid.fit(make([(i, f"{EN} {i}", "en") for i in range(60)] + [(i, f"{DE} {i}", "de") for i in range(60, 120)] + [(500, "x", None)]))


def test_mixtures_and_odd_rows(make):
    m = _model(make)
    assert m.langs == ["de", "en"]
    rows = [(1, f"{EN} " * 30 + f"{DE} " * 10, "de"), (2, EN, None), (3, None), (4, ""), (5, "12 34 !!"), (None, DE), (2, EN), (7, f"{DE} " * 40_000)]
    docs = make(rows)
    out = {r.doc_id: r for r in langid.languages(docs, m).collect()}
    assert langid.languages(docs, m).count() == 8
    assert out[1].lang_pred == "en" and abs(out[1].mixture["en"] - 0.75) < 0.1 and set(out[1].mixture) == {"de", "en"}
    assert set(out[2].mixture) == {"en"} and out[7].lang_pred == "de" and out[None].lang_pred == "de"
    assert {out[k].lang_pred for k in (3, 4, 5)} == {"und"} and {out[k].score for k in (3, 4, 5)} == {0.0}
    assert langid.languages(docs.limit(0), m).count() == 0


def test_nothing_to_learn_from(make):
    docs = make([(1, EN, None), (2, DE, None)])
    assert {r.lang_pred for r in langid.languages(docs, langid.fit(docs)).collect()} == {"und"}


def test_inference_beats_every_other_mixture():
    rng = np.random.default_rng(1)
    log = np.log(rng.uniform(0.01, 1, (40, 3))).astype(np.float32)
    n = rng.integers(1, 5, 40).astype(np.float32)
    doc = np.repeat([0, 2], 20)
    shares = langid.infer(log, n, doc, 3)
    assert shares[1].sum() == 0

    def value(d, p):
        at = doc == d
        return (n[at] * np.log(np.exp(log[at]) @ p)).sum() - 0.5 * np.log(n[at].sum()) * (p > 0).sum()

    for d in (0, 2):
        mine = value(d, shares[d])
        grid = [np.array([a, b, 1 - a - b]) for a in np.linspace(0, 1, 21) for b in np.linspace(0, 1 - a, 21)]
        assert mine > max(value(d, np.clip(p, 0, 1)) for p in grid) - 0.3
