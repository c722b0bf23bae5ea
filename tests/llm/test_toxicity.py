import random
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest

from vellum.llm import gru, toxicity

SF = "/root/testdata/sf0.1"


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in gru.init(3).items()}
    words = ["alpha", "beta", "gamma", "x", "", "delta9"]
    features = gru.word_features(words)
    ids = rng.integers(0, len(words), (5, 4))
    sizes, y, weight = np.array([5, 3, 1, 4]), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])
    keep = np.array([1, 0, 1, 1, 1, 1], np.float64)
    _, g = gru.gradients(p, features, ids, sizes, y, weight, keep)
    for name in p:
        flat, grad = p[name].reshape(-1), g[name].reshape(-1)
        where = np.argsort(-np.abs(grad))[:3] if name in ("word", "gram") else rng.integers(0, len(flat), 3)
        for i in where:
            old, e = flat[i], 1e-3
            flat[i] = old + e
            up = gru.gradients(p, features, ids, sizes, y, weight, keep)[0]
            flat[i] = old - e
            down = gru.gradients(p, features, ids, sizes, y, weight, keep)[0]
            flat[i] = old
            assert abs((up - down) / (2 * e) - grad[i]) < 2e-3 + 0.02 * abs(grad[i]), name


def test_windows_cover_every_word():
    for n in (1, 63, 64, 65, 120, 121, 1000):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))
        if n > toxicity.WINDOW:
            assert starts[-1] == n - toxicity.WINDOW


def test_windows_score_alike_in_any_batch():
    p = gru.init(5)
    rng = random.Random(1)
    texts = [[rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(1, 65))] for _ in range(40)]
    whole = toxicity.score_windows(p, texts)
    alone = np.concatenate([toxicity.score_windows(p, [t]) for t in texts])
    assert np.allclose(whole, alone, atol=1e-5)


def test_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = toxicity.op9_toxicity(spark, SF).collect()
    assert len(rows) == pq.read_table(f"{SF}/documents.parquet").num_rows
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = [r for r in rows if r.held_out and r.doc_id in labels]
    pos = [r.score for r in known if labels[r.doc_id]]
    neg = [r.score for r in known if not labels[r.doc_id]]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in neg] for a in pos])
    assert auc > 0.93
    assert np.mean([s >= 0.5 for s in pos]) > 0.75 and np.mean([s >= 0.5 for s in neg]) < 0.04


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    words = ["tree", "house", "river", "stone", "cloud", "paper"]
    rows = []
    for i in range(240):
        t = [rng.choice(words) for _ in range(30)]
        if i % 3 == 0:
            t[rng.randrange(30)] = "vermin"
        rows.append((i, int(i % 3 == 0), " ".join(t)))
    return toxicity.Model(toxicity.train(rows), 1.0, 0.0)


def test_one_bad_word_deep_in_a_long_text(model, make):
    clean = "tree house river stone cloud paper " * 4000
    docs = make([(1, clean + "vermin " + clean), (2, clean), (3, None), (4, ""), (None, "vermin tree"), (2, clean)])
    rows = {(r.doc_id, r.held_out): r for r in toxicity.toxicity_scores(docs, model).collect()}
    assert toxicity.toxicity_scores(docs, model).count() == 6
    assert rows[(1, False)].predicted == 1 and rows[(2, False)].predicted == 0 and rows[(None, False)].predicted == 1
    assert {(r.doc_id, r.held_out) for r in rows.values()} >= {(3, False), (4, False)}
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_no_labels_and_empty_tables(spark, make):
    docs = make([(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, labels)
    assert toxicity.toxicity_scores(docs, m).count() == 2
    assert toxicity.fit(docs.limit(0), labels.limit(0)).a == 1.0


@pytest.mark.parametrize("shift", [-9.0, 0.0, 9.0])
def test_scale_parts_separate_and_mixed_logits(shift):
    rng = np.random.default_rng(4)
    for far in (1.0, 10.0):
        y = np.repeat([1.0, 0.0], [400, 400])
        x = np.where(y == 1, far, -far) + rng.normal(0, 1.0, 800) + shift
        a, b = toxicity.fit_scale(x, y, np.where(y == 1, 0.2, 1.8))
        hit = a * x + b >= 0
        assert a > 0 and hit[y == 0].mean() < 0.05 and hit[y == 1].mean() > (0.98 if far > 5 else 0.3)


@pytest.mark.parametrize("n", [400, 399, 129])
def test_a_short_cluster_is_read_whole_at_every_offset(n):
    cluster = toxicity.WINDOW * 3 // 4
    for at in range(n - cluster + 1):
        assert any(s <= at and at + cluster <= s + toxicity.WINDOW for s in toxicity.window_starts(n)), at


def test_scoring_pass_equals_training_pass():
    rng = np.random.default_rng(6)
    p = gru.init(6)
    gates = rng.standard_normal((50, 6 * gru.HIDDEN)).astype(np.float32)
    for sizes in (rng.integers(1, 65, 30), np.full(30, 64)):
        ids = rng.integers(0, 50, (64, 30))
        halves = tuple(np.ascontiguousarray(x) for x in np.split(gates, 2, 1))
        assert np.allclose(gru.forward(p, gates, ids, sizes), gru.logits(p, halves, ids, sizes), atol=1e-5)


def test_held_out_labels_do_not_move_the_scale(spark, make):
    rows = [(i, ("vermin " if i % 3 == 0 else "tree ") * 3 + "house river") for i in range(120)]
    kept = [(i, 1, int(i % 3 == 0)) for i, _ in rows if crc32(str(i).encode()) % toxicity.FOLD]
    fold = [(i, 1, 1) for i, _ in rows if crc32(str(i).encode()) % toxicity.FOLD == 0]
    docs, schema = make(rows), "doc_id long, quality int, toxic int"
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, schema)) for x in (kept, kept + fold))
    assert len(fold) > 5 and a.b != 0 and np.allclose([a.a, a.b], [b.a, b.b], rtol=1e-6)


def test_training_takes_whole_words_and_any_window(spark):
    text = " ".join(f"{'x' * 50}{k}" for k in range(64 + 56 * 30))
    rows = spark.createDataFrame([(i, 0, text) for i in range(40)], "doc_id long, label int, text string")
    windows = toxicity._sample_windows(rows)
    assert len(windows) == 40 * toxicity.SAMPLE_WINDOWS
    words = [w.split(" ") for _, _, w in windows]
    assert all(len(x) > 50 for w in words for x in w)
    assert {w[0] for w in words} == {f"{'x' * 50}{k}" for k in toxicity.window_starts(64 + 56 * 30, toxicity.TRAIN_STRIDE)}
