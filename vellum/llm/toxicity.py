"""Toxicity of whole documents: a recurrent network scores overlapping windows.

Training (on the driver, numpy): a bounded sample of labelled rows, at most
``SAMPLE`` documents of each label and ``SAMPLE_WINDOWS`` windows of each.
Documents are labelled, not windows: after some epochs on every window, a
toxic document teaches with the windows that score highest. A fifth of the
sample is kept from training and sets the map from a document's highest
window logit to its score.

Scoring (on Spark): one narrow pass without shuffle. A window of ``WINDOW``
words starts every ``STRIDE`` words, all windows are scored, the highest
decides. So any ``WINDOW - STRIDE + 1`` words in a row are read together. A task holds a bounded table of words it has met and a
bounded number of windows.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import gru
from vellum.llm.common import WordTable, batch, chunks, table

SAMPLE = 2000
SAMPLE_WINDOWS = 10
WINDOW, STRIDE = 64, 12
TRAIN_STRIDE = 56  # training reads each word once or twice
EPOCHS, BATCH, RATE = 9, 192, 0.01
LEAST_STEPS = 150  # a small sample is read in more epochs
WORD_DROP = 0.5
FOLD = 5  # rows whose crc32 of the id is divisible by this are held out


def window_starts(n: int, stride: int | None = None) -> list[int]:
    """Starts of the windows that cover n words; the last ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, stride or STRIDE), n - WINDOW]


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split() or [""]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLD == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, label, check, text): at most ``size`` documents of each label, by hash of the id.

    Learns from labels 0 and 1 of ids outside the held-out fold; of repeated
    labels the highest counts; of repeated ids one row. ``check`` marks the
    fifth that sets the score's scale.
    """
    y = (labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
         .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label")))
    y = y.withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = y.join(d.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    few = known.where("label = 1").orderBy("h").limit(size).union(known.where("label = 0").orderBy("h").limit(size))
    return d.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).select(
        "doc_id", "label", (F.pmod("h", F.lit(5)) == 0).alias("check"), "text")


def _sample_windows(rows: DataFrame) -> list:
    """Windows of the sampled documents, at most ``SAMPLE_WINDOWS`` of each, by hash of their place."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("words", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for i, y, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "text"))):
                words = tokens(t)
                starts = window_starts(len(words), TRAIN_STRIDE)
                if len(starts) > SAMPLE_WINDOWS:
                    starts = sorted(starts, key=lambda s: crc32(f"{i}/{s}".encode()))[:SAMPLE_WINDOWS]
                out += [(i, y, " ".join(words[s:s + WINDOW])) for s in starts]
            if out:
                yield batch(schema, [list(x) for x in zip(*out)])

    return sorted(map(tuple, rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, words string").collect()))


def train(windows: list, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters of the network from (doc_id, label, words) windows."""
    p = gru.init(seed)
    if not windows:
        return p
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    seqs = [np.array([vocab.setdefault(x, len(vocab)) for x in w.split(" ")], np.int32) for _, _, w in windows]
    names = list(vocab)
    texts = [[names[k] for k in s] for s in seqs]  # one string per distinct word
    doc = np.unique([d for d, _, _ in windows], return_inverse=True)[1]
    y = np.array([x for _, x, _ in windows], np.float32)
    word, gram, of = gru.word_features(names)
    order = np.argsort(of, kind="stable")
    gram, of = gram[order].astype(np.int32), of[order].astype(np.int32)
    first = np.searchsorted(of, np.arange(len(names) + 1))
    opt = gru.Adam(p, RATE)

    def pack(rows):
        sizes = np.array([len(seqs[i]) for i in rows])
        flat = np.concatenate([seqs[i] for i in rows])
        used, at = np.unique(flat, return_inverse=True)
        ids = np.zeros((sizes.max(), len(rows)), np.int64)
        ids[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(rows)), sizes)] = at
        n = first[used + 1] - first[used]
        g = np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return (word[used], gram[g], np.repeat(np.arange(len(used)), n)), ids, sizes

    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(windows)))
    for epoch in range(epochs):
        use = np.arange(len(windows))
        if 9 * epoch >= 2 * epochs:
            score = score_windows(p, texts)
            best = np.full(doc.max() + 1, -np.inf)
            np.maximum.at(best, doc, score)
            use = np.flatnonzero((y == 0) | (score >= np.minimum(best[doc], 2.0)))
        pos = max(1.0, float(y[use].sum()))
        weight = np.where(y == 1, min(6.0, max(1.0, (len(use) - pos) / pos)), 1.0).astype(np.float32)
        rng.shuffle(use)
        use = use[np.argsort(np.array([len(seqs[i]) for i in use]) // 16, kind="stable")]
        parts = [use[k:k + BATCH] for k in range(0, len(use), BATCH)]
        opt.rate = RATE * (1 - epoch / epochs) + 0.001
        for k in rng.permutation(len(parts)):
            features, ids, sizes = pack(parts[k])
            keep = (rng.random(len(features[0])) >= WORD_DROP).astype(np.float32)
            opt.step(p, gru.gradients(p, features, ids, sizes, y[parts[k]], weight[parts[k]], keep)[1])
    return p


def score_windows(p: dict, texts: list[list[str]]) -> np.ndarray:
    """Logits of windows given as word lists."""
    words = WordTable(lambda w: gru.projections(p, w), 6 * gru.HIDDEN)
    return _logits(p, words, texts, [(i, 0, len(t)) for i, t in enumerate(texts)])


def _logits(p: dict, words: WordTable, texts: list[list[str]], windows: list[tuple[int, int, int]], at_once: int = 1024) -> np.ndarray:
    """Logits of (text number, start, length) windows."""
    ids = words.ids(texts)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    w = np.array(windows).reshape(-1, 3)
    order = np.argsort(w[:, 2], kind="stable")
    out = np.empty(len(w))
    gates = tuple(np.ascontiguousarray(x) for x in np.split(words.vectors, 2, 1))
    for k in range(0, len(w), at_once):
        part = order[k:k + at_once]
        sizes, begin = w[part, 2], first[w[part, 0]] + w[part, 1]
        cell = np.minimum(begin[None, :] + np.arange(sizes.max())[:, None], len(ids) - 1)
        out[part] = gru.logits(p, gates, ids[cell], sizes)
    return out


def highest(p: dict, words: WordTable, texts: list[str | None]) -> np.ndarray:
    """Highest window logit of each text."""
    out = np.empty(len(texts))
    for lo, hi in chunks(texts, 1_500_000):
        split = [tokens(t) for t in texts[lo:hi]]
        windows = [(i, s, min(WINDOW, len(t))) for i, t in enumerate(split) for s in window_starts(len(t))]
        part = np.full(hi - lo, -np.inf)
        np.maximum.at(part, [i for i, _, _ in windows], _logits(p, words, split, windows))
        out[lo:hi] = part
    return out


def fit_scale(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic fit of labels to logits, lightly ridged, by descent on standardised logits; a is positive."""
    mean, std = float(x.mean()), float(x.std()) + 1e-6
    z, w = (x - mean) / std, weight / weight.mean()
    a, b = 1.0, 0.0
    for _ in range(4000):
        r = w * (1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y)
        a, b = max(0.05, a - float((r * z).mean()) - 1e-3 * a), b - float(r.mean())
    return a / std, b - a * mean / std


class Model:
    """Network and scale; ``scores`` gives each text's score."""

    def __init__(self, p: dict, a: float, b: float):
        self.p, self.a, self.b = p, a, b

    def words(self) -> WordTable:
        return WordTable(lambda w: gru.projections(self.p, w), 6 * gru.HIDDEN)

    def scores(self, words: WordTable, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * highest(self.p, words, texts) + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """Learn from a bounded sample. Without labelled rows every score is the untrained network's."""
    rows = sample(docs, labels, size).persist()
    try:
        p = train(_sample_windows(rows.where("not check")), epochs)
        plain = Model(p, 1.0, 0.0)
        schema = pa.schema([("label", pa.int32()), ("x", pa.float64())])

        def run(batches):
            words = plain.words()
            for b in batches:
                yield batch(schema, [b.column("label"), highest(plain.p, words, b.column("text").to_pylist())])

        got = rows.where("check").select("label", "text").mapInArrow(run, "label int, x double").collect()
    finally:
        rows.unpersist()
    x, y = np.array([r.x for r in got]), np.array([r.label for r in got], float)
    if len(set(y)) < 2:
        return plain
    share = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id").cast("long"))).agg(F.avg("toxic")).first()[0]
    mine = y.mean()
    weight = np.where(y == 1, share / mine, (1 - share) / (1 - mine))
    return Model(p, *fit_scale(x, y, weight))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Null and empty texts are scored as one empty word; texts of any length in
    all their windows. A null id counts as not held out. Repeated rows score
    alike; a score of exactly one half is toxic. An empty table gives an empty
    result. Only doc_id and text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        words = model.words()
        for b in batches:
            yield batch(schema, [b.column("doc_id"), model.scores(words, b.column("text").to_pylist())])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Pipeline stage: rows that score below ``threshold``, with the columns they came with.

    The defined results are those of ``toxicity_scores``; columns of any name
    pass through as they are.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))

    def run(batches):
        words = model.words()
        for b in batches:
            keep = model.scores(words, b.column("text").cast(pa.string()).to_pylist()) < threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
