"""Language of whole documents as the largest part of an inferred mixture.

Model: per language, frequencies of hashed character trigrams of ``^word$``,
counted by Spark over the whole texts of a bounded sample of labelled rows
(at most ``SAMPLE`` documents of each language). A word's likelihood in a
language is the product of its trigrams' smoothed frequencies.

Inference: a document is a mixture of languages. Expectation-maximisation
estimates the proportions from the word likelihoods; then the language of
least share is taken out, the rest refitted, and the smaller set kept while
its penalised likelihood (half the logarithm of the word count per language)
is no worse. All documents of an Arrow batch are inferred together in numpy.
One narrow pass, no shuffle; a task holds a bounded table of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import WordTable, batch, chunks, gram_ids, letters_only, table

SAMPLE = 1500
GRAM = (3,)
BITS = 15
SMOOTH = 0.5
ROUNDS = 12
FOLD, HELD = 4, 2  # rows whose crc32 of the id leaves HELD are held out
UNKNOWN = "und"


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLD == HELD, F.lit(False))


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def gram_counts(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(lang, gram, n) of a sample: per language the ``size`` ids of least hash, outside the held-out fold.

    Null languages and ids don't teach; of repeated ids of one language one row does.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    ids = d.select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    few = ids.withColumn("k", F.row_number().over(first)).where(F.col("k") <= size).drop("k")
    d = d.join(F.broadcast(few), ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"])
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            lang, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lo, hi in chunks(texts):
                words: dict[str, list[str]] = {}
                for x, t in zip(lang[lo:hi], texts[lo:hi]):
                    words.setdefault(x, []).extend(_words(t))
                for x, ws in words.items():
                    grams, _ = gram_ids([w for w in letters_only(ws) if w], GRAM, BITS)
                    n = np.bincount(grams, minlength=1)
                    at = np.flatnonzero(n)
                    yield batch(schema, [[x] * len(at), at.astype(np.int32), n[at]])

    return d.select("lang", "text").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Trigram log frequencies per language."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({x for x, _, _ in counts})
        n = np.zeros((1 << BITS, len(self.langs)))
        at = {x: i for i, x in enumerate(self.langs)}
        for x, g, k in counts:
            n[g, at[x]] += k
        kinds = max(1, int((n.sum(1) > 0).sum()))
        self.log = (np.log(n + SMOOTH) - np.log(n.sum(0) + SMOOTH * kinds)).astype(np.float32) if self.langs else n

    def words(self) -> WordTable:
        """Log-likelihood per language of each word, and whether it has a letter (last column)."""
        def compute(words):
            clean = letters_only(words)
            grams, of = gram_ids(clean, GRAM, BITS)
            out = np.zeros((len(words), len(self.langs) + 1), np.float32)
            for k in range(len(self.langs)):
                out[:, k] = np.bincount(of, self.log[grams, k], minlength=len(words))
            out[:, -1] = [bool(w) for w in clean]
            return out

        return WordTable(compute, len(self.langs) + 1)

    def mixtures(self, table_: WordTable, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, whether the text has a letter): the chosen languages' shares, others 0."""
        split = [_words(t) for t in texts]
        ids = table_.ids(split)
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        lettered = table_.vectors[:, -1] > 0 if len(ids) else np.zeros(0, bool)
        inside = lettered[ids] if len(ids) else np.zeros(0, bool)
        key, n = np.unique(doc[inside] * np.int64(len(table_.vectors) + 1) + ids[inside], return_counts=True)
        doc, word = key // (len(table_.vectors) + 1), key % (len(table_.vectors) + 1)
        known = np.bincount(doc, minlength=len(texts)) > 0
        shares = infer(table_.vectors[word, :-1], n.astype(np.float32), doc, len(texts)) if len(self.langs) else np.zeros((len(texts), 0))
        return shares, known


def infer(log: np.ndarray, n: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Mixture proportions of each document from its words' log-likelihoods and counts; ``doc`` ascends."""
    langs = log.shape[1]
    shares = np.zeros((docs, langs), np.float32)
    if not len(doc):
        return shares
    like = np.exp(log - log.max(1, keepdims=True))
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[first, len(doc)])
    total = np.add.reduceat(n, first)
    penalty = 0.5 * np.log(np.maximum(total, 2))

    def fit(active, like, n, first, size, total, rounds):
        """(proportions, log-likelihood) with only the active languages."""
        part = active / active.sum(1, keepdims=True)
        row = np.repeat(np.arange(len(first)), size)
        for _ in range(rounds):
            post = like * part[row]
            mass = post.sum(1) + np.float32(1e-30)
            part = part * np.add.reduceat(like * (n / mass)[:, None], first) / total[:, None]
            part /= part.sum(1, keepdims=True) + np.float32(1e-30)
        mass = (like * part[row]).sum(1) + np.float32(1e-30)
        return part, np.add.reduceat(n * np.log(mass), first)

    active = np.ones((len(first), langs), np.float32)
    best, fitness = fit(active, like, n, first, size, total, ROUNDS)
    fitness -= penalty * langs
    open_ = np.arange(len(first))  # documents whose set may still shrink
    for left in range(langs - 1, 0, -1):
        rows = np.repeat(np.isin(np.arange(len(first)), open_), size)
        trial = active[open_].copy()
        trial[np.arange(len(open_)), np.where(trial > 0, best[open_], 2).argmin(1)] = 0
        s = size[open_]
        part, value = fit(trial, like[rows], n[rows], np.cumsum(s) - s, s, total[open_], ROUNDS // 2)
        value -= penalty[open_] * left
        better = value >= fitness[open_]
        open_ = open_[better]
        active[open_], best[open_], fitness[open_] = trial[better], part[better], value[better]
        if not len(open_):
            break
    shares[doc[first]] = best
    return shares


def fit(docs: DataFrame, size: int = SAMPLE) -> Model:
    """The trigram tables; at most one row per language and hashed trigram reaches the driver."""
    return Model([tuple(r) for r in gram_counts(docs, size).collect()])


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture), one row per input row.

    ``score`` is the predicted language's share of the words; ``mixture`` maps
    the chosen languages to their shares. Null texts and texts without a
    letter are ``und`` with score 0, as is everything if no row could teach.
    Ties go to the first language in order. A null id counts as not held out.
    Texts of any length are read whole, repeated rows come out alike. An empty
    table gives an empty result. Only doc_id and text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("mixture", pa.map_(pa.string(), pa.float64()))])

    def run(batches):
        words = model.words()
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for lo, hi in chunks(texts, 1_500_000):
                shares, known = model.mixtures(words, texts[lo:hi])
                top = shares.argmax(1) if shares.shape[1] else np.zeros(hi - lo, int)
                ok = known & bool(model.langs)
                score = np.where(ok, shares[np.arange(hi - lo), top], 0) if model.langs else np.zeros(hi - lo)
                yield batch(schema, [
                    ids.slice(lo, hi - lo), [model.langs[k] if o else UNKNOWN for k, o in zip(top, ok)],
                    np.clip(score, 0, 1).astype(float),
                    [[(model.langs[k], float(s)) for k, s in enumerate(row) if s > 0] if o else [] for row, o in zip(shares, ok)]])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, mixture map<string, double>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, fit(docs)).drop("mixture")
