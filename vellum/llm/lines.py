"""Duplicate and near-duplicate lines over a whole corpus, by deletion neighbourhoods.

A line is its lower-cased words. A line is dropped if an earlier line of the
corpus (by doc_id, then place) equals it or, for lines of at least
``MIN_WORDS`` words, is within one word edit (a word added, lost or changed).

Method: a line emits one hashed key for each variant with a word deleted,
tagged with the place, and one untagged, and its own untagged. Two lines that
differ in one word at a place share that place's tagged key; a line and the
line with one word more share the untagged key. So in the group of a key the
earliest line is a partner of all others, no pairs are formed inside it, and
a join hands each line its group's earliest. The word edit distance of these
pairs is then verified on the lines themselves.

Scale: equal lines are one line first. Before variants are made, a lossless
filter drops lines that can have no partner: with one edit, either the first
or the last half of the words is unchanged, so a partner shares the hash of a
half. Groups are reduced by minima that combine before their shuffle; joins
on hot keys are split by AQE. Texts are read again only for lines that passed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import batch, chunks, doc_rows, free_name, store, table, with_uid

MIN_WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHANGED, _LONGER, _WHOLE = 0, 1, 2


def line_words(text: str | None) -> list[list[str]]:
    """The words of each line; lines end at line feeds only."""
    return [x.split() for x in (text or "").lower().split("\n")]


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def half_keys(words: list[str]) -> list[int]:
    """Keys of the halves that a line with at most one edit would share.

    Lines of n and n or n + 1 words are compared on their first n // 2 and
    last n - n // 2 words, so a line has two keys for its own length and two
    for the length below.
    """
    out = []
    for n in (len(words), len(words) - 1):
        out.append(xxhash.xxh64_intdigest(f"{n} < " + " ".join(words[:n // 2])))
        out.append(xxhash.xxh64_intdigest(f"{n} > " + " ".join(words[len(words) - (n - n // 2):])))
    return out


def variants(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, kind) of a line's deletion neighbourhood."""
    n = len(words)
    h = np.array([_hash([w]) for w in words], np.uint64) | np.uint64(1)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(h * powers[:n], dtype=np.uint64)]
    less = sums[:n] + (sums[n] - sums[1:]) * _BACK  # without word i

    def mixed(x, length, place):
        x = (x ^ np.uint64(length)) * np.uint64(0xC2B2AE3D27D4EB4F) + place.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        return (x ^ (x >> np.uint64(31))) * _BASE

    keys = np.r_[mixed(less, n - 1, np.arange(1, n + 1)), mixed(less, n - 1, np.zeros(n)), mixed(sums[n:], n, np.zeros(1))]
    return keys, np.r_[np.full(n, _CHANGED), np.full(n, _LONGER), [_WHOLE]]


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the word edit distance is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def all_lines(docs: DataFrame, uid: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(pos, h, near, k0..k3): every line that has words, with its hash and half keys. pos orders lines."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("h", pa.int64()), ("near", pa.bool_())]
                       + [(f"k{i}", pa.int64()) for i in range(4)])

    def run(batches):
        for b in batches:
            uid, doc, texts = (b.column(c).to_pylist() for c in ("uid", "doc_id", "text"))
            for lo, hi in chunks(texts):
                rows = [(uid[i], doc[i], k, w) for i in range(lo, hi) for k, w in enumerate(line_words(texts[i])) if w]
                keys = np.array([half_keys(w) if len(w) >= min_words - 1 else [0] * 4 for *_, w in rows], np.uint64).reshape(-1, 4).view(np.int64)
                yield batch(schema, [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], _signed([_hash(r[3]) for r in rows]),
                                     [len(r[3]) >= min_words - 1 for r in rows], *keys.T])

    out = doc_rows(docs, uid).mapInArrow(run, "uid long, doc_id long, line int, h long, near boolean, k0 long, k1 long, k2 long, k3 long")
    return out.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "line").alias("pos"), "h", "near", "k0", "k1", "k2", "k3")


def near_links(docs: DataFrame, uid: str, firsts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(place, partner): distinct lines with an earlier line within one edit.

    ``firsts`` has (place, uid, line, near, k0..k3), one row per distinct line;
    ``place`` numbers them in order.
    """
    keyed = firsts.where("near").select("place", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    shared = keyed.groupBy("k").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("k")
    passed = keyed.join(shared, "k", "left_semi").select("place").distinct()
    wanted = firsts.join(passed, "place", "left_semi").groupBy("uid").agg(F.collect_list(F.struct("line", "place")).alias("want"))
    text_schema = pa.schema([("uid", pa.int64()), ("packed", pa.binary())])

    def squeeze(batches):
        coder = zstandard.ZstdCompressor(3)
        for b in batches:
            yield batch(text_schema, [b.column("uid"), [coder.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]])

    texts = doc_rows(docs, uid).select("uid", "text").mapInArrow(squeeze, "uid long, packed binary").join(wanted, "uid").select("packed", "want")
    line_schema = pa.schema([("place", pa.int64()), ("words", pa.string())])

    def read(batches):
        coder = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                words = line_words(coder.decompress(b.column("packed")[i].as_py()).decode("utf-8", "surrogatepass"))
                want = b.column("want")[i].as_py()
                yield batch(line_schema, [[w["place"] for w in want], [" ".join(words[w["line"]]) for w in want]])

    kept = store(texts.mapInArrow(read, "place long, words string"), "near-lines")
    key_schema = pa.schema([("key", pa.int64()), ("tagged", pa.int64())])

    def emit(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                made = [variants(w.split(" ")) for w in part.column("words").to_pylist()]
                place = np.repeat(part.column("place").to_numpy(), [len(k) for k, _ in made])
                yield batch(key_schema, [np.concatenate([k for k, _ in made]).view(np.int64), place * 2 + np.concatenate([k == _WHOLE for _, k in made])])

    spread = kept.mapInArrow(emit, "key long, tagged long")  # the place, and whether the key is the whole line's
    whole, place = F.col("tagged") % 2 == 1, F.shiftright("tagged", 1)
    groups = spread.groupBy("key").agg(F.min(F.when(~whole, place)).alias("shorter"), F.min(F.when(whole, place)).alias("whole"),
                                       F.count("*").alias("members")).where("members > 1").drop("members")
    # Without a whole line the key's members differ in one word at one place, or only in what they lack: verified below.
    met = spread.join(groups, "key").withColumn("place", place)
    met = met.withColumn("partner", F.explode(F.array_compact(F.array("shorter", "whole")))).where("partner < place")
    pairs = met.select("place", "partner").distinct()
    pairs = pairs.join(kept.select("place", F.col("words").alias("a")), "place").join(
        kept.select(F.col("place").alias("partner"), F.col("words").alias("b")), "partner")
    out = pa.schema([("place", pa.int64()), ("partner", pa.int64())])

    def verify(batches):
        for b in batches:
            sides = [[w.split(" ") for w in b.column(c).to_pylist()] for c in "ab"]
            ok = pa.array([max(len(x), len(y)) >= min_words and within_one(x, y) for x, y in zip(*sides)], pa.bool_())
            yield batch(out, [b.column("place").filter(ok), b.column("partner").filter(ok)])

    return pairs.mapInArrow(verify, "place long, partner long")


def dropped_lines(docs: DataFrame, uid: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, dropped): per row the line numbers (from 0, ascending) that repeat an earlier line, exactly or nearly."""
    lines = store(all_lines(docs, uid, min_words), "lines")
    firsts = store(lines.groupBy("h").agg(F.min("pos").alias("pos"), F.max("near").alias("near"),
                                          *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)]), "first-lines")
    firsts = store(firsts.repartitionByRange("pos").sortWithinPartitions("pos").withColumn("place", F.monotonically_increasing_id()).select(
        "place", "h", "pos", F.col("pos.uid").alias("uid"), F.col("pos.line").alias("line"), "near", "k0", "k1", "k2", "k3"), "placed-lines")
    near = near_links(docs, uid, firsts, min_words).select("place").distinct().withColumn("repeats", F.lit(True))
    state = firsts.select("place", "h", F.col("pos").alias("first")).join(near, "place", "left")
    gone = lines.select("pos", "h").join(state, "h").where(F.coalesce("repeats", F.lit(False)) | (F.col("first") < F.col("pos")))
    return gone.groupBy(F.col("pos.uid").alias("uid")).agg(F.array_sort(F.collect_list("pos.line")).alias("dropped"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, doc_id, n_lines, n_dropped, dropped), one row per input row.

    Lines without words are kept. Null and empty texts are one empty line.
    Repeated rows repeat their lines: the first in the table keeps them. Of
    lines equally early in the corpus none are: doc_id, row and line number
    order them all. Null ids come after all others. A text of any length is
    read whole. An empty table gives an empty result. Only doc_id and text are
    read, so extra columns of any name do no harm.
    """
    docs, uid = with_uid(docs)
    none = F.array().cast("array<int>")
    rows = doc_rows(docs, uid).select("uid", "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    return rows.join(dropped_lines(docs, uid, min_words), "uid", "left").select(
        "uid", "doc_id", "n_lines", F.size(F.coalesce("dropped", none)).alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines; rows that lose none, and null texts, are as before."""
    docs, uid = with_uid(docs)
    drop = free_name(docs, "__dropped")
    gone = dropped_lines(docs, uid, min_words).withColumnRenamed("uid", uid).withColumnRenamed("dropped", drop)
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(drop, i))
    return docs.join(gone, uid, "left").withColumn(
        "text", F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop(uid, drop)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("uid")
