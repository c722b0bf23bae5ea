"""Packing token sequences by minimum bin slack.

Each document's tokens (closed by an end id) are cut into full windows and
one remainder. Remainders are packed: a window is opened with the largest
remainder left, a subset-sum over the multiset of remaining lengths, held as
one big integer of reachable sums per length, finds the sum closest to the
window's rest, and walking back over the integers gives how many of each
length to take.

Tokens are counted and summed where the text is read, so only piece lengths
are shuffled. Remainders are dealt evenly, by hash of the row, to groups of
about ``GROUP`` pieces that pack independently; each wastes at most the end
of its last windows.
"""

from __future__ import annotations

from bisect import bisect_right
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.bpe import coder, slices
from vellum.llm.common import batch, store, table

WINDOW = 2048
END_ID = 1
GROUP = 4096


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document cut into windows and a remainder.

    Ids are the tokenizer's without added tokens but those that stand in the
    text, then ``end_id``. Null ids and repeated rows are rows like any
    others; null and empty texts are one end id; a text of any length is cut
    whole. An empty table gives an empty result. Only doc_id and text are read.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)
    sql = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches):
        code = coder(path)
        for b in batches:
            for lo, hi in slices(b.column("text")):
                ids, offsets = code.encode(b.column("text").slice(lo, hi - lo))
                ids = np.insert(ids, offsets[1:], end_id)  # one after each document
                offsets = offsets + np.arange(len(offsets))
                n = np.diff(offsets)
                cuts = -(-n // window)
                doc = np.repeat(np.arange(len(n)), cuts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
                length = np.minimum(window, n[doc] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = offsets[doc] + start
                crc = [crc32(raw[4 * x:4 * y]) for x, y in zip(at.tolist(), (at + length).tolist())]
                out = [b.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)), start, length, crc, n[doc]]
                if with_ids:  # pieces follow one another
                    out.append(pa.ListArray.from_arrays(np.r_[at, len(ids)].astype(np.int32), ids.astype(np.int32)))
                yield batch(schema, out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, sql)


def fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length to take for the sum closest to ``room`` from below.

    ``lengths`` are the keys of ``counts`` in ascending order. Reachable sums
    are the set bits of an integer; one integer is kept per length tried,
    largest first, until ``room`` itself is reachable.
    """
    full, reach = (2 << room) - 1, 1
    layers: list[tuple[int, int]] = []  # length, sums reachable before it
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        size = lengths[k]
        layers.append((size, reach))
        for _ in range(min(counts[size], room // size)):
            more = (reach | reach << size) & full
            if more == reach:
                break
            reach = more
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for size, before in reversed(layers):
        n = 0
        while not before >> at & 1:
            at -= size
            n += 1
        if n:
            taken[size] = n
    return taken


def min_bin_slack(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Item numbers of each window; every item is in exactly one, no sum exceeds ``window``."""
    items: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        items.setdefault(n, []).append(i)
    counts = {n: len(x) for n, x in items.items()}
    lengths = sorted(counts)
    out = []

    def take(n: int, k: int) -> list[int]:
        counts[n] -= k
        got = items[n][-k:]
        del items[n][-k:]
        if not counts[n]:
            lengths.pop(bisect_right(lengths, n) - 1)
        return got

    while lengths:
        first = lengths[-1]
        one = take(first, 1)
        for n, k in fill(counts, lengths, window - first).items():
            one += take(n, k)
        out.append(one)
    return out


def pack(cut: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``pieces`` with their sequence and place in it.

    Sequences have at most ``window`` tokens and no gaps. Pieces need not be
    distinct: they are numbered as they are stored, and only the stored
    numbers are read after. Of pieces of equal length any may come first. An
    empty table gives an empty result.
    """
    cut = store(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rest = cut.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))
    schema = pa.schema([("row", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(key, t):
        row, n = t.column("row").to_numpy(), t.column("length").to_numpy()
        order = np.lexsort((row, n))
        bins = min_bin_slack(n[order].tolist(), window)
        rows, seq, off = [], [], []
        for k, items in enumerate(bins):
            at = 0
            for i in items:
                rows.append(row[order[i]])
                seq.append(2 * (k * groups + key[0].as_py()) + 1)
                off.append(at)
                at += int(n[order[i]])
        return pa.table([pa.array(rows, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], schema=schema)

    dealt = rest.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"))
    placed = dealt.groupBy("grp").applyInArrow(run, "row long, sequence_id long, offset long")
    whole = cut.where(F.col("length") >= window).withColumn("sequence_id", 2 * F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return whole.drop("row").unionByName(rest.join(placed, "row").drop("row"))


def pack_documents(docs: DataFrame, window: int = WINDOW, group: int = GROUP, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece of ``pieces``."""
    return pack(pieces(docs, window, path=path), window, group)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: pieces in sequences, with the defined results of ``pieces`` and ``pack``."""
    return pack_documents(docs)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
