"""Near-duplicate documents by SimHash fingerprints, found through anchor points.

Method: a covering code's words are the anchors. Every fingerprint is copied
to each anchor within covering radius plus threshold; two fingerprints within
the threshold then meet at the nearest anchor of either, where they are
compared.

A code on all 64 bits would copy each fingerprint to thousands of anchors, so
the bits are cut into ``bands``: of two fingerprints that differ in at most
``d`` bits, some band differs in at most ``d // bands``. Each band has its own
covering code: a Hamming code on its first 2^r - 1 bits (covering radius 1,
perfect) and every value of its other bits. With 3 bands and d = 4 a
fingerprint goes to about 41 anchors in all. Only fingerprints whose nearest
anchor this is ("homes") are compared with all that came to it.

Scale: equal fingerprints are one node. An anchor holding more than
``HOT_ANCHOR`` fingerprints is split by home over several tasks. A task emits
spanning links, not all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import batch, doc_rows, store, table, with_uid
from vellum.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
HOT_ANCHOR = 4096  # fingerprints compared by one task at one anchor
_PAIRS = 4_000_000  # pairs held at once while comparing


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: bit i is set if over half the shingle hashes have it.

    A-Z are lower-cased, words are runs of bytes other than space and tab to
    carriage return, shingles keep repeats; a text with fewer words is one
    shingle; no words (also null) gives 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle_words, len(words)) - 1:] - 1)[:n].tolist()
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[at:at + 65536], stops[at:at + 65536])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, uid: str | None = None) -> DataFrame:
    """(uid, doc_id, fp) with the fingerprint as a signed long."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in b.column("text")], np.uint64)
            yield batch(schema, [b.column("uid"), b.column("doc_id"), fps.view(np.int64)])

    return doc_rows(docs, uid).mapInArrow(run, "uid long, doc_id long, fp long")


class Band:
    """Anchors of one band: Hamming code words times all values of the free bits."""

    def __init__(self, low: int, width: int, threshold: int):
        self.low, self.width = np.uint64(low), width
        r = (width + 1).bit_length() - 1
        coded, free = (1 << r) - 1, width - ((1 << r) - 1)
        #: bit i of the coded part has check column i + 1; the syndrome is their exclusive or
        self.columns = np.arange(1, coded + 1, dtype=np.uint32)
        self.coded = coded
        flips = [[] for _ in range(1 << r)]
        self.homes = np.zeros(1 << r, np.uint64)
        for e in range(threshold + 1):
            for f in combinations(range(free), e):
                outside = sum(1 << (coded + i) for i in f)
                for k in range(threshold - e + 2):
                    for c in combinations(range(coded), k):
                        syndrome = 0
                        for i in c:
                            syndrome ^= i + 1
                        mask = outside | sum(1 << i for i in c)
                        flips[syndrome].append(mask)
                        if e == 0 and k <= 1:
                            self.homes[syndrome] = mask
        most = max(map(len, flips))
        self.sizes = np.array([len(x) for x in flips])
        self.flips = np.array([x + [0] * (most - len(x)) for x in flips], np.uint64)

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fp, anchor, is home) of every copy of every fingerprint."""
        part = (fp >> self.low) & np.uint64((1 << self.width) - 1)
        syndrome = np.zeros(len(fp), np.uint32)
        for i, c in enumerate(self.columns):
            syndrome ^= np.where((part >> np.uint64(i)) & np.uint64(1), c, np.uint32(0)).astype(np.uint32)
        n = self.sizes[syndrome]
        of = np.repeat(np.arange(len(fp)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        masks = self.flips[syndrome[of], k]
        return of, part[of] ^ masks, masks == self.homes[syndrome[of]]


def bands_of(bands: int, max_bits: int) -> list[Band]:
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [Band(a, b - a, max_bits // bands) for a, b in zip(cuts, cuts[1:])]


def copies(fps: DataFrame, max_bits: int = MAX_BITS, bands: int = 3) -> DataFrame:
    """(band, anchor, fp, home): each distinct fingerprint at every anchor it is copied to."""
    schema = pa.schema([("band", pa.int32()), ("anchor", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def run(batches):
        codes = bands_of(bands, max_bits)
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for k, code in enumerate(codes):
                for at in range(0, len(fp), 4096):
                    of, anchor, home = code.anchors(fp[at:at + 4096])
                    yield batch(schema, [np.full(len(of), k, np.int32), anchor.view(np.int64), fp[at:at + 4096][of].view(np.int64), home])

    return fps.select("fp").mapInArrow(run, "band int, anchor long, fp long, home boolean")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable, for n nodes linked by a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, rb, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _small_groups(fp: np.ndarray, home: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked row pairs (home, other) of many groups; rows are sorted by group."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    of = np.repeat(np.arange(len(starts)), sizes)
    homes = np.flatnonzero(home)
    found_a, found_b = [], []
    todo = np.cumsum(sizes[of[homes]])
    for part in np.split(homes, np.searchsorted(todo, np.arange(_PAIRS, todo[-1] if len(todo) else 0, _PAIRS))):
        n = sizes[of[part]]
        a = np.repeat(part, n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[of[part]], n)
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= max_bits) & (a != b)
        found_a.append(a[near])
        found_b.append(b[near])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, int), np.zeros(0, int))


def _large_group(fp: np.ndarray, home: np.ndarray, max_bits: int) -> np.ndarray:
    """Root of each row of one large group.

    Homes are taken in slices; after each, rows of the largest component so
    far are no longer compared with one another, so that one large group of
    near copies costs about its size, not its square.
    """
    root = np.arange(len(fp))
    homes = np.flatnonzero(home)
    step = max(1, min(64, _PAIRS // max(1, len(fp))))
    for at in range(0, len(homes), step):
        part = homes[at:at + step]
        top = np.bincount(root).argmax()
        inside = root[part] == top
        rest = np.flatnonzero(root != top)
        for mine, others in ((part[inside], rest), (part[~inside], np.arange(len(fp)))):
            if len(mine) and len(others):
                a, b = np.nonzero(np.bitwise_count(fp[mine][:, None] ^ fp[others][None, :]) <= max_bits)
                pairs_a, pairs_b = root[mine[a]], root[others[b]]
                root = _roots(pairs_a, pairs_b, len(fp))[root]
    return root


def links(fps: DataFrame, max_bits: int = MAX_BITS, bands: int = 3) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints within ``max_bits`` bits."""
    spread = copies(fps, max_bits, bands)
    hot = store(spread.groupBy("band", "anchor").count().where(F.col("count") > HOT_ANCHOR).select(
        "band", "anchor", F.ceil(F.col("count") / HOT_ANCHOR).cast("int").alias("blocks")), "hot-anchors")
    if hot.limit(1).count():
        spread = spread.join(hot, ["band", "anchor"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        spread = (spread.withColumn("own", own).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
                  .withColumn("home", F.col("home") & (F.col("own") == F.col("block"))))
    else:
        spread = spread.withColumn("block", F.lit(0))
    key = F.xxhash64("band", "anchor", "block").alias("key")
    grouped = spread.select(key, "fp", "home").repartition("key").sortWithinPartitions("key")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        def compared(key, fp, home):
            """Links of complete groups; a shared key of two anchors only adds comparisons."""
            if not home.any():
                return
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            large = sizes > 512
            for s, n in zip(starts[large], sizes[large]):
                root = _large_group(fp[s:s + n], home[s:s + n], max_bits)
                moved = np.flatnonzero(root != np.arange(n))
                yield fp[s:s + n][moved], fp[s:s + n][root[moved]]
            small = ~np.repeat(large, sizes)
            f = fp[small]
            a, b = _small_groups(f, home[small], key[small], max_bits)
            if len(a):
                values, at = np.unique(np.r_[f[a], f[b]], return_inverse=True)
                root = _roots(at[:len(a)], at[len(a):], len(values))
                moved = np.flatnonzero(root != np.arange(len(values)))
                yield values[moved], values[root[moved]]

        held = []
        rows = 0

        def flush(last):
            key, fp, home = (np.concatenate(x) for x in zip(*held))
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            held[:] = [] if last else [(key[cut:], fp[cut:], home[cut:])]
            for a, b in compared(key[:cut], fp[:cut], home[:cut]):
                yield batch(schema, [a.view(np.int64), b.view(np.int64)])

        for x in batches:
            if x.num_rows:
                held.append((x.column("key").to_numpy(), x.column("fp").to_numpy().view(np.uint64),
                             x.column("home").to_numpy(zero_copy_only=False)))
                rows += x.num_rows
                if rows >= 200_000:
                    yield from flush(False)
                    rows = len(held[0][0]) if held else 0
        if held:
            yield from flush(True)

    return grouped.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                       bands: int = 3, uid: str | None = None) -> DataFrame:
    """(uid, doc_id, fp, component_id, kept): near-duplicate groups of all documents.

    Documents link when their fingerprints differ in at most ``max_bits``
    bits; ``component_id`` is the smallest doc_id reachable and ``kept`` marks
    one row of each component: of smallest doc_id, then first in the table.
    Null and empty texts have fingerprint 0 and link like any other. Null ids
    count as larger than all others; a component of null ids only has a null
    component_id. Repeated rows are rows of their own. Texts of any length are
    read whole. An empty table gives an empty result. Only doc_id and text are
    read, so extra columns of any name do no harm.
    """
    rows = store(fingerprints(docs, shingle_words, uid), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    nodes = store(rows.groupBy("fp").agg(first), "nodes")
    found = connected_components(links(nodes, max_bits, bands))
    member = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    low = member.groupBy("root").agg(F.min("first").alias("low"))
    of_fp = member.join(low, "root").select("fp", F.col("low.doc_id").alias("component_id"), F.col("low.uid").alias("keep_uid"))
    return rows.join(of_fp, "fp").select("uid", "doc_id", "fp", "component_id",
                                         (F.col("uid") == F.col("keep_uid")).alias("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that stay, with the columns they came with.

    The defined results are those of ``simhash_components``; columns of any
    name pass through as they are.
    """
    docs, uid = with_uid(docs)
    kept = simhash_components(docs, uid=uid).where("kept").select(F.col("uid").alias(uid))
    return docs.join(kept, uid, "left_semi").drop(uid)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
