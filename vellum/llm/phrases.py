"""Phrase collocations of every language of a corpus, by tries of safe candidates.

Method: phrases grow by a word a round. A phrase of k words can only be
frequent if its first k - 1 words and its last k - 1 words are (Apriori), and
if some unit of the text, of t units, holds a t-th of its places, and if the
bucket that it hashes to is as frequent. So a round's candidates are the
frequent phrases with a next word in a frequent bucket that units found often
enough. Candidates go into a double-array trie that is broadcast; a pass over
the text advances the states of all positions of a block at once, level by
level in numpy, counts the accepting states by ``bincount`` and adds the
counts of its blocks; a unit sends them in arrays of many phrases, which are
added up as arrays. The same pass counts, in buckets,
the words that follow accepting places. A second pass then sends on those
that follow frequent phrases and lie in frequent buckets. What a few units
find often in it is a candidate at once, and named to all units, which send
only the others: else each unit would send every pair of many places.

Each phrase's lowest-scoring cut, the dropping of phrases inside equally
frequent longer ones and the ranking are joins and aggregations of Spark.

Scale: texts are read once and kept as blocks of word numbers with the words'
ids, which are hashes; words are shuffled once, to be counted and to find two
words of one id (then another seed is taken). Blocks are never shuffled. What
is broadcast is bounded whatever the corpus: a bitmap of frequent words (at
most 16 MB; a word that only seems frequent makes more candidates, no wrong
ones), one of frequent buckets of the same bound, and tries of about
``TRIE_PHRASES`` phrases; a round with more deals them to several tries by
hash, two passes each. Buckets are about a quarter of the words, 2 **
``BITMAP_BITS`` at most: beyond some ten GB of text they fill up and hold back
less, and more pairs are shuffled to be counted.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.bpe import flat_texts, slices
from vellum.llm.common import discard, keep, table

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
SHARE = 100  # per cent of a phrase's count from which a longer one hides it
NO_LANG = "und"
TRIE_PHRASES = 1_000_000  # phrases of one broadcast trie
BITMAP_BITS = 27  # size of the broadcast bitmaps of frequent words and of frequent buckets, at most
CHUNK_BITS = 19  # bits of a bitmap made by one task
SALTS = 64  # tasks that first add up the buckets of one chunk, at most
HELD = 2_000_000  # pairs a task holds before it sends them on
KNOWN = 1_000_000  # pairs named to all units, at most (24 MB)
SLICE = 8 << 20  # bytes of text cut into blocks at once, one a language

#: Bytes that part pieces, and bytes that part words.
PIECE_BYTES = b".,;:!?\x0a\x0b\x0c\x0d"
SPACE_BYTES = b" \t"

_PIECE, _SPACE = (np.isin(np.arange(256), list(x)) for x in (PIECE_BYTES, SPACE_BYTES))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words one after another, text of each, whether it continues the piece of the word before)."""
    buf, offsets = flat_texts(texts)
    buf = _LOWER[buf]
    piece = _PIECE[buf]
    inside = ~(piece | _SPACE[buf])
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True  # no word goes on from one text into the next
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | cut[:-1])) if len(buf) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | cut[1:])) + 1 if len(buf) else starts
    word_offsets = np.append(0, np.cumsum(ends - starts))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(word_offsets), pa.py_buffer(buf[inside])])
    text = np.searchsorted(offsets, starts, "right") - 1
    pieces = np.searchsorted(np.flatnonzero(piece), starts)  # piece ends before each word
    joined = np.zeros(len(starts), bool)
    joined[1:] = (text[1:] == text[:-1]) & (pieces[1:] == pieces[:-1])
    return words, text, joined


BLOCKS = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                    ("tokens", pa.binary())])


def word_ids(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """Ids of 63 bits. Two words of one id are found by ``coded_blocks``, which then takes another seed."""
    start = lang.encode() + b"\0"
    h = xxhash.xxh64_intdigest
    return (np.array([h(start + w, seed) for w in words], np.uint64) >> np.uint64(1)).astype(np.int64)


def text_blocks(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(lang, words, ids, counts, tokens): texts of one language as numbers of the block's words.

    ``tokens`` are 32-bit numbers into ``words`` with -1 between pieces, compressed.
    """
    ids_of = word_ids

    def run(batches):
        squeeze = zstandard.ZstdCompressor(1).compress
        for b in batches:
            for lo, hi in slices(b.column("text"), SLICE):
                part = b.slice(lo, hi - lo)
                langs = part.column("lang").dictionary_encode()
                code = langs.indices.to_numpy(zero_copy_only=False)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    words, _, joined = split_words(part.column("text").take(pa.array(np.flatnonzero(code == k))))
                    if not len(words):
                        continue
                    coded = words.dictionary_encode()
                    which = coded.indices.to_numpy(zero_copy_only=False)
                    counts = np.bincount(which, minlength=len(coded.dictionary))
                    names = coded.dictionary.to_pylist()
                    tokens = np.insert(which.astype(np.int32), np.flatnonzero(~joined), -1)
                    all_ = pa.array([0, len(counts)], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.ListArray.from_arrays(all_, pa.array([w.decode() for w in names], pa.string())),
                         pa.ListArray.from_arrays(all_, pa.array(ids_of(lang, names, seed))),
                         pa.ListArray.from_arrays(all_, pa.array(counts, pa.int64())), pa.array([squeeze(tokens.tobytes())], pa.binary())], schema=BLOCKS)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, words array<string>, ids array<long>, counts array<long>, tokens binary")


class Trie:
    """A double-array trie over rows of word ids, read by whole arrays of states.

    Words are replaced by their number among the trie's own, and a number by
    its ``digits`` bytes, so that a state has at most 256 children close
    together. ``base[s] + byte`` is the state that a byte leads to from ``s``
    if ``check`` of it is ``s``. State 0 is none, state 1 the root.
    """

    WINDOW = 4096  # places tried at once

    def __init__(self, rows: np.ndarray):
        self.words = np.unique(rows)
        self.digits = max(1, (max(1, len(self.words) - 1).bit_length() + 7) // 8)
        self.base, self.check = np.zeros(1 << 13, np.int32), np.full(1 << 13, -1, np.int32)
        self.check[:2] = 0  # taken
        self._from, self._end = 2, 2
        coded = np.searchsorted(self.words, rows)
        state = np.ones(len(rows), np.int64)
        for level in range(rows.shape[1]):
            for digit in range(self.digits - 1, -1, -1):
                edges, back = np.unique(state << 8 | (coded[:, level] >> 8 * digit & 255), return_inverse=True)
                state = self._place(edges >> 8, edges & 255)[back]
        self.accept = state  # the state of each row
        self.base, self.check = self.base[:self._end], self.check[:self._end]

    def _place(self, parent: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """States of the children of one level, sorted by parent and byte."""
        out = np.empty(len(parent), np.int64)
        starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        sizes = np.diff(np.r_[starts, len(parent)])
        many = np.flatnonzero(sizes > 1)
        for a, n in zip(*(x[many][np.argsort(-sizes[many], kind="stable")].tolist() for x in (starts, sizes))):
            out[a:a + n] = self._fit(int(parent[a]), byte[a:a + n])
        one = starts[sizes == 1]  # an only child takes any free place
        self._room(self._end + len(one))
        spots = np.flatnonzero(self.check < 0)[:len(one)]
        self.base[parent[one]], self.check[spots], out[one] = spots - byte[one], parent[one], spots
        self._end = max(self._end, int(spots.max(initial=0)) + 1)
        return out

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def _fit(self, parent: int, bytes_: np.ndarray) -> np.ndarray:
        """Free places as far apart as the bytes: the first such in the window, else behind all others."""
        apart = bytes_ - bytes_[0]
        self._room(self._from + self.WINDOW + 512)
        free = self.check[self._from:self._from + self.WINDOW + 256] < 0
        fits = free[:self.WINDOW].copy()
        for d in apart[1:].tolist():
            fits &= free[d:d + self.WINDOW]
        k = int(fits.argmax())
        if fits[k]:
            at = self._from + k
        else:
            at, self._from = max(self._end, self._from), self._from + self.WINDOW // 2
            self._room(at + 256)
        spots = at + apart
        self.base[parent], self.check[spots] = at - bytes_[0], parent
        self._end = max(self._end, int(spots[-1]) + 1)
        return spots

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """The trie's number of each word id, -1 for others."""
        if not len(self.words):
            return np.full(len(ids), -1)
        code = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        return np.where(self.words[code] == ids, code, -1)

    def walk(self, code: np.ndarray, depth: int) -> np.ndarray:
        """The state that ``depth`` words (as ``codes``) from each position lead to, 0 where they lead nowhere.

        The states of all positions advance together, a byte at a time.
        """
        out = np.zeros(len(code), np.int32)
        pos = np.flatnonzero(code[:max(0, len(code) - depth + 1)] >= 0)
        state = np.ones(len(pos), np.int64)
        for level in range(depth):
            word = code[pos + level]
            pos, state, word = (x[word >= 0] for x in (pos, state, word))
            for digit in range(self.digits - 1, -1, -1):
                to = self.base[state] + (word >> 8 * digit & 255)
                to[(to < 0) | (to >= len(self.check))] = 0
                live = (self.check[to] == state) & (to > 1)
                pos, state, word = pos[live], to[live], word[live]
        out[pos] = state
        return out


FOUND = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])
FOUND_SQL = "left long, right long, n long"
UNITS = -1  # left side of the rows that tell how many units counted


def bitmap(ids: DataFrame, count: int) -> np.ndarray:
    """Bits set at ``id % size`` of the ids: at most ``2 ** BITMAP_BITS`` of them, about 16 per id below that."""
    bits = min(BITMAP_BITS, max(19, (16 * count).bit_length()))
    low = (1 << 19) - 1

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column("id").to_numpy() & ((1 << bits) - 1)
            for chunk in np.unique(at >> 19).tolist():
                mine = parts.setdefault(chunk, np.zeros(low + 1, bool))
                mine[at[at >> 19 == chunk] & low] = True
        out = pa.schema([("chunk", pa.int32()), ("bits", pa.binary())])
        for chunk, mine in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(mine).tobytes()], pa.binary())], schema=out)

    chunk = F.shiftright(F.col("id").bitwiseAND(F.lit((1 << bits) - 1)), 19)
    full = np.zeros(1 << bits >> 3, np.uint8)
    for r in ids.select("id").repartition(chunk).mapInArrow(run, "chunk int, bits binary").toLocalIterator():
        full[r.chunk << 16:(r.chunk + 1) << 16] |= np.frombuffer(r.bits, np.uint8)
    return full


def _has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class _Unit:
    """Followers of places, counted over the blocks of a task. Those seen ``least`` times or more are sent on.

    A phrase seen ``m`` times in ``t`` units is seen ``m / t`` times in one of
    them at least; what a unit keeps to itself is at most ``least - 1``. A
    task that comes to hold ``most`` pairs sends them all on, and starts
    anew, so that this holds however often it does.
    """

    def __init__(self, least: int, most: int):
        self.least, self.most, self.rows, self.held = least, most, [], 0

    def add(self, left: np.ndarray, right: np.ndarray, n: np.ndarray):
        self.rows.append((left, right, n))
        self.held += len(n)
        if self.held > self.most:
            self.merge()
            if self.held > self.most // 2:
                yield from self.send(1)

    def merge(self) -> None:
        """One row for each pair held."""
        left, right, n = (np.concatenate(x) for x in zip(*self.rows))
        names = np.unique(np.concatenate([left, right]))
        key, back = np.unique(np.searchsorted(names, left) * len(names) + np.searchsorted(names, right), return_inverse=True)
        if len(key):
            left, right, n = names[key // len(names)], names[key % len(names)], np.bincount(back, n, len(key)).astype(np.int64)
        self.rows, self.held = [(left, right, n)], len(key)

    def send(self, least: int):
        if self.rows:
            self.merge()
            (left, right, n), = self.rows
            self.rows, self.held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(x[n >= least]) for x in (left, right, n)], schema=FOUND)

    def close(self):
        yield from self.send(self.least)
        yield pa.RecordBatch.from_pylist([dict(left=UNITS, n=1)], schema=FOUND)


def _block_rows(batches):
    """(ids of the block's words, tokens) of blocks; token -1 parts pieces."""
    expand = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for i in range(b.num_rows):
            yield b.column("ids")[i].values.to_numpy(), np.frombuffer(expand(b.column("tokens")[i].as_py()), np.int32)


def _followers(left: np.ndarray, names: np.ndarray, right: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple:
    """(left id, right id, n) for places of ``left >= 0`` that are followed by a known word; ``names`` gives the ids of ``left``."""
    at = np.flatnonzero((left >= 0) & (right >= 0) & known[right])
    keys, n = np.unique(left[at].astype(np.int64) << 32 | right[at], return_counts=True)
    return names[keys >> 32], ids[keys & 0xFFFFFFFF], n


def bucket_of(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """The bucket, of ``2 ** bits``, of each pair."""
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ right.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


HEARD = pa.schema([("chunk", pa.int64()), ("phrases", pa.bool_()), ("counts", pa.binary())])  # of phrases, else of buckets
HEARD_SQL = "chunk long, phrases boolean, counts binary"
CHUNK = pa.schema([("chunk", pa.int64()), ("counts", pa.binary())])


class _Buckets:
    """Places of pairs counted by bucket, up to ``enough``: as sums go, more tells nothing more."""

    def __init__(self, bits: int, enough: int):
        self.bits, self.enough, self.seen = bits, enough, np.zeros(1 << bits, np.min_scalar_type(enough))

    def add(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> None:
        at, back = np.unique(bucket_of(left, right, self.bits), return_inverse=True)
        self.seen[at] = np.minimum(self.seen[at] + np.bincount(back, n, len(at)), self.enough).astype(self.seen.dtype)

    def close(self):
        yield from _chunks(self.seen, False)


def _chunks(counts: np.ndarray, phrases: bool):
    """``counts`` in rows of ``2 ** CHUNK_BITS``, but for rows of zeros."""
    squeeze = zstandard.ZstdCompressor(1).compress
    for chunk, at in enumerate(range(0, len(counts), 1 << CHUNK_BITS)):
        part = counts[at:at + (1 << CHUNK_BITS)]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([phrases]), pa.array([squeeze(part.tobytes())], pa.binary())], schema=HEARD)


def _summed(dtype: np.dtype, most: int):
    """The function that adds up the rows of each chunk in a task, up to ``most``: (chunk, array) of batches."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                part = np.frombuffer(expand(counts), dtype)
                sums[chunk] = part if chunk not in sums else np.minimum(sums[chunk].astype(np.int64) + part, most).astype(dtype)
        return sums.items()

    return run


def _added(heard: DataFrame, phrases: bool, summed) -> DataFrame:
    """(chunk, counts) of phrases or buckets, added up by up to ``SALTS`` tasks a chunk, so that none reads the rows of all units."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(1).compress
        for chunk, part in summed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([squeeze(part.tobytes())], pa.binary())], schema=CHUNK)

    rows = heard.where(F.col("phrases") == phrases).select("chunk", "counts")
    parts = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("chunk", "salt")
    return parts.select("chunk", "counts").mapInArrow(run, "chunk long, counts binary").repartition("chunk")


def frequent_buckets(heard: DataFrame, bits: int, enough: int) -> np.ndarray:
    """Bits of the buckets whose counts reach ``enough`` over all units."""
    summed = _summed(np.min_scalar_type(enough), enough)

    def reached(batches):
        for chunk, part in summed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([np.packbits(part >= enough).tobytes()], pa.binary())], schema=CHUNK)

    out = np.zeros(1 << bits >> 3, np.uint8)
    size = 1 << CHUNK_BITS >> 3
    for r in _added(heard, False, summed).mapInArrow(reached, "chunk long, counts binary").toLocalIterator():
        out[r.chunk * size:(r.chunk + 1) * size] = np.frombuffer(r.counts, np.uint8)
    return out


def frequent_counts(heard: DataFrame, phrase_ids: np.ndarray, min_count: int) -> DataFrame:
    """(left, a) of the phrases, numbered as in ``phrase_ids``, with ``min_count`` places or more over all units."""
    summed = _summed(np.dtype(np.int64), np.iinfo(np.int64).max)
    shared = heard.sparkSession.sparkContext.broadcast(phrase_ids)

    def reached(batches):
        for chunk, part in summed(batches):
            at = np.flatnonzero(part >= min_count)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[(chunk << CHUNK_BITS) + at]), pa.array(part[at])], ["left", "a"])

    return _added(heard, True, summed).mapInArrow(reached, "left long, a long")


def _next_words(ids: np.ndarray, tokens: np.ndarray, bits: np.ndarray) -> tuple:
    """(left, right, n) of neighbouring frequent words of a block."""
    known = _has(bits, ids)
    first = np.where((tokens >= 0) & known[tokens], tokens, -1)
    return _followers(first[:-1], ids, tokens[1:], ids, known)


def pairs_heard(blocks: DataFrame, bits: np.ndarray, room: int, enough: int) -> DataFrame:
    """Neighbouring frequent words counted in ``2 ** room`` buckets."""
    shared = blocks.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        buckets = _Buckets(room, enough)
        for ids, tokens in _block_rows(batches):
            buckets.add(*_next_words(ids, tokens, shared.value))
        yield from buckets.close()

    return blocks.select("ids", "tokens").mapInArrow(run, HEARD_SQL)


class _Known:
    """Pairs that units need not send."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.names = np.unique(np.concatenate([left, right]))
        self.keys = np.sort(self._key(left, right))

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.names, left) * (len(self.names) + 1) + np.searchsorted(self.names, right)

    def others(self, pairs: tuple) -> tuple:
        """The pairs (left, right, n) that are not known."""
        if not len(self.keys):
            return pairs
        left, right, _ = pairs
        named = [self.names[np.minimum(np.searchsorted(self.names, x), len(self.names) - 1)] == x for x in (left, right)]
        key = self._key(left, right)
        there = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        stay = ~(named[0] & named[1] & there)
        return tuple(x[stay] for x in pairs)


def word_pairs(blocks: DataFrame, bits: np.ndarray, full: np.ndarray, least: int, known: _Known) -> DataFrame:
    """(left, right, n) of neighbouring frequent words whose bucket is in ``full``, but for those ``known``."""
    shared, most = blocks.sparkSession.sparkContext.broadcast((bits, full, known)), HELD

    def run(batches):
        bits, full, known = shared.value
        unit = _Unit(least, most)
        for ids, tokens in _block_rows(batches):
            yield from unit.add(*known.others(_in_full(_next_words(ids, tokens, bits), full)))
        yield from unit.close()

    return blocks.select("ids", "tokens").mapInArrow(run, FOUND_SQL)


def _in_full(pairs: tuple, full: np.ndarray) -> tuple:
    left, right, _ = pairs
    stay = _has(full, bucket_of(left, right, (8 * len(full)).bit_length() - 1))
    return tuple(x[stay] for x in pairs)


def _after_phrases(state: np.ndarray, names: np.ndarray, k: int, ids: np.ndarray, tokens: np.ndarray, bits: np.ndarray, alone: bool) -> tuple:
    """(left, right, n) of a block's phrases of ``k`` words with a name, and the frequent words that follow.

    Where one trie has all phrases (``alone``), a following word counts only
    if the phrase's last words with it are a place of another phrase.
    """
    if len(tokens) <= k:
        return (np.zeros(0, np.int64),) * 3
    place = names[state] >= 0
    here, after = place[:-k], place[1:len(tokens) - k + 1]
    left = np.where(here & after if alone else here, state[:-k], -1)
    return _followers(left, names, tokens[k:], ids, _has(bits, ids))


def _states(trie: Trie, ids: np.ndarray, tokens: np.ndarray, k: int) -> np.ndarray:
    code = np.append(trie.codes(ids), -1)  # the last place serves token -1
    return trie.walk(code[tokens], k)


def names_of(trie: Trie, phrase_ids: np.ndarray) -> np.ndarray:
    """The phrase of each state of the trie, -1 for none."""
    names = np.full(len(trie.check), -1, np.int64)
    names[trie.accept] = phrase_ids
    return names


def phrases_heard(blocks: DataFrame, trie: Trie, names: np.ndarray, k: int, bits: np.ndarray, room: int, enough: int, last: bool, alone: bool) -> DataFrame:
    """Counts of the trie's phrases, in its order, and, unless ``last``, their next words counted in ``2 ** room`` buckets."""
    shared = blocks.sparkSession.sparkContext.broadcast((trie, names, bits))

    def run(batches):
        trie, names, bits = shared.value
        buckets, total = None if last else _Buckets(room, enough), np.zeros(len(names), np.int64)
        for ids, tokens in _block_rows(batches):
            state = _states(trie, ids, tokens, k)
            total += np.bincount(state, minlength=len(total))
            if not last:
                buckets.add(*_after_phrases(state, names, k, ids, tokens, bits, alone))
        yield from _chunks(total[trie.accept], True)
        if not last:
            yield from buckets.close()

    return blocks.select("ids", "tokens").mapInArrow(run, HEARD_SQL)


def phrase_followers(blocks: DataFrame, trie: Trie, names: np.ndarray, k: int, bits: np.ndarray, full: np.ndarray, least: int, alone: bool,
                     known: _Known) -> DataFrame:
    """(left, right, n) of the phrases that ``names`` names and the frequent words that follow them, of buckets in ``full``, but for those ``known``."""
    shared, most = blocks.sparkSession.sparkContext.broadcast((trie, names, bits, full, known)), HELD

    def run(batches):
        trie, names, bits, full, known = shared.value
        unit = _Unit(least, most)
        for ids, tokens in _block_rows(batches):
            state = _states(trie, ids, tokens, k)
            yield from unit.add(*known.others(_in_full(_after_phrases(state, names, k, ids, tokens, bits, alone), full)))
        yield from unit.close()

    return blocks.select("ids", "tokens").mapInArrow(run, FOUND_SQL)


def counted(one_pass, least: int, min_count: int) -> tuple[DataFrame, str, int, int]:
    """(rows of the pass, their place, units, least), stored; with ``least`` 1 if there were more units than it allows."""
    while True:
        found, at = keep(one_pass(least), "phrase-found")
        units = found.where(F.col("left") == UNITS).count()
        if (least - 1) * units < min_count:
            return found, at, units, least
        discard(found.sparkSession, at)
        least = 1


def candidates_of(found: DataFrame, min_count: int, units: int, least: int) -> DataFrame:
    """(left, right) that can have been seen ``min_count`` times, by what units sent and what they may have kept."""
    sent = found.where("right is not null").groupBy("left", "right").agg(F.sum("n").alias("n"))
    return sent.where(F.col("n") + units * (least - 1) >= min_count).select("left", "right")


def first_units(blocks: DataFrame) -> tuple[DataFrame, float]:
    """About as many of the files of ``blocks`` (stored) as the root of their number, spread over all, and their share."""
    files = sorted(blocks.inputFiles())
    some = files[::max(1, len(files) // max(1, math.isqrt(len(files))))]
    return blocks.sparkSession.read.schema(blocks.schema).parquet(*some), len(some) / len(files)


def safe_pairs(one_pass, blocks: DataFrame, least: int, min_count: int) -> tuple[DataFrame, list[str]]:
    """((left, right) that can have been seen ``min_count`` times, places of the tables it is read from).

    ``one_pass(blocks, least, known)`` gives what the units of ``blocks``
    send. The first units only name candidates, by half the share of
    ``min_count`` that falls to them; all units then send whatever is not
    named, so no pair depends on where it stands. Candidates that are not
    frequent cost a place in a trie, which counts them.
    """
    none, places = np.zeros(0, np.int64), []
    known, seen = _Known(none, none), None
    if len(blocks.inputFiles()) > 3:
        some, share = first_units(blocks)
        enough = math.ceil(min_count * share / 2)
        units = max(1, some.rdd.getNumPartitions())
        found, at, units, n = counted(lambda n: one_pass(some, n, known), 1 + (enough - 1) // units, enough)
        seen, there = keep(candidates_of(found, enough, units, n), "phrase-seen")
        places += [at, there]
        parts = -(-seen.count() // KNOWN)
        if parts > 1:  # units send the others as well
            seen = seen.where(F.pmod(F.xxhash64("left", "right"), F.lit(parts)) == 0)
        rows = seen.toArrow()  # about KNOWN rows
        known = _Known(rows.column("left").to_numpy(), rows.column("right").to_numpy())
    found, at, units, n = counted(lambda n: one_pass(blocks, n, known), least, min_count)
    rest = candidates_of(found, min_count, units, n)
    return rest if seen is None else rest.unionByName(seen), [*places, at]


def coded_blocks(docs: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(blocks, words (lang, word, a, id) seen ``min_count`` times, totals (lang, n), places of the tables)."""
    seed, places = 0, []
    while True:
        blocks, at = keep(text_blocks(docs, seed), "phrase-blocks")
        places.append(at)
        each = blocks.select("lang", F.explode(F.arrays_zip("ids", "words", "counts")).alias("w")).select(
            "lang", F.col("w.ids").alias("id"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
        counted = each.repartition("id").groupBy("id", "lang", "word").agg(F.sum("n").alias("a"))
        twice = counted.groupBy("id").agg(F.count("*").alias("a")).where("a > 1").select(
            "id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word"), "a")
        found, at = keep(counted.where(F.col("a") >= min_count).unionByName(twice), "phrase-words")
        places.append(at)
        if not found.where("word is null").limit(1).count():
            break
        seed += 1  # two words of one id
    totals = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    totals, at = keep(totals, "phrase-totals")
    return blocks, found, totals, [*places, at]


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                     trie_phrases: int = TRIE_PHRASES) -> tuple[DataFrame, DataFrame]:
    """((lang, words, a) of all phrases of 1 to ``max_words`` words seen ``min_count`` times or more, totals (lang, n))."""
    spark = docs.sparkSession
    blocks, words, totals, places = coded_blocks(docs, min_count)
    bits = bitmap(words, words.count())
    least = 1 + (min_count - 1) // max(1, blocks.rdd.getNumPartitions())  # a unit is a task
    word = words.select(F.col("id").alias("right"), F.col("word").alias("last"))
    before = words.select(F.col("id").alias("left"), "lang", F.array("word").alias("words"), F.array("id").alias("ids"))
    levels = [words.select("lang", F.array("word").alias("words"), "a")]
    size = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    room = min(BITMAP_BITS, max(CHUNK_BITS, (size >> 2).bit_length()))
    heard, at = keep(pairs_heard(blocks, bits, room, min_count), "phrase-heard")
    places.append(at)
    full = frequent_buckets(heard, room, min_count)
    got = [safe_pairs(lambda rows, n, known: word_pairs(rows, bits, full, n, known), blocks, least, min_count)]
    for k in range(2, max_words + 1):
        places += [at for _, own in got for at in own]
        # Each trie's phrases are its own, so the parts of a round have no candidate in common.
        safe = reduce(DataFrame.unionByName, [pairs for pairs, _ in got])
        grown = safe.join(before, "left").join(word, "right").select(
            "lang", F.array_append("words", F.col("last")).alias("words"), F.array_append("ids", F.col("right")).alias("ids"))
        candidates, at = keep(grown.withColumn("left", F.monotonically_increasing_id()), f"phrase-candidates-{k}")
        places.append(at)
        tries = -(-candidates.count() // trie_phrases)
        if not tries:
            break
        got, counts, last, alone = [], [], k == max_words, tries == 1
        for t in range(tries):
            mine = candidates if alone else candidates.where(F.pmod(F.xxhash64("left"), F.lit(tries)) == t)
            rows = mine.select("left", "ids").toArrow()  # about trie_phrases rows
            if not rows.num_rows:
                continue
            trie = Trie(rows.column("ids").combine_chunks().flatten().to_numpy().reshape(-1, k))
            names = rows.column("left").to_numpy()
            heard, at = keep(phrases_heard(blocks, trie, names_of(trie, names), k, bits, room, min_count, last, alone), "phrase-heard")
            places.append(at)
            frequent, at = keep(frequent_counts(heard, names, min_count), "phrase-counts")
            places.append(at)
            counts.append(frequent)
            if not last:
                some = frequent.select("left").toArrow().column("left").to_numpy()
                own = names_of(trie, np.where(np.isin(names, some), names, -1))
                full = frequent_buckets(heard, room, min_count)
                got.append(safe_pairs(lambda rows, n, known: phrase_followers(rows, trie, own, k, bits, full, n, alone, known), blocks, least, min_count))
        counts = reduce(DataFrame.unionByName, counts)
        before = candidates.join(counts, "left")
        levels.append(before.select("lang", "words", "a"))
        before = before.select("left", "lang", "words", "ids")
    places += [at for _, own in got for at in own if at not in places]
    every = keep(reduce(DataFrame.unionByName, levels), "phrases")[0]
    totals = keep(totals, "phrase-totals")[0]
    for at in places:
        discard(spark, at)
    return every, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, share: int = SHARE,
                 trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    Texts are lower-cased (A-Z only), cut into pieces at . , ; : ! ? and line
    ends, and those into words at blanks and tabs; null texts are empty, a
    null language is ``und``. ``a`` counts a phrase's places within pieces,
    overlaps included, ``n`` all words of the language. Cut after its first
    words, ``l`` and ``r`` count the two sides, and the score is
    floor(1000 * a * n / (l * r)), computed exactly; a phrase has that of its
    lowest cut, ties to the earliest. Phrases that lie in a longer one with at
    least ``share`` per cent of their count are dropped. Equal scores are
    ranked by ``a``, then by the phrase's bytes. Texts of any length are read
    whole; repeated rows count again; null ids matter nothing, as doc_id is
    not read. An empty table gives an empty result. Columns besides text and
    lang are not read.
    """
    every, totals = frequent_phrases(docs, min_count, max_words, trie_phrases)
    every = every.select("lang", F.array_join("words", " ").alias("phrase"), "words", "a")
    longer = every.where(F.size("words") > 1)
    cuts = longer.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.expr("slice(words, cut + 1, size(words) - cut)"), " ").alias("tail"))
    side = every.select("lang", F.col("phrase").alias("side"), F.col("a").alias("count"))
    cuts = (cuts.join(side.select("lang", F.col("side").alias("head"), F.col("count").alias("l")), ["lang", "head"])
            .join(side.select("lang", F.col("side").alias("tail"), F.col("count").alias("r")), ["lang", "tail"]).join(F.broadcast(totals), "lang"))
    big = [F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")]
    cuts = cuts.withColumn("over", big[0] * big[1] * 1000).withColumn("under", big[2] * big[3]).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("b")).select("lang", "phrase", "b.*")
    inner = longer.where(F.size("words") > 2).select("lang", "a", "words", F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))")).alias("part"))
    hidden = inner.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("a").alias("cover"))
    left = best.join(hidden, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (100 * F.col("cover") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT coalesce(lang, '{NO_LANG}') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS j, k FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, n.n,
             CAST((CAST(1000 AS HUGEINT) * cut.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.k = j AND x.phrase = array_to_string(ws[1:j], ' ')
               JOIN f y ON y.lang = cut.lang AND y.k = cut.k - j AND y.phrase = array_to_string(ws[j + 1:], ' ') JOIN n ON n.lang = cut.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM s),
i AS (SELECT lang, array_to_string(ws[z:z + m - 1], ' ') AS phrase, max(a) AS cover
      FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS z FROM c, (SELECT unnest(range(2, {MAX_WORDS})) AS m) WHERE m < k) GROUP BY 1, 2),
r AS (SELECT b.lang, b.phrase, b.a, l, r, n, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE place = 1 AND (cover IS NULL OR 100 * cover < {SHARE} * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= {TOP}
"""
