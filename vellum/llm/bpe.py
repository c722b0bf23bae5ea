"""Byte-level BPE encoding and decoding of whole texts, by batched numpy merge rounds.

Method: the texts of a batch are one flat byte array. It is cut where no piece
of the vocabulary's pattern can cross (before white space, between letters,
digits and other signs, and around special tokens); distinct chunks are
found by dictionary encoding, and only these are cut into words by the pattern and
merged. The symbols of all words lie in one flat array.
A round looks every neighbouring pair up by binary search over the sorted pair
keys of the merge table, takes each word's lowest rank and merges all its
places, until no word has a pair left. Ids of the texts are then gathered from
the chunks' ids, and decoding gathers the tokens' bytes from one flat table.

Merging all places of a word's lowest pair in one round equals merging them
one by one if a merge's parts are made by earlier merges and no two merges
make the same symbol. Tables for which this does not hold merge the leftmost
place alone. A word of over ``LONG`` symbols (text without any cut) is merged
by the same table from a heap, whose cost is not rounds times length.

Scale: one narrow pass, nothing is shuffled. A task holds one slice of about
``SLICE`` bytes (or one longer text) and its distinct chunks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import batch, table

VOCABULARY = "byte_bpe_50k"
SLICE = 8 << 20  # bytes of text handled at once
LONG = 1024  # symbols of a word from which it is merged by itself
NONE = np.int64(1 << 40)  # rank of a pair that is not in the table

#: The pattern of byte-level pre-tokenisation, and white space beyond ASCII as UTF-8.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE_2 = {0xC2: (0x85, 0xA0)}
WHITE_3 = {(0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}
UNKNOWN, WHITE, LETTER, DIGIT, OTHER = range(5)
_KIND = np.array([UNKNOWN if b > 127 or b == 39 else WHITE if b in (9, 10, 11, 12, 13, 32) else LETTER if chr(b).isalpha()
                  else DIGIT if chr(b).isdigit() else OTHER for b in range(256)], np.uint8)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def byte_kinds(buf: np.ndarray) -> np.ndarray:
    """WHITE, LETTER, DIGIT or OTHER for each byte; UNKNOWN for apostrophes and for characters not looked at here."""
    out = _KIND[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3)  # accented Latin letters, without the two signs among them
    at = at[(buf[at + 1] != 0x97) & (buf[at + 1] != 0xB7)]
    out[at] = out[at + 1] = LETTER
    for lead, seconds in WHITE_2.items():
        at = np.flatnonzero(buf[:-1] == lead)
        at = at[np.isin(buf[at + 1], seconds)]
        out[at] = out[at + 1] = WHITE
    for lead in {a for a, _ in WHITE_3}:
        at = np.flatnonzero(buf[:-2] == lead)
        for (a, b), thirds in WHITE_3.items():
            if a == lead:
                hit = at[(buf[at + 1] == b) & np.isin(buf[at + 2], thirds)]
                out[hit] = out[hit + 1] = out[hit + 2] = WHITE
    return out


def flat_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """The rows ``which`` of the ragged array (flat, offsets), one after another."""
    lengths = offsets[1:] - offsets[:-1]
    out = np.empty(int(lengths[which].sum()), flat.dtype)
    at = 0
    for a in range(0, len(which), step):  # bounds what is held besides the result
        rows = which[a:a + step]
        n = lengths[rows]
        ends = np.cumsum(n)
        size = int(ends[-1])
        out[at:at + size] = flat[np.repeat(offsets[rows] - (ends - n), n) + np.arange(size)]
        at += size
    return out


class Coder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        self.path = path or public_tokenizers.path(f"{VOCABULARY}.json")
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"], pre.get("type")) != ("BPE", "ByteLevel") or spec["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{self.path}: only byte-level BPE without normalizer and prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{self.path}: only added tokens that match as they stand")
        vocab, chars = model["vocab"], byte_characters()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        texts = {i: bytes(chars[c] for c in t) for t, i in vocab.items()} | {i: b for b, i in self.special.items()}
        size = max(texts) + 1
        lengths = np.array([len(texts.get(i, b"")) for i in range(size)], np.int64)
        self.token_bytes = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)
        self.token_offsets = np.r_[0, np.cumsum(lengths)]
        self.byte_id = np.array([vocab.get(c, -1) for c in sorted(chars, key=chars.get)], np.int64)
        if (self.byte_id < 0).any():
            raise ValueError(f"{self.path}: a byte has no id of its own")
        parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in parts]))
        self.rank_of = dict(zip(zip(left.tolist(), right.tolist()), zip(range(len(made)), made.tolist())))
        first = np.full(size, -1, np.int64)
        first[made] = np.arange(len(made))
        early = np.arange(len(made))
        self.whole_rounds = len(set(made.tolist())) == len(made) and bool(((first[left] < early) & (first[right] < early)).all())
        order = np.argsort(left << 32 | right)
        self.keys, self.ranks, self.made = (left << 32 | right)[order], order.astype(np.int64), made[order]
        self.byte_rank, self.byte_made = self._lookup(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))
        self.cut = regex.compile(PATTERN).findall
        self.newer = regex.compile("[԰-\U0010ffff]").search  # scripts in which Unicode versions differ
        self.find_special = regex.compile(b"|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))).finditer if self.special else None
        self._pre = None

    # -- words

    def words(self, chunk: bytes) -> list[bytes]:
        """The pieces that the vocabulary's pattern cuts a chunk into."""
        text = chunk.decode("utf-8")
        if not self.newer(text):
            return [w.encode() for w in self.cut(text)]
        if self._pre is None:
            from tokenizers import Tokenizer

            self._pre = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b].encode() for _, (a, b) in self._pre.pre_tokenize_str(text)]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, result) of each pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words given as bytes one after another, in order."""
        whole = flat
        sym = self.byte_id[flat]
        done_word, done_len, done_sym = [], [], []
        word = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        starts_all = np.r_[0, np.cumsum(lengths)]
        for w in np.flatnonzero(lengths > LONG):
            out = self._merge_long(sym[starts_all[w]:starts_all[w + 1]].tolist())
            done_word.append([w])
            done_len.append([len(out)])
            done_sym.append(np.array(out, np.int64))
        sym, n = gather(sym, starts_all, word), lengths[word]
        pair = gather(whole, starts_all, word).astype(np.int64)
        pair[:-1] = pair[:-1] << 8 | pair[1:]
        rank, result = self.byte_rank[pair], self.byte_made[pair]  # searched once, for all pairs of bytes
        last = np.cumsum(n) - 1  # a word's last symbol has no pair
        todo = np.zeros(len(sym), bool)
        while len(word):
            todo[last] = False
            at = np.flatnonzero(todo)
            rank[at], result[at] = self._lookup(sym[at], sym[at + 1])
            rank[last] = NONE
            low = np.minimum.reduceat(rank, last + 1 - n)
            live = low < NONE
            if not live.all():
                done_word.append(word[~live])
                done_len.append(n[~live])
                keep = np.repeat(live, n)
                done_sym.append(sym[~keep])
                sym, rank, result, word, n, low = sym[keep], rank[keep], result[keep], word[live], n[live], low[live]
            of = np.repeat(np.arange(len(word)), n)
            at = np.flatnonzero(rank == low[of])
            if self.whole_rounds:  # of overlapping places, every second one from the left
                head = np.r_[True, np.diff(at) > 1]
                run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0)) if len(at) else at
                at = at[(np.arange(len(at)) - run) % 2 == 0] if len(at) else at
            else:
                at = at[np.r_[True, of[at][1:] != of[at][:-1]]] if len(at) else at
            sym[at] = result[at]
            n = n - np.bincount(of[at], minlength=len(n))
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            todo = np.zeros(len(sym), bool)  # pairs that changed: those on both sides of a merged symbol
            todo[at] = True
            todo[np.maximum(at - 1, 0)] = True
            sym, rank, result, todo = sym[stay], rank[stay], result[stay], todo[stay]
            last = np.cumsum(n) - 1
        flat, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_len))
        out = np.zeros(len(lengths), np.int64)
        if len(sizes):
            which = np.concatenate(done_word).astype(np.int64)
            out[which] = sizes
            place = np.empty(len(lengths), np.int64)
            place[which] = np.arange(len(which))
            flat = gather(flat, np.r_[0, np.cumsum(sizes)], place[lengths > 0])
        return flat, np.r_[0, np.cumsum(out)]

    def _merge_long(self, sym: list[int]) -> list[int]:
        """One word by a heap of (rank, place): lowest rank first, leftmost first."""
        get, n = self.rank_of.get, len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, r[1]) for i in range(n - 1) if (r := get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if j >= n or (got := get((sym[i], sym[j]))) is None or got[1] != made:
                continue
            sym[i], sym[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := get((made, sym[k])):
                    heapq.heappush(heap, (r[0], i, r[1]))
            if (h := before[i]) >= 0 and (r := get((sym[h], made))):
                heapq.heappush(heap, (r[0], h, r[1]))
        return [s for s in sym if s >= 0]

    # -- texts

    def chunk_offsets(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin, and the end; every text begins one."""
        begins = np.zeros(len(buf) + 1, bool)
        if len(buf) > 2:
            kind = byte_kinds(buf)
            before, here, after = kind[:-2], kind[1:-1], kind[2:]
            white, plain = here == WHITE, (here != UNKNOWN) & (before != UNKNOWN)
            begins[1:-2] = (white & (before != WHITE) & (before != UNKNOWN)) | (plain & ~white & (before != WHITE) & (here != before))
            begins[1:-2] |= (buf[1:-1] == 32) & (before != WHITE) & (after != WHITE)
        begins[offsets] = True
        if self.find_special:
            data = buf.tobytes()
            if any(s in data for s in self.special):
                for i in range(len(offsets) - 1):
                    for m in self.find_special(data, int(offsets[i]), int(offsets[i + 1])):
                        begins[m.start() + 1:m.end()] = False
                        begins[m.start()] = begins[m.end()] = True
        return np.flatnonzero(begins)

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct chunks."""
        buf, offsets = np.frombuffer(chunks.buffers()[2], np.uint8), np.frombuffer(chunks.buffers()[1], np.int64)
        first, lengths = offsets[:-1], offsets[1:] - offsets[:-1]
        # A chunk of letters only, with or without a space before them, is one word.
        odd = np.r_[0, np.cumsum(byte_kinds(buf) != LETTER)]
        simple = odd[offsets[1:]] - odd[first] - (buf[first] == 32) == 0
        alone, rest = np.flatnonzero(simple), np.flatnonzero(~simple)
        words: list[bytes] = []
        counts = np.ones(len(chunks), np.int64)
        special = []
        for k, c in enumerate(chunks.take(pa.array(rest)).to_pylist(), len(alone)):
            if c in self.special:
                special.append((k, self.special[c]))
                counts[k] = 0
            else:
                got = self.words(c)
                words += got
                counts[k] = len(got)
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        flat, of = self.merge(np.r_[gather(buf, offsets, alone), np.frombuffer(b"".join(number), np.uint8)],
                              np.r_[lengths[alone], np.fromiter(map(len, number), np.int64, len(number))])
        which = np.r_[np.arange(len(alone)), which + len(alone)]
        ends = np.r_[0, np.cumsum((of[1:] - of[:-1])[which])][np.cumsum(counts)]
        flat = gather(flat, of, which)
        for k, i in reversed(special):
            flat = np.insert(flat, ends[k], i)
            ends[k:] += 1
        place = np.empty(len(chunks), np.int64)
        place[np.r_[alone, rest]] = np.arange(len(chunks))
        ends = np.r_[0, ends]
        return gather(flat.astype(np.uint32), ends, place), np.r_[0, np.cumsum((ends[1:] - ends[:-1])[place])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string column; null is empty."""
        buf, offsets = flat_texts(texts)
        begins = self.chunk_offsets(buf, offsets)
        if len(begins) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(buf)])
        coded = column.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        ids, of = self._chunk_ids(coded.dictionary)
        ends = np.r_[0, np.cumsum((of[1:] - of[:-1])[which])]
        return gather(ids, of, which), ends[np.searchsorted(begins, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[str]:
        """The text of each row; bytes that are no UTF-8 become U+FFFD, as in the tokenizer. Ids without a token give nothing."""
        known = np.where((ids >= 0) & (ids < len(self.token_offsets) - 1), ids, -1).astype(np.int64)
        if (known < 0).any():
            gone = np.r_[0, np.cumsum(known < 0)]
            known, offsets = known[known >= 0], offsets - gone[offsets]
        ends = np.r_[0, np.cumsum((self.token_offsets[1:] - self.token_offsets[:-1])[known])]
        data = b"".join(gather(self.token_bytes, self.token_offsets, known[a:a + (1 << 20)]).tobytes() for a in range(0, len(known), 1 << 20))
        at = ends[offsets].tolist()
        for a, b in zip(at, at[1:]):
            yield data[a:b].decode("utf-8", "replace")


@lru_cache(2)
def coder(path: str | None = None) -> Coder:
    return Coder(path)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text (one text may exceed it)."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>), one row per row of ``docs``.

    Ids are those of the vocabulary file at ``path`` without added tokens but
    those that stand in the text. Null and empty texts have no ids; null ids
    and repeated rows are rows like any others; ties cannot arise. A text of
    any length is encoded whole. An empty table gives an empty result. Only
    doc_id and text are read, so extra columns of any name do no harm.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        c = coder(path)
        for b in batches:
            for lo, hi in slices(b.column("text")):
                ids, offsets = c.encode(b.column("text").slice(lo, hi - lo))
                yield batch(schema, [b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a list column; null is empty."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    if column.null_count:
        return _tokens(pc.if_else(pc.is_null(column), pa.scalar([], column.type), column))
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the inverse of ``encode``. Null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        c = coder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield batch(schema, [part.column("doc_id"), list(c.decode(*_tokens(part.column("ids"))))])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c = coder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                ids, offsets = _tokens(part.column("ids"))
                raw = memoryview(ids.astype("<u4").tobytes())
                at = offsets.tolist()
                yield batch(schema, [part.column("doc_id"), np.diff(offsets), [hashlib.sha256(raw[4 * x:4 * y]).hexdigest() for x, y in zip(at, at[1:])],
                                     [hashlib.sha256(t.encode()).hexdigest() for t in c.decode(ids, offsets)]])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
