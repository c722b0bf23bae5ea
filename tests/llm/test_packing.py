import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from vellum.llm import packing

SF = "/root/testdata/sf0.01"


def _whole():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def test_ids_are_the_tokenizers(make):
    texts = ["a<|endoftext|>b", "word " * 3000, None, "", "<|endoftext|>", "x\n \ny"]
    rows = packing.pieces(make(list(enumerate(texts)), 2), window=7, with_ids=True).collect()
    whole = _whole()
    for i, t in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(len(r.ids) == r.length <= 7 and crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in mine)


def test_query_is_whole(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    whole = _whole()
    rows = packing.op7_packing(spark, SF).collect()
    seqs, by = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(docs)
    for i, parts in by.items():
        ids = whole.encode(docs[i], add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(seqs) * 2048 < 1.005 * total + 2048


def test_fill_is_the_best_sum():
    rng = random.Random(9)
    for _ in range(300):
        room = rng.randrange(1, 60)
        counts = {n: rng.randrange(1, 4) for n in rng.sample(range(1, 40), rng.randrange(0, 6))}
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = packing.fill(counts, sorted(counts), room)
        assert all(taken[n] <= counts[n] for n in taken)
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


def test_every_item_once():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 2048) for _ in range(3000)]
    bins = packing.min_bin_slack(sizes)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert max(sum(sizes[i] for i in b) for b in bins) <= 2048
    assert len(bins) <= 1.02 * sum(sizes) / 2048 + 2
    assert packing.min_bin_slack([]) == [] and packing.min_bin_slack([5, 5], 8) == [[1], [0]]


def test_odd_rows(make):
    docs = make([(1, None), (1, None), (None, "a"), (2, ""), (3, "word " * 30_000), (3, "word " * 30_000)])
    rows = packing.pack_documents(docs).collect()
    assert sorted(r.length for r in rows if r.doc_id == 1) == [1, 1]
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 3)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    ids = packing.pieces(make([(1, "a b")]), with_ids=True).first().ids
    assert ids == _whole().encode("a b").ids + [1]
