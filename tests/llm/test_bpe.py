import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from vellum.llm import bpe

SF = "/root/testdata/sf0.01"
ALPHABET = "aB1é 　 \t\n'sll.,-_²½Ⅷ​日本שλж\x1c\x85 ՘႔0"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _check(coder, library, texts):
    ids, offsets = coder.encode(pa.array(texts, pa.string()))
    back = list(coder.decode(ids, offsets))
    for i, w in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        mine = ids[offsets[i]:offsets[i + 1]].tolist()
        assert mine == w.ids, repr(texts[i])
        assert back[i] == library.decode(w.ids, skip_special_tokens=False)


def test_equals_the_library(library):
    texts = [r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    rng = random.Random(4)
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(4000)]
    pieces = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "a", "\n", "\n \n", " ", "don't"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(3000)]
    texts += [" " * i + "x" + " " * j + "\n" * (i % 3) + " y" for i in range(5) for j in range(5)]
    texts += ["aaaa" * 300, "ab" * 3000, "=" * 5000 + " x", None, "", "é" * 700, "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    _check(bpe.Coder(), library, texts)


def test_long_words_and_rounds_agree(library, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdest ") for _ in range(rng.randrange(60))) for _ in range(300)]
    monkeypatch.setattr(bpe, "LONG", 3)
    _check(bpe.Coder(), library, texts)
    monkeypatch.setattr(bpe, "LONG", 10**9)
    one = bpe.Coder()
    one.whole_rounds = False
    _check(one, library, texts)


def test_every_character(library):
    texts = ["a" + chr(c) + "1" + chr(c) + " " + chr(c) + "-" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["a" + chr(c) + " x" for c in range(0x10000, 0x40000, 37)]
    _check(bpe.Coder(), library, texts)


def test_decoding_any_ids(library):
    rng = random.Random(3)
    rows = [[rng.randrange(50257) for _ in range(rng.randrange(12))] for _ in range(2000)]
    flat = np.array([i for r in rows for i in r], np.int64)
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])]
    assert list(bpe.Coder().decode(flat, offsets)) == [library.decode(r, skip_special_tokens=False) for r in rows]


def test_query_is_whole(spark, library):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = bpe.op11_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(make):
    docs = make([(1, None), (1, None), (None, "a"), (2, ""), (3, "word " * 300_000), (3, "word " * 300_000)])
    rows = bpe.encode(docs).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in rows) == [(0, 1), (1, 0), (1, 0), (2, 0), (3, 300_001), (3, 300_001)]
    assert {r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {"", "a", "word " * 300_000}
    assert bpe.digests(bpe.encode(docs.limit(0))).count() == 0
