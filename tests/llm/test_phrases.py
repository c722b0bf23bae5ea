import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vellum.llm import phrases

SF = "/root/testdata/sf0.01"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, min_count, max_words=5, top=2000):
    """The contract by plain loops; rows are (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for cut in ".,;:!?\x0b\x0c\r":
            low = low.replace(cut, "\n")
        for piece in low.split("\n"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(ws)
            for k in range(1, max_words + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    often = {p: a for p, a in f.items() if a >= min_count}
    found = []
    for (lang, ws), a in often.items():
        if len(ws) > 1:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, ws[:j]] * f[lang, ws[j:]]), j, f[lang, ws[:j]], f[lang, ws[j:]])
                                        for j in range(1, len(ws)))
            inside = any(la == lang and len(q) > len(ws) and 100 * b >= 100 * a and any(q[i:i + len(ws)] == ws for i in range(len(q)))
                         for (la, q), b in often.items())
            if not inside:
                found.append((lang, -score, -a, " ".join(ws).encode(), left, right))
    out, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, word string, a int").repartition(3)


def mine(spark, rows, min_count, **kw):
    return sorted(tuple(r[c] for c in NAMES) for r in phrases.collocations(table(spark, rows), min_count=min_count, **kw).collect())


def _rows(seed, count=150):
    rng = random.Random(seed)
    words = ["a", "B", "the", "é", "x\x1cy", "of", "日本", "c", "Ä"]
    mark = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\r\n", ";"]
    return [("".join(rng.choice(words) + rng.choice(mark) for _ in range(rng.randrange(30))), rng.choice(["en", "fr", None, "und"])) for _ in range(count)]


def test_equals_brute_force(spark):
    rows = _rows(1) + [("a a a a a a " * 20, "en"), (None, "en"), ("", None), (". , ;", "fr"), ("one two three four five " * 12, "de")]
    for size in (phrases.TRIE_PHRASES, 40):  # one trie and many
        assert mine(spark, rows, 6, trie_phrases=size) == sorted(brute(rows, 6))
    assert mine(spark, rows, 6, top=3) == sorted(brute(rows, 6, top=3))
    assert mine(spark, rows, 10 ** 6) == [] and mine(spark, [(None, None)], 1) == []
    assert phrases.collocations(table(spark, rows).limit(0)).count() == 0


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(phrases.ORACLE).fetchall()
    got = [tuple(r[c] for c in NAMES) for r in phrases.op12_phrases(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50


def test_big_products_are_exact(spark):
    every = spark.createDataFrame([("en", ["p", "q"], 10 ** 12), ("en", ["p"], 10 ** 12 + 7), ("en", ["q"], 10 ** 12 + 9)], "lang string, words array<string>, a long")
    totals = spark.createDataFrame([("en", 10 ** 15)], "lang string, n long")
    real, phrases.frequent_phrases = phrases.frequent_phrases, lambda *a: (every, totals)
    try:
        row = phrases.collocations(None).first()
    finally:
        phrases.frequent_phrases = real
    assert row.score == 1000 * 10 ** 12 * 10 ** 15 // ((10 ** 12 + 7) * (10 ** 12 + 9))


def test_trie_holds_what_was_put_in():
    rng = np.random.default_rng(2)
    for words, k in ((5, 3), (300, 2), (70_000, 2), (700, 4)):
        rows = np.unique(rng.integers(0, words, (4000, k)) * 7 + 3, axis=0)
        trie = phrases.Trie(rows)
        assert len(set(trie.accept.tolist())) == len(rows)
        text = np.concatenate([rows.ravel(), rng.integers(-1, 7 * words, 3000), rows[::-1].ravel()])
        want = {tuple(r): s for r, s in zip(rows.tolist(), trie.accept.tolist())}
        got = trie.walk(trie.codes(text), k)
        assert got.tolist() == [want.get(tuple(text[i:i + k].tolist()), 0) for i in range(len(text))]


def test_units_keep_little_and_ids_may_clash(spark, monkeypatch):
    rows = _rows(3, 400) + [("x y z " * 9, "en")] * 3
    want = sorted(brute(rows, 12))
    assert want and mine(spark, rows, 12) == want  # few units: only what is frequent in one is sent
    monkeypatch.setattr(phrases, "HELD", 5)  # tasks send all they hold, often
    assert mine(spark, rows, 12) == want
    spread = [("one two " + str(i), "en") for i in range(12)]  # once in each of as many units as it is asked for
    docs = table(spark, spread).repartition(12)
    assert [(r.phrase, r.a) for r in phrases.collocations(docs, min_count=12).collect()] == [("one two", 12)]
    real = phrases.word_ids
    monkeypatch.setattr(phrases, "word_ids", lambda lang, words, seed: real(lang, words, seed) & (7 if seed < 2 else -1))
    assert mine(spark, rows, 12) == want  # two seeds give words of one id
    monkeypatch.setattr(phrases, "word_ids", real)
    monkeypatch.setattr(phrases, "BITMAP_BITS", 19)
    assert mine(spark, rows, 12) == want


def test_units_send_frequent_pairs_few_times(spark, monkeypatch):
    """Pairs of many places are named to the units, not sent by each; what only one unit holds is found all the same."""
    some = [(f"p{i} q{i} r{i}", "en") for i in range(40)]
    alone = [("only here " * 4, "en")] * 30
    docs = spark.createDataFrame([(u * 1000 + i, *r) for u in range(36) for i, r in enumerate(some * 4 + (alone if u == 5 else []))],
                                 "doc_id long, text string, lang string").repartitionByRange(36, F.col("doc_id"))
    pairs, counts, real = [], [], phrases.keep

    def keep(df, label):
        out = real(df, label)
        if label == "phrase-found":
            pairs.append(out[0].where("right is not null").count())
        if label == "phrase-heard":
            counts.append(out[0].count())
        return out

    monkeypatch.setattr(phrases, "keep", keep)
    cost = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, str(1 << 30))  # a task a file
    try:
        got = sorted(tuple(r[c] for c in NAMES) for r in phrases.collocations(docs, min_count=100).collect())
    finally:
        spark.conf.set(cost, before)
    assert got == sorted(brute((some * 4) * 36 + alone, 100))
    assert any(r[2].startswith("only here") for r in got)
    there = 40 * 2 + 40  # p q, q r; p q r
    assert 0 < sum(pairs) < 10 * there  # sent by each of 36 units: 36 * there
    assert sum(counts) < 10 * there  # as much for a row a phrase


def test_known_pairs_are_left_out():
    known = phrases._Known(np.array([5, 5, 9]), np.array([7, 9, 5]))
    left, right, n = known.others((np.array([5, 5, 9, 9, 7, 1, 99]), np.array([7, 5, 5, 99, 9, 7, 5]), np.arange(7)))
    assert n.tolist() == [1, 3, 4, 5, 6] and left.tolist() == [5, 9, 7, 1, 99] and right.tolist() == [5, 99, 9, 7, 5]


def test_words_and_pieces():
    words, text, joined = phrases.split_words(pa.array(["One two.three", None, "", "x", "y  z\tq\x0b", " w"]))
    assert [w.decode() for w in words.to_pylist()] == ["one", "two", "three", "x", "y", "z", "q", "w"]
    assert text.tolist() == [0, 0, 0, 3, 4, 4, 4, 5]
    assert joined.tolist() == [False, True, False, False, False, True, True, False]
