import random

import pyarrow.parquet as pq

from vellum.llm import lines

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, min_words=5):
    """rows: (doc_id, text) in table order -> per row the dropped line numbers."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, near, out = set(), [], [[] for _ in rows]
    for i in order:
        for k, line in enumerate((rows[i][1] or "").lower().split("\n")):
            w = tuple(line.split())
            if not w:
                continue
            hit = w in seen or any(abs(len(w) - len(x)) < 2 and max(len(w), len(x)) >= min_words
                                   and sum(p != q for p, q in zip(w, x)) <= len(w) and distance(w, x) <= 1 for x in near)
            if hit:
                out[i].append(k)
            if w not in seen:
                seen.add(w)
                near.append(w)
    return out


def test_against_brute_force(make):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 12))] for _ in range(25)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, 3)):
                p = rng.randrange(len(w) + 1)
                w[p:p + rng.randrange(2)] = rng.choice([[], [rng.choice(words)]])
            text.append(("  " if rng.random() < 0.2 else " ").join(w).title())
        rows.append((d, "\n".join(text)))
    rng.shuffle(rows)
    got = {r.doc_id: r.dropped for r in lines.line_dedup(make(rows)).collect()}
    want = {r[0]: x for r, x in zip(rows, brute(rows))}
    assert got == want and sum(map(len, want.values())) > 60


def test_whole_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()][:60]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in lines.line_dedup(frame).collect()}
    assert got == {d: (t.count("\n") + 1, len(x), x) for (d, t), x in zip(rows, brute(rows))}


def test_every_edit_shares_a_key_and_a_half():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(5, 14))]
        b, p = list(a), rng.randrange(len(a))
        kind = rng.randrange(3)
        b[p:p + (kind > 0)] = [["z"], ["y"], []][kind]
        assert lines.within_one(a, b) and distance(a, b) == 1
        assert set(lines.half_keys(a)) & set(lines.half_keys(b))
        (ka, xa), (kb, xb) = lines.variants(a), lines.variants(b)
        short, long = ((ka, xa), (kb, xb)) if len(a) < len(b) else ((kb, xb), (ka, xa))
        if kind == 1:
            assert set(ka[xa == 0].tolist()) & set(kb[xb == 0].tolist())
        else:
            assert short[0][short[1] == 2][0] in long[0][long[1] == 1]
    assert not lines.within_one(list("abcde"), list("bcdef")) and lines.within_one([], ["a"])


def test_odd_rows(make):
    long = "one two three four five six"
    docs = make([(3, long), (1, long + " seven"), (None, long), (1, None), (2, "\n\n"), (2, "x\nx\n" + "y " * 60_000), (5, "Y " * 60_001)])
    out = sorted(((r.doc_id, r.n_lines, r.dropped) for r in lines.line_dedup(docs).collect()), key=str)
    assert out == sorted([(3, 1, [0]), (1, 1, []), (None, 1, [0]), (1, 1, []), (2, 3, []), (2, 3, [1]), (5, 1, [0])], key=str)
    texts = {r.text for r in lines.clean(docs).collect()}
    assert lines.clean(docs).columns == docs.columns and "x\n" + "y " * 60_000 in texts and None in texts
    assert lines.line_dedup(docs.limit(0)).count() == 0
