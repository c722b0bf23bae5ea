import hashlib

import duckdb
import numpy as np
import pytest

from vellum.llm import codes

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, entry string, __of int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{(vec_id, vector): (code, error, label_error)} and the codebooks by plain loops over all entries."""
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * scale).astype(int).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        code = d.argmin(-1)
        if turn < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (code[:, p] == e).any():
                        mine = x[code[:, p] == e, p]
                        books[p, e] = mine.sum(0) // len(mine)
    error = d.min(-1).sum(-1)
    by = {}
    for (_, _, lab), e in zip(rows, error):
        by[lab] = by.get(lab, 0) + int(e)
    out = [(i, bytes(c.astype(np.uint8)).hex(), int(e), by[lab]) for (i, _, lab), c, e in zip(rows, code, error)]
    return sorted(out, key=str), hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()


def mine(spark, rows, **kw):
    coded, books = codes.vector_codes(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), **kw)
    got = [(r.vec_id, bytes(r.entry).hex(), r.error, r.label_error) for r in codes.label_errors(coded).collect()]
    return sorted(got, key=str), codes.books_sha256(books)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({codes.ORACLE})").fetchall()
    got = [tuple(r[c] for c in names) for r in codes.op13_codes(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) == 500


@pytest.mark.parametrize("b", [1, 2, 15, 30])
def test_equals_brute_force_with_ties(spark, b):
    rng = np.random.default_rng(b)
    rows = [(int(i), [float(v) / 2 for v in rng.integers(-3, 4, 16)], int(i) % 3 or None) for i in range(400)]
    rows += [(int(i), rows[5][1], 1) for i in range(50, 150)]  # a group of equal vectors, repeated ids
    assert mine(spark, rows, first_b=b) == brute(rows)


def test_odd_rows(spark):
    ok = [0.25 * k for k in range(8)]
    rows = [(3, ok, None), (3, ok, None), (None, ok[::-1], 2), (1, None, 2), (2, [float("nan")] * 8, 1),
            (4, [float("inf")] + ok[1:], 1), (5, [None] + ok[1:], 1), (6, [-v for v in ok], 2)]
    assert mine(spark, rows) == brute(rows)
    assert len(mine(spark, rows)[0]) == 4  # fewer vectors than entries
    assert mine(spark, rows[3:5])[0] == []
    with pytest.raises(Exception, match="lengths"):
        mine(spark, [(1, ok, 1), (2, ok * 2, 1)])
    with pytest.raises(Exception, match="too large"):
        mine(spark, [(1, ok, 1), (2, [1e8] * 8, 1)])


def test_bounds_save_distances_and_stay_true():
    rng = np.random.default_rng(0)
    centres = rng.integers(-500, 500, (16, 4))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-9, 10, (3000, 4))
    books, one = x[:16].copy(), None
    b, deep = 4, []
    for turn in range(6):
        if one is None:
            one = codes.Bounds.of(x, books, b)
        else:
            one.resize(b)
            depth = one.update(x, books, moved)
            deep.append(float((depth > 0).mean()))
            b = codes.next_b(np.bincount(depth, minlength=257), b, 16)
        d = codes.distances(x, books)
        assert (one.entry == d.argmin(1)).all()
        root = np.sqrt(d)
        assert (one.upper >= root[np.arange(3000), one.entry]).all()
        listed = np.where(one.near == 255, 0, one.near)
        assert ((one.near == 255) | (one.low <= np.take_along_axis(root, listed.astype(int), 1))).all()
        others = np.ones((3000, 16), bool)
        np.put_along_axis(others, one.entry[:, None].astype(int), False, 1)
        np.put_along_axis(others, np.where(one.near == 255, one.entry[:, None], one.near).astype(int), False, 1)
        assert (one.outer[:, None] <= np.where(others, root, np.inf)).all()
        new = np.stack([x[one.entry == e].sum(0) // max(1, (one.entry == e).sum()) if (one.entry == e).any() else books[e] for e in range(16)])
        moved = codes.moves(books[None], new[None])[0]
        books = new
    assert deep[-1] < 0.5
    assert codes.next_b(np.r_[98, 0, 2, np.zeros(254, int)], 4, 16) == 2 and codes.next_b(np.r_[10, 0, 0, 0, 0, 90, np.zeros(251, int)], 4, 16) == 5
