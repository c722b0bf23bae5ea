import random

import pyarrow.parquet as pq
import pytest
import xxhash

from vellum.llm.simhash import drop_near_duplicates, fingerprint, op1_simhash, simhash_components

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = []
    for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate(
            {c: 32 for c in (9, 10, 11, 12, 13)}).split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(fps, d):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_whole_table_against_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    fps = [brute_fingerprint(r["text"]) for r in t]
    roots = brute_components(fps, 4)
    low = {}
    for r, root in zip(t, roots):
        low[root] = min(low.get(root, r["doc_id"]), r["doc_id"])
    want = {(r["doc_id"], f"{fp:016x}", low[root]) for r, fp, root in zip(t, fps, roots)}
    got = [tuple(r) for r in op1_simhash(spark, SF).collect()]
    assert len(got) == len(t) and set(got) == want


@pytest.mark.parametrize("d,bands", [(3, 3), (4, 3), (4, 2)])
def test_no_link_is_missed(spark, d, bands):
    from vellum.llm.components import connected_components
    from vellum.llm.simhash import links
    rng = random.Random(d * 10 + bands)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for i in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << i
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in connected_components(links(frame, d, bands)).collect()}
    roots = brute_components(fps, d)
    groups = {}
    for x, r in zip(signed, roots):
        groups.setdefault(r, set()).add(x)
    for members in groups.values():
        assert {got.get(x, x) for x in members} == {min(members)}


def test_large_group_is_split_and_whole(spark, monkeypatch):
    from vellum.llm import simhash
    from vellum.llm.components import connected_components
    monkeypatch.setattr(simhash, "HOT_ANCHOR", 100)
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)})
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    out = connected_components(simhash.links(frame)).collect()
    assert len(out) == len(fps) and len({r.root for r in out}) == 1


def test_odd_rows(make):
    a = "one two three four five six"
    docs = make([(5, a), (3, a.upper()), (5, a), (None, a), (9, None), (8, ""), (7, " \t\n"), (None, "zz"), (1, "x " * 200_000)])
    rows = simhash_components(docs).collect()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.component_id), []).append(r.kept)
    assert len(rows) == 9
    assert sorted(by[(5, 3)] + by[(3, 3)] + by[(None, 3)]) == [False, False, False, True] and by[(3, 3)] == [True]
    assert by[(9, 7)] == [False] and by[(7, 7)] == [True] and by[(None, None)] == [True]
    kept = drop_near_duplicates(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns and kept.count() == 4
    assert simhash_components(make([(1, "a")]).limit(0)).count() == 0


def test_fingerprint_matches_definition():
    for t in ("", "A b", "Ünï Code wörds and MORE words here", "a a a a a a a", "x\x1cy z q r s t"):
        assert fingerprint(t) == brute_fingerprint(t)
