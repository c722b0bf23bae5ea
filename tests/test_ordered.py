import random

from vellum.operators.ordered import next_at_or_after, path_marks


def test_next_at_or_after_matches_brute_force(spark):
    rnd = random.Random(3)
    targets = sorted({(rnd.choice("abc"), rnd.randint(-60, 60)) for _ in range(80)})
    probes = [(i, rnd.choice("abcd"), rnd.randint(-70, 70)) for i in range(120)]
    t = spark.createDataFrame(targets, "key string, pos long")
    p = spark.createDataFrame(probes, "pid long, key string, at long")
    got = {r.pid: r.hit for r in next_at_or_after(p, t, block=4).collect()}
    for pid, key, at in probes:
        cands = [pos for k, pos in targets if k == key and pos >= at]
        assert got[pid] == (min(cands) if cands else None), (pid, key, at)


def test_path_marks(spark):
    # two chains merging, one isolated node
    succ = spark.createDataFrame([(1, 3), (2, 3), (3, 7), (7, 9), (9, None), (4, 5), (5, None), (20, None)],
                                 "node long, nxt long")
    starts = spark.createDataFrame([(2,), (4,)], "node long")
    assert sorted(r.node for r in path_marks(starts, succ).collect()) == [2, 3, 4, 5, 7, 9]
