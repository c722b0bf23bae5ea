"""Order-dependent building blocks without per-key collection.

``next_at_or_after``: for each probe (key, at), the first target of the same
key whose position is >= at (an as-of lookup). Positions are cut into blocks
of ``block`` consecutive values: a window per (key, block) answers probes
whose target lies in the same block; a second window over one summary row per
(key, non-empty block) answers the rest. No window partition holds more than
a block's rows or one row per block of a key, so one very hot key is spread
over many tasks.

``path_marks``: nodes reachable from start nodes along a successor pointer
(succ(v) > v), by pointer doubling: O(log path length) rounds of joins on
unique node ids, each round stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.index import _staged

DEFAULT_BLOCK = 1 << 20


def next_at_or_after(probes: DataFrame, targets: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """probes(pid, key, at), targets(key, pos) -> probes + ``hit`` (the
    smallest target pos >= at for the same key, or NULL)."""
    p = probes.select("pid", "key", F.col("at").alias("pos"), F.lit(0).alias("kind"))
    t = targets.select(F.lit(None).cast(probes.schema["pid"].dataType).alias("pid"), "key", "pos",
                       F.lit(1).alias("kind"))
    rows = p.unionByName(t).withColumn("blk", F.floor(F.col("pos") / F.lit(block)))
    # probes sort before targets at the same position, so ">=" finds them
    w = (Window.partitionBy("key", "blk").orderBy("pos", "kind")
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("hit", F.min(F.when(F.col("kind") == 1, F.col("pos"))).over(w))
    local = rows.where(F.col("kind") == 0).select("pid", "key", "blk", "hit")
    # Fallback: first non-empty later block of the same key.
    firsts = targets.groupBy("key", F.floor(F.col("pos") / F.lit(block)).alias("blk")).agg(
        F.min("pos").alias("first"))
    need = local.where(F.col("hit").isNull()).select("key", "blk").distinct()
    # a block's own summary sorts before its probe row, so "following rows"
    # are strictly later blocks
    b = (need.select("key", "blk", F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind"))
         .unionByName(firsts.select("key", "blk", F.col("first").cast("long"), F.lit(0).alias("kind"))))
    wb = (Window.partitionBy("key").orderBy("blk", "kind")
          .rowsBetween(1, Window.unboundedFollowing))
    later = (b.withColumn("later", F.min(F.when(F.col("kind") == 0, F.col("first"))).over(wb))
             .where(F.col("kind") == 1).select("key", "blk", "later"))
    out = local.join(later, ["key", "blk"], "left").select(
        "pid", F.coalesce("hit", "later").alias("hit"))
    return probes.join(out, "pid", "left")


def path_marks(starts: DataFrame, succ: DataFrame) -> DataFrame:
    """starts(node), succ(node, nxt) -> (node) of every node on a path from a
    start. Successors increase, so paths are finite."""
    jumps = [_staged(succ.where(F.col("nxt").isNotNull()).select("node", "nxt"))]
    while jumps[-1].limit(1).count() > 0:
        j = jumps[-1]
        j2 = (j.join(j.select(F.col("node").alias("nxt"), F.col("nxt").alias("nxt2")), "nxt")
              .select("node", F.col("nxt2").alias("nxt")))
        jumps.append(_staged(j2))
    marked = _staged(starts.select("node").distinct())
    for j in reversed(jumps[:-1]):
        step = marked.join(j, "node").select(F.col("nxt").alias("node"))
        marked = _staged(marked.unionByName(step).distinct())
    return marked
