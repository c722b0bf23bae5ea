"""Similarity join on names (J5): all pairs with Jaro-Winkler > 0.85.

Never the cross product. A lossless filter derived from the definition
produces candidates with equi joins, and the exact score (an Arrow-batched
helper) runs on the distinct candidates only.

Bound: with c = size of the common character multiset, jaro <= (c/|a| +
c/|b| + 1) / 3 and the Winkler boost is at most 0.4 * (1 - jaro), so a score
above 0.85 needs c/|a| + c/|b| > 1.25, and > 1.55 when the first characters
differ (no common prefix). For the shorter string a that is
c > 0.625 |a| (resp. 0.775 |a|), and |a| / |b| > 0.25 (resp. 0.55).

A string is a set of tokens (character, occurrence number), so c is the
token overlap. If the overlap reaches t, any |a| - t + 1 tokens of a contain
a shared one: we take a's rarest tokens as its probe prefix and equi-join
them with every token of the longer string, keyed also on the first
character in the same-first-character case. Rarest-first keeps the probe
keys away from common tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.similarity import ROUND_DIGITS, THRESHOLD, jaro_winkler_udf
from vellum.session import bounded_broadcast

# Fixed values derived from the threshold above (see module docstring).
SAME_FIRST_FRACTION = 0.625
DIFF_FIRST_FRACTION = 0.775
SAME_FIRST_MIN_RATIO = 0.25
DIFF_FIRST_MIN_RATIO = 0.55
SAME_FIRST_BAG = 1.25   # c/|a| + c/|b| must exceed this (common prefix possible)
DIFF_FIRST_BAG = 1.55   # ... and this when the first characters differ


def _token_array(name):
    """The (character, occurrence) tokens of a name: 'a#1', 'b#1', 'a#2', ..."""
    chars = F.split(name, "")
    return F.transform(chars, lambda c, i: F.concat(
        c, F.lit("#"), F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))


def _tokens(names: DataFrame) -> DataFrame:
    """(name, len, first, tok)."""
    return names.select("name", F.length("name").alias("len"), F.substring("name", 1, 1).alias("first"),
                        F.explode(_token_array(F.col("name"))).alias("tok"))


def bag_bound_ok(a, b, ta, tb):
    """The bound of the module docstring on the exact common-character
    count c (overlap of the token arrays ``ta``, ``tb``), in the JVM."""
    c = F.size(F.array_intersect(ta, tb))
    s = c / F.length(a) + c / F.length(b)
    same_first = F.substring(a, 1, 1) == F.substring(b, 1, 1)
    return F.when(same_first, s > F.lit(SAME_FIRST_BAG)).otherwise(s > F.lit(DIFF_FIRST_BAG))


def _bag_filtered(cand: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates that pass the bag bound. Token arrays are built once per
    distinct name and attached by joins (broadcast when the name list is
    proven small)."""
    def arrays(names, col, arr):
        return bounded_broadcast(names.select(F.col("name").alias(col)).distinct()
                                 .withColumn(arr, _token_array(F.col(col))))
    c = cand.join(arrays(left, "a", "ta"), "a").join(arrays(right, "b", "tb"), "b")
    return c.where(bag_bound_ok(F.col("a"), F.col("b"), F.col("ta"), F.col("tb"))).select("a", "b")


def _probes(tokens: DataFrame, freq: DataFrame, fraction: float) -> DataFrame:
    """The ``len - floor(fraction * len)`` rarest tokens of each name."""
    w = Window.partitionBy("name").orderBy("n", "tok")
    keep = F.col("len") - F.floor(F.col("len") * F.lit(fraction))
    return (tokens.join(freq, "tok").withColumn("r", F.row_number().over(w))
            .where(F.col("r") <= keep).drop("r", "n"))


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (a, b), a from ``left.name``, b from ``right.name``, that may
    score above the threshold (a superset of the true pairs)."""
    lt = _tokens(left.select("name").distinct())
    rt = _tokens(right.select("name").distinct())
    # Token vocabulary: bounded by alphabet size x longest name; size-checked.
    freq = bounded_broadcast(lt.unionByName(rt).groupBy("tok").agg(F.count(F.lit(1)).alias("n")))
    out = []
    for probe_side, target_side, swap in ((lt, rt, False), (rt, lt, True)):
        for fraction, ratio, same in ((SAME_FIRST_FRACTION, SAME_FIRST_MIN_RATIO, True),
                                      (DIFF_FIRST_FRACTION, DIFF_FIRST_MIN_RATIO, False)):
            p = _probes(probe_side, freq, fraction).select(
                F.col("name").alias("p_name"), F.col("len").alias("p_len"),
                F.col("first").alias("p_first"), "tok")
            t = target_side.select(F.col("name").alias("t_name"), F.col("len").alias("t_len"),
                                   F.col("first").alias("t_first"), "tok")
            if same:
                j = p.join(t, (p["tok"] == t["tok"]) & (p["p_first"] == t["t_first"]))
            else:
                j = p.join(t, "tok").where(F.col("p_first") != F.col("t_first"))
            shorter = (F.col("p_len") < F.col("t_len")) if swap else (F.col("p_len") <= F.col("t_len"))
            j = j.where(shorter & (F.col("p_len") > F.lit(ratio) * F.col("t_len")))
            a, b = ("t_name", "p_name") if swap else ("p_name", "t_name")
            out.append(j.select(F.col(a).alias("a"), F.col(b).alias("b")))
    cand = out[0]
    for o in out[1:]:
        cand = cand.unionByName(o)
    return cand.distinct()


def similar_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, score) with round(score, 12) > 0.85."""
    cand = _bag_filtered(candidate_pairs(left, right), left, right)
    scored = cand.withColumn("score", jaro_winkler_udf("a", "b"))
    return scored.where(F.round("score", ROUND_DIGITS) > F.lit(THRESHOLD))


def suggestions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Per new name, the similar existing names in name order."""
    pairs = similar_pairs(new, existing)
    return pairs.groupBy(F.col("a").alias("name")).agg(
        F.array_sort(F.collect_list("b")).alias("suggestions"))
