"""Top-k of many OR queries over a stored index, with bounds.

Scores are folded inside document shards: the postings table is bucketed by
document and the query side is broadcast, so a (query, document) sum needs no
exchange. Which matches are formed at all is bounded, in two reads:

1. Each query's strongest terms are scored alone, strongest first until they
   have enough documents. The k-th of these partial scores is a floor: k
   documents score that much at least.
2. A term's largest impact bounds what it can add. A query's weakest terms,
   whose bounds together stay below a part of the floor, can lift no document
   over it by themselves; only documents of the other, essential terms are
   formed, and of these only the ones that the weak terms could still lift
   over the floor are kept. The postings of the weak terms (stop words,
   mostly) are read for the kept documents only.

So a word that is in every document costs a scan of its postings, not a row
per query and document. Only shards' cut results are exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.index import K1, Index, _staged, postings_for
from vellum.operators.search import (DEFAULT_K, SCORE_DIGITS, _corpus_all_fields, _small, _with_bucket, _with_fields, analyse, bm25,
                                     clause_profile, idf, normalize, search, top_k)
from vellum.schema import TEXT_FIELDS
from vellum.session import BROADCAST_ROW_LIMIT, bounded_broadcast

#: Documents, as a multiple of k, that the strongest terms of a query should have.
PROBE = 50
#: Part of the floor that a query's weak terms may reach together: any up to 1 is right;
#: more makes more terms weak, less keeps fewer documents.
WEAK = 0.5
#: Scores closer than this to the floor are kept: above rounding and summation noise.
MARGIN = 10.0 ** -(SCORE_DIGITS - 2)


def plain_queries(clauses: DataFrame) -> DataFrame:
    """Queries of normalised clauses that this module ranks: optional terms only, without entity and negative boost."""
    plain = F.col("kind").isin("term", "exact") & (F.col("occur") == "should") & (F.col("boost") >= 0) & F.col("entity").isNull()
    return clauses.groupBy("query_id").agg(F.min(plain.cast("int")).alias("plain"))


def term_weights(idx: Index, clauses: DataFrame, small: bool) -> DataFrame:
    """(query_id, field, term, weight, avgdl, df, most, k): one row per query and term of the index, stored.

    ``weight`` is boost times idf, summed over the clauses that name the term;
    ``most`` bounds the score it can add to a document.
    """
    q = _with_fields(clauses).select("query_id", "clause_no", "boost", "field", F.explode(F.array_distinct("terms")).alias("term"))
    k = clauses.groupBy("query_id").agg(F.coalesce(F.max("k"), F.lit(DEFAULT_K)).alias("k"))
    q = q.groupBy("query_id", "field", "term").agg(F.sum("boost").alias("boost"))
    stats = idx.term_stats.select("field", "term", "df", "impact")
    stats = stats.join(_small(q.select("field", "term").distinct(), small), ["field", "term"], "left_semi")
    ref = F.broadcast(idx.ref)  # a row per text field
    rows = q.join(stats, ["field", "term"]).join(F.broadcast(_corpus_all_fields(idx)), "field").join(ref, "field", "left").join(k, "query_id")
    weight = F.col("boost") * idf(F.col("df"), F.col("n_docs"))
    # Impacts are of the lengths at the first build. Where fields are longer on average now, by a
    # factor, norms are smaller by it at most, and impacts larger by it at most (and below 1).
    longer = F.greatest(F.lit(1.0), F.col("avgdl") / F.coalesce("ref", "avgdl"))
    most = F.col("weight") * F.lit(K1 + 1.0) * F.least(F.lit(1.0), F.col("impact") * longer)
    return _staged(rows.withColumn("weight", weight).withColumn("most", most).select(
        "query_id", "field", "term", "weight", "avgdl", "df", "most", "k"))


def strongest(weights: DataFrame) -> DataFrame:
    """The terms of each query that are scored first."""
    w = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "field", "term")
    seen = F.coalesce(F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return weights.withColumn("seen", seen).where(F.col("seen") < PROBE * F.col("k")).drop("seen")


def scored(idx: Index, weights: DataFrame, small: bool) -> DataFrame:
    """(query_id, doc_id, score): sums over the terms of ``weights``, folded where the postings are."""
    post, keys = postings_for(idx, ["field", "term", "doc_id", "dl", "tf"])
    side = _small(_with_bucket(idx, weights.select("query_id", "field", "term", "weight", "avgdl")), small)
    score = bm25(F.col("weight"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return post.join(side, keys).groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))


def cut(matched: DataFrame, max_k: int, k: DataFrame, small: bool) -> DataFrame:
    """The best ``max_k`` of each query, cut in every task before they are exchanged."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = matched.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_k)
    return ranked.join(_small(k, small), "query_id").where(F.col("place") <= F.col("k"))


def floors(idx: Index, weights: DataFrame, max_k: int, small: bool) -> DataFrame:
    """(query_id, floor): the k-th best partial score of the strongest terms; 0 where they have fewer documents."""
    k = weights.select("query_id", "k").distinct()
    best = cut(scored(idx, strongest(weights), small), max_k, k, small).where(F.col("place") == F.col("k"))
    return k.join(best.select("query_id", "score"), "query_id", "left").select(
        "query_id", F.coalesce("score", F.lit(0.0)).alias("floor"))


def split_terms(weights: DataFrame, floor: DataFrame) -> DataFrame:
    """``weights`` with ``essential``, the query's ``floor`` and ``lift``, what its other terms can add in all."""
    w = Window.partitionBy("query_id").orderBy("most", "field", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = weights.join(floor, "query_id").withColumn("essential", F.sum("most").over(w) >= WEAK * F.col("floor") - MARGIN)
    whole = Window.partitionBy("query_id")
    return rows.withColumn("lift", F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))).over(whole), F.lit(0.0)))


def candidates(idx: Index, terms: DataFrame, small: bool) -> DataFrame:
    """(query_id, doc_id, score): sums over essential terms of the documents that can still reach the floor."""
    found = scored(idx, terms.where("essential"), small)
    need = terms.select("query_id", "floor", "lift").distinct()
    return found.join(_small(need, small), "query_id").where(
        F.col("score") + F.col("lift") >= F.col("floor") - MARGIN).select("query_id", "doc_id", "score")


def completed(idx: Index, terms: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """``found`` (stored) with what the other terms add to its documents."""
    rest = terms.where(~F.col("essential")).select("query_id", "field", "term", "weight", "avgdl")
    post, keys = postings_for(idx, ["field", "term", "doc_id", "dl", "tf"])
    wanted = _small(_with_bucket(idx, rest.select("field", "term").distinct()), small)
    hits = post.join(wanted, keys, "left_semi").join(bounded_broadcast(found.select("query_id", "doc_id")), "doc_id")
    more = hits.join(_small(rest, small), ["query_id", "field", "term"]).select(
        "query_id", "doc_id", bm25(F.col("weight"), F.col("tf"), F.col("dl"), F.col("avgdl")).alias("score"))
    return found.unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def ranked(idx: Index, clauses: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, score) as ``search`` gives them, from a stored index.

    Queries with other clauses than optional terms, with an entity or a
    negative boost are answered by ``search``, in the same batch. A query
    whose terms the index lacks, or with k = 0, has no rows.
    """
    clauses = normalize(clauses)
    if idx.shards is None:
        return search(idx, clauses)
    kinds = {r["plain"]: r["n"] for r in plain_queries(clauses).groupBy("plain").agg(F.count("*").alias("n")).collect()}  # two rows
    if not kinds.get(1):
        return search(idx, clauses)
    if kinds.get(0):
        clauses = _staged(clauses.join(plain_queries(clauses), "query_id"))
        rest = search(idx, clauses.where("plain = 0").drop("plain"))
        return _ranked(idx, clauses.where("plain = 1").drop("plain")).unionByName(rest)
    return _ranked(idx, clauses)


def search_text(idx: Index, queries: DataFrame) -> DataFrame:
    """Ranked hits of query texts: (query_id, text[, entity, k]) in, (query_id, rank, doc_id, score) out."""
    return ranked(idx, analyse(queries))


def _ranked(idx: Index, clauses: DataFrame) -> DataFrame:
    profile = clause_profile(clauses)
    small = sum(n * t for n, t, _, _ in profile.values()) * len(TEXT_FIELDS) <= BROADCAST_ROW_LIMIT
    max_k = max([k for _, _, k, _ in profile.values() if k is not None] or [DEFAULT_K])
    weights = term_weights(idx, clauses, small).where("k > 0")
    terms = _staged(split_terms(weights, floors(idx, weights, max_k, small)))
    found = _staged(candidates(idx, terms, small))
    total = completed(idx, terms, found, small)
    k = terms.select("query_id", "k").distinct()
    return top_k(total.join(_small(k, small), "query_id"), max_k)
