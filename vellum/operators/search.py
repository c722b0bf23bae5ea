"""Many-query full-text search over the index tables.

A query is a set of rows in a clause table (``vellum.schema.QUERIES`` plus a
``kind`` column):

``kind``   term | phrase | exact | set | range | prefix | all
           (prefix with several terms is a phrase whose last word is a prefix)
``occur``  should | must | must_not
``field``  NULL means the default fields title, content and tags

``search`` brings the postings of the query terms together by document and
folds all clauses, the boolean rule, the entity filter and a first cut in each
block of documents (``vellum.operators.fold``); the top-k cut follows.

``match`` gives all pairs: every clause is matched against ``postings`` with
equi joins whose small side is the (size-checked) query terms, scored with
BM25 in column expressions, and all clauses are folded per (query, document)
in one aggregation; the boolean rule and the entity filter follow.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import terms
from vellum.operators.fold import Batch, best_of_blocks
from vellum.operators.index import (B, K1, Index, _staged, corpus_of, doc_shard, length_norm, positions_of, postings_for, raw_postings,
                                    term_bucket, term_stats_of, text_postings)
from vellum.schema import RAW_FIELDS, TEXT_FIELDS
from vellum.session import BROADCAST_ROW_LIMIT, bounded_broadcast

# Fixed value: the default result limit.
DEFAULT_K = 10
WHITE_SPACE = r"[ \t\n\x0B\f\r]+"
VIRTUAL_SHARDS = 64  # document shards where the index has none of its own
KINDS = {"term", "exact", "phrase", "set", "range", "prefix", "phrase_prefix", "all"}
SCORE_DIGITS = 6
BLOCK = 8192          # documents of a block, about: a task holds their postings
QUERY_ROWS = 200_000  # clauses that every task holds at once

MATCH_COLS = ["query_id", "clause_no", "occur", "doc_id", "score"]


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25(weight: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    """``weight`` is boost * idf; the rest is the BM25 term-frequency factor."""
    return weight * F.lit(K1 + 1.0) * tf / (tf + length_norm(dl, avgdl))


def clause(query_id, clause_no, kind, terms, occur="should", field=None, slop=None, boost=1.0):
    """A clause row as a dict, for building small clause tables in tests."""
    return dict(query_id=query_id, clause_no=clause_no, occur=occur, kind=kind, field=field,
                terms=list(terms), slop=slop, boost=boost)


def _with_fields(clauses: DataFrame) -> DataFrame:
    default = F.array(*[F.lit(f) for f in TEXT_FIELDS])
    return clauses.withColumn(
        "field", F.explode(F.when(F.col("field").isNull(), default).otherwise(F.array("field"))))


def _corpus_all_fields(idx: Index) -> DataFrame:
    """Corpus statistics for text fields, plus raw fields with avgdl 1."""
    raw = idx.corpus.where(F.col("field") == TEXT_FIELDS[0]).select(
        F.explode(F.array(*[F.lit(f) for f in RAW_FIELDS])).alias("field"),
        "n_docs", F.lit(1.0).alias("avgdl"))
    return idx.corpus.select("field", "n_docs", "avgdl").unionByName(raw)


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _with_bucket(idx: Index, terms: DataFrame) -> DataFrame:
    if idx.buckets and "tb" in idx.postings.columns:
        return terms.withColumn("tb", term_bucket(F.col("term"), idx.buckets))
    return terms


def _term_weights(idx: Index, qterms: DataFrame, small: bool) -> DataFrame:
    """Attach df, N, avgdl and idf to the query-term rows (``small``: their
    count is proven to be under the broadcast bound)."""
    corpus = F.broadcast(_corpus_all_fields(idx))  # at most 7 rows: one per field
    wanted = _small(qterms.select("field", "term").distinct(), small)
    # a semi join on the grouping keys is pushed below the df aggregate, so an
    # index built in the same plan counts only the query terms' postings
    stats = idx.term_stats.join(wanted, ["field", "term"], "left_semi")
    return (qterms.join(stats, ["field", "term"], "left")
            .join(corpus, "field")
            .withColumn("df", F.coalesce(F.col("df"), F.lit(0)))
            .withColumn("idf", idf(F.col("df"), F.col("n_docs"))))


def _term_matches(idx: Index, clauses: DataFrame, small: bool) -> DataFrame:
    qt = (_with_fields(clauses.where(F.col("kind").isin("term", "exact")))
          .select("query_id", "clause_no", "occur", "boost", "field",
                  F.explode(F.array_distinct("terms")).alias("term")))  # any word of the clause
    qt = _with_bucket(idx, _term_weights(idx, qt, small))
    post, keys = postings_for(idx, ["field", "term", "doc_id", "dl", "tf"])
    m = post.join(_small(qt, small), keys)
    return m.select("query_id", "clause_no", "occur", "doc_id",
                    bm25(F.col("boost") * F.col("idf"), F.col("tf"), F.col("dl"),
                         F.col("avgdl")).alias("score"))


def _phrase_matches(idx: Index, clauses: DataFrame, small: bool) -> DataFrame:
    """Phrases: every term at consecutive positions (slop 0), or all in order
    with at most ``slop`` other positions between them, in all.

    Phrase frequency = number of places of the last term at which the
    narrowest match that ends there is narrow enough; idf is the
    sum of the terms' idfs. Candidate documents (every word of the phrase in
    the field) come from postings; positions are kept only in candidates
    before the position aggregations. Matched token rows are clustered once
    by (query, clause, field, document) by that semi join; both aggregations
    below reuse the partitioning.
    """
    ph = (_with_fields(clauses.where(F.col("kind") == "phrase"))
          .select("query_id", "clause_no", "occur", "boost", "field",
                  F.coalesce("slop", F.lit(0)).alias("slop"), F.size("terms").alias("n"),
                  F.posexplode("terms").alias("offset", "term")))
    ph = _term_weights(idx, ph, small)
    clause_idf = ph.groupBy("query_id", "clause_no", "field").agg(F.sum("idf").alias("idf_sum"))
    ph = _with_bucket(idx, ph.join(clause_idf, ["query_id", "clause_no", "field"]))
    clause_keys = ["query_id", "clause_no", "field", "doc_id"]
    post, pkeys = postings_for(idx, ["field", "term", "doc_id"])
    cand = (post.join(_small(ph.select(*pkeys, "query_id", "clause_no", "n"), small), pkeys)
            .groupBy(*clause_keys, "n").agg(F.count(F.lit(1)).alias("have"))
            .where(F.col("have") == F.col("n")).select(*clause_keys))
    # Shuffle semi join keyed like the aggregations below (its shuffle is the
    # only one on the matched positions); Spark's runtime bloom filter built
    # from the candidates can drop positions before that shuffle.
    m = positions_of(idx, _small(ph, small)).join(cand, clause_keys, "left_semi")
    doc_keys = ["query_id", "clause_no", "occur", "boost", "field", "doc_id", "dl", "avgdl", "idf_sum"]

    # slop 0: a start position where all n offsets are present
    starts = (m.where(F.col("slop") == 0)
              .groupBy(*doc_keys, "n", (F.col("pos") - F.col("offset")).alias("start"))
              .agg(F.count(F.lit(1)).alias("hits"))
              .where(F.col("hits") == F.col("n")))
    exact = starts.groupBy(*doc_keys).agg(F.count(F.lit(1)).alias("pf"))

    # slop > 0: one pass over the places of all words in order. ``starts[i]``
    # is where the narrowest match of the first i + 1 words so far begins;
    # at one place later words come first, so that no place serves twice.
    place = F.struct("pos", (-F.col("offset")).alias("later"))
    walked = (m.where(F.col("slop") > 0).groupBy(*doc_keys, "n", "slop")
              .agg(F.array_sort(F.collect_list(place)).alias("places"), F.count_distinct("offset").alias("have"))
              .where(F.col("have") == F.col("n")))
    nothing = F.transform(F.sequence(F.lit(1), F.col("n")), lambda _: F.lit(None).cast("int"))
    begin = F.struct(nothing.alias("starts"), F.lit(0).cast("long").alias("pf"))

    def step(acc, x):
        begins = F.when(x["later"] == 0, x["pos"]).otherwise(F.get(acc["starts"], -x["later"] - 1))
        ends = (-x["later"] == F.col("n") - 1) & (x["pos"] - begins <= F.col("n") - 1 + F.col("slop"))
        starts = F.transform(acc["starts"], lambda v, i: F.when(i == -x["later"], F.coalesce(begins, v)).otherwise(v))
        return F.struct(starts.alias("starts"), (acc["pf"] + F.coalesce(ends, F.lit(False)).cast("long")).alias("pf"))

    sloppy = walked.select(*doc_keys, F.aggregate("places", begin, step)["pf"].alias("pf"))
    scored = exact.unionByName(sloppy).where(F.col("pf") > 0)
    return scored.select("query_id", "clause_no", "occur", "doc_id",
                         bm25(F.col("boost") * F.col("idf_sum"), F.col("pf"), F.col("dl"),
                              F.col("avgdl")).alias("score"))


def _node(term: Column) -> Column:
    """The first two bytes of a term as a number; a missing byte is 0. Terms are ordered by bytes, so by this first."""
    digits = F.rpad(F.substring(F.hex(F.encode(term, "UTF-8")), 1, 4), 4, "0")
    return F.conv(digits, 16, 10).cast("int")


def _expand(idx: Index, patterns: DataFrame, small: bool) -> DataFrame:
    """Rows of ``patterns`` (kind range or prefix, field, terms) with each ``term`` of the dictionary they take.

    The dictionary is cut by its terms' first byte and first two bytes. A
    pattern goes to the cuts it covers: a prefix to one, a range to the whole
    bytes between its ends and the byte pairs at both; so terms meet only the
    patterns of their cuts, in an equi join, and are compared there.
    """
    lo, hi = F.get("terms", 0), F.get("terms", 1)
    a, b = _node(lo), _node(hi)
    byte, pair = F.lit(1), F.lit(2)

    def cuts(level, start, stop):
        return F.transform(F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>")),
                           lambda n: F.struct(level.alias("level"), n.alias("node")))

    low, high = F.shiftright(a, 8), F.shiftright(b, 8)
    ends = F.when(low == high, cuts(pair, a, b)).otherwise(
        F.concat(cuts(pair, a, low * 256 + 255), cuts(pair, high * 256, b)))
    of_range = F.when(lo <= hi, F.concat(cuts(byte, low + 1, high - 1), ends))
    size = F.octet_length(lo)
    of_prefix = F.when(size >= 2, cuts(pair, a, a)).when(size == 1, cuts(byte, low, low)).otherwise(cuts(byte, F.lit(0), F.lit(255)))
    routed = (patterns.withColumn("cut", F.explode(F.when(F.col("kind") == "range", of_range).otherwise(of_prefix)))
              .select("*", F.col("cut.level").alias("level"), F.col("cut.node").alias("node")).drop("cut"))
    node = _node(F.col("term"))
    vocab = idx.term_stats.select("field", "term", F.explode(F.array(
        F.struct(byte.alias("level"), F.shiftright(node, 8).alias("node")),
        F.struct(pair.alias("level"), node.alias("node")))).alias("cut")).select(
        "field", "term", F.col("cut.level").alias("level"), F.col("cut.node").alias("node"))
    t = F.col("term")
    takes = F.when(F.col("kind") == "range", (t >= lo) & (t <= hi)).otherwise(t.startswith(lo))
    return vocab.join(_small(routed, small), ["field", "level", "node"]).where(takes)


def _constant_matches(idx: Index, clauses: DataFrame, small: bool) -> DataFrame:
    """Set, range and prefix clauses: constant score ``boost`` per matching field.

    The vocabulary (``term_stats``) is matched first, so postings are only
    joined on equality with the expanded term list.
    """
    cl = _with_fields(clauses.where(F.col("kind").isin("set", "range")
                                    | ((F.col("kind") == "prefix") & (F.size("terms") == 1))))
    cl = cl.select("query_id", "clause_no", "occur", "boost", "field", "kind", "terms")
    sets = cl.where(F.col("kind") == "set").select(
        "query_id", "clause_no", "occur", "boost", "field", F.explode("terms").alias("term"))
    patterns = cl.where(F.col("kind").isin("range", "prefix"))
    expanded = _expand(idx, patterns, small).select("query_id", "clause_no", "occur", "boost", "field", "term")
    # A range or prefix can expand to much of the vocabulary: count it.
    wanted = _with_bucket(idx, sets.unionByName(expanded))
    post, keys = postings_for(idx, ["field", "term", "doc_id"])
    m = post.join(bounded_broadcast(wanted), keys)
    return (m.groupBy("query_id", "clause_no", "occur", "field", "doc_id")
            .agg(F.first("boost").alias("score"))
            .select(*MATCH_COLS))


def _phrase_prefix_matches(idx: Index, clauses: DataFrame, small: bool) -> DataFrame:
    """``"a b"*``: the words in order with the last one a prefix; constant
    score ``boost`` per matching field. The prefix is expanded against the
    vocabulary, then matched like a phrase on positions (a position holds one
    token, so at most one expansion fits a start)."""
    cl = (_with_fields(clauses.where((F.col("kind") == "prefix") & (F.size("terms") > 1)))
          .select("query_id", "clause_no", "occur", "boost", "field", F.size("terms").alias("n"), "terms"))
    fixed = cl.select("query_id", "clause_no", "occur", "boost", "field", "n",
                      F.posexplode(F.slice("terms", 1, F.size("terms") - 1)).alias("offset", "term"))
    last = cl.select("query_id", "clause_no", "occur", "boost", "field", "n", (F.col("n") - 1).alias("offset"),
                     F.lit("prefix").alias("kind"), F.array(F.element_at("terms", -1)).alias("terms"))
    expanded = _expand(idx, last, small).select("query_id", "clause_no", "occur", "boost", "field", "n", "offset", "term")
    words = _with_bucket(idx, fixed.unionByName(expanded))
    m = positions_of(idx, bounded_broadcast(words))
    starts = (m.groupBy("query_id", "clause_no", "occur", "boost", "field", "doc_id", "n",
                        (F.col("pos") - F.col("offset")).alias("start"))
              .agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") == F.col("n")))
    return (starts.groupBy("query_id", "clause_no", "occur", "field", "doc_id")
            .agg(F.first("boost").alias("score")).select(*MATCH_COLS))


def _all_matches(idx: Index, clauses: DataFrame, small: bool) -> DataFrame:
    al = _small(clauses.where(F.col("kind") == "all").select(
        "query_id", "clause_no", "occur", "boost", F.lit(TEXT_FIELDS[0]).alias("field")), small)
    docs = idx.doc_stats.where(F.col("field") == TEXT_FIELDS[0]).select("field", "doc_id")
    return docs.join(al, "field").select("query_id", "clause_no", "occur", "doc_id",
                                         F.col("boost").alias("score"))


def _unmatched(idx: Index, touched: DataFrame, asking: DataFrame, small: bool) -> DataFrame:
    """(query_id, doc_id): for each (query_id, k) of ``asking`` the ``k`` smallest ids, in every shard, of documents not in ``touched``.

    A shard's documents are numbered in id order. Between two touched numbers
    lie untouched ones; the gaps that begin before the k-th of them give the
    numbers sought, which are then joined with the shard's ids. Documents are
    never paired with queries: each (query, shard) gives at most k rows.
    """
    shards = idx.shards or VIRTUAL_SHARDS
    in_shard = Window.partitionBy("shard").orderBy("doc_id")
    ids = (idx.doc_stats.where(F.col("field") == TEXT_FIELDS[0])
           .select("doc_id", doc_shard(F.col("doc_id"), shards).alias("shard")).withColumn("no", F.row_number().over(in_shard)))
    sizes = ids.groupBy("shard").agg(F.max("no").alias("size"))  # a row per shard
    ends = (asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(F.broadcast(sizes), "shard")
            .select("query_id", "shard", "k", (F.col("size") + 1).alias("no")))
    stops = (touched.join(ids, "doc_id").join(_small(asking, small), "query_id").select("query_id", "shard", "k", "no").unionByName(ends))
    w = Window.partitionBy("query_id", "shard").orderBy("no")
    gaps = (stops.withColumn("before", F.coalesce(F.lag("no").over(w), F.lit(0))).withColumn("seen", F.row_number().over(w) - 1)
            .withColumn("free", F.col("before") - F.col("seen"))  # untouched numbers before the gap
            .where((F.col("free") < F.col("k")) & (F.col("no") - F.col("before") > 1)))
    last = F.least(F.col("no") - 1, F.col("before") + F.col("k") - F.col("free"))
    wanted = gaps.select("query_id", "shard", F.explode(F.sequence(F.col("before") + 1, last)).alias("no"))
    return ids.join(wanted, ["shard", "no"]).select("query_id", "doc_id")


def _entity_clauses(clauses: DataFrame) -> DataFrame:
    """The entity filter is a required exact clause on the raw ``entity`` field."""
    q = clauses.where(F.col("entity").isNotNull()).select("query_id", "entity").distinct()
    return q.select("query_id", F.lit(-1).alias("clause_no"), F.lit("filter").alias("occur"),
                    F.lit("exact").alias("kind"), F.lit("entity").alias("field"),
                    F.array("entity").alias("terms"), F.lit(None).cast("int").alias("slop"),
                    F.lit(1.0).alias("boost"), "entity", F.lit(None).cast("int").alias("k"))


def normalize(clauses: DataFrame) -> DataFrame:
    """Fill optional columns of a clause table."""
    cols = set(clauses.columns)
    defaults = {"occur": F.lit("should"), "kind": F.lit("term"),
                "field": F.lit(None).cast("string"), "slop": F.lit(None).cast("int"),
                "boost": F.lit(1.0), "entity": F.lit(None).cast("string"),
                "k": F.lit(DEFAULT_K)}
    for c, v in defaults.items():
        if c not in cols:
            clauses = clauses.withColumn(c, v)
    return clauses.select(
        F.col("query_id").cast("long"), F.col("clause_no").cast("int"), "occur", "kind",
        F.col("field").cast("string"), F.col("terms").cast("array<string>"),
        F.col("slop").cast("int"), F.coalesce(F.col("boost").cast("double"), F.lit(1.0)).alias("boost"),
        F.col("entity").cast("string"), F.col("k").cast("int"))


def analyse(queries: DataFrame) -> DataFrame:
    """Clause rows of query texts: (query_id, text[, entity, k]) as a user types them.

    The text is cut at white space and each word analysed like the documents:
    a word of one term is an optional term in the default fields, a word of
    several (``error-handling``) a phrase of them, a word of none is left out.
    The words carry no grammar. An entity is a hard filter of the query; a
    query without terms, or of k = 0, has no hits. Null texts are empty.
    """
    cols = set(queries.columns)
    entity = F.col("entity").cast("string") if "entity" in cols else F.lit(None).cast("string")
    k = F.coalesce(F.col("k").cast("int"), F.lit(DEFAULT_K)) if "k" in cols else F.lit(DEFAULT_K)
    words = queries.select(F.col("query_id").cast("long").alias("query_id"), entity.alias("entity"), k.alias("k"),
                           F.posexplode(F.split(F.coalesce("text", F.lit("")), WHITE_SPACE)).alias("clause_no", "word"))
    words = words.withColumn("terms", terms(F.col("word"))).where(F.size("terms") > 0)
    return words.select("query_id", "clause_no", F.lit("should").alias("occur"),
                        F.when(F.size("terms") > 1, "phrase").otherwise("term").alias("kind"), F.lit(None).cast("string").alias("field"),
                        "terms", F.lit(None).cast("int").alias("slop"), F.lit(1.0).alias("boost"), "entity", "k")


def clause_profile(clauses: DataFrame) -> dict:
    """One small job over the clause table: rows per kind and the longest
    term list. Every small side the search derives has at most
    rows x terms x fields rows, which is what the broadcast bound is checked
    against; kinds with no rows get no subplan at all."""
    kind = F.when((F.col("kind") == "prefix") & (F.size("terms") > 1), "phrase_prefix") \
        .otherwise(F.col("kind"))
    rows = clauses.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("terms")).alias("t"),
        F.max(F.coalesce("k", F.lit(DEFAULT_K))).alias("k"),  # no k means the default
        F.count("entity").alias("e")).collect()
    if unknown := {r["kind"] for r in rows} - KINDS:
        raise ValueError(f"unknown clause kinds: {sorted(map(str, unknown))}")
    return {r["kind"]: (r["n"], max(r["t"] or 1, 1), r["k"], r["e"]) for r in rows}


def match(idx: Index, clauses: DataFrame) -> DataFrame:
    """All (query, document) pairs satisfying their query, with summed score."""
    return _match(idx, clauses)[0]


def _match(idx: Index, clauses: DataFrame, cut: bool = False):
    """(matched pairs, largest k). With ``cut``, documents that only a match-all
    clause takes are left out beyond the first k of each query and shard."""
    clauses = normalize(clauses)
    prof = clause_profile(clauses)
    cuts = 768 * sum(n for kind, (n, *_) in prof.items() if kind in ("range", "prefix", "phrase_prefix"))  # see _expand
    bound = ((sum(n * t for n, t, _, _ in prof.values()) + cuts) * len(TEXT_FIELDS)
             + sum(n for n, _, _, _ in prof.values()))
    small = bound <= BROADCAST_ROW_LIMIT
    all_clauses = clauses.unionByName(_entity_clauses(clauses))
    parts = []
    if prof.keys() & {"term", "exact"} or any(e for _, _, _, e in prof.values()):
        parts.append(_term_matches(idx, all_clauses, small))  # the entity filter is an exact clause
    if "phrase" in prof:
        parts.append(_phrase_matches(idx, all_clauses, small))
    if prof.keys() & {"set", "range", "prefix"}:
        parts.append(_constant_matches(idx, all_clauses, small))
    if "phrase_prefix" in prof:
        parts.append(_phrase_prefix_matches(idx, all_clauses, small))
    every = "all" in prof and cut  # match-all clauses count by query, not by document
    if "all" in prof and not cut:
        parts.append(_all_matches(idx, all_clauses, small))
    if not parts:  # empty clause table: no query, no hits
        parts.append(_term_matches(idx, all_clauses, small))
    matches = reduce(DataFrame.unionByName, parts)
    per_doc = matches.groupBy("query_id", "doc_id").agg(
        F.sum(F.when(F.col("occur") != "must_not", F.col("score"))).alias("score"),
        # must clauses matched; one (query, clause, doc) can have a row per
        # field, so count distinct clause numbers (list bounded by the query)
        F.size(F.array_distinct(F.collect_list(
            F.when(F.col("occur") == "must", F.col("clause_no"))))).alias("must_hit"),
        F.max((F.col("occur") == "filter").cast("int")).alias("filter_hit"),
        F.max((F.col("occur") == "should").cast("int")).alias("should_hit"),
        F.max((F.col("occur") == "must_not").cast("int")).alias("not_hit"))
    whole = (F.col("kind") == "all") if every else F.lit(False)
    info = _small(clauses.groupBy("query_id").agg(
        F.count_distinct(F.when((F.col("occur") == "must") & ~whole, F.col("clause_no"))).alias("n_must"),
        F.max(F.col("entity").isNotNull().cast("int")).alias("has_filter"),
        F.max((whole & (F.col("occur") != "must_not")).cast("int")).alias("any"),
        F.max((whole & (F.col("occur") == "must_not")).cast("int")).alias("none"),
        F.coalesce(F.sum(F.when(whole & (F.col("occur") != "must_not"), F.col("boost"))), F.lit(0.0)).alias("base"),
        F.coalesce(F.max("k"), F.lit(DEFAULT_K)).alias("k")), small)
    ok = ((F.col("must_hit") == F.col("n_must")) & (F.col("filter_hit") >= F.col("has_filter")) & (F.col("none") == 0)
          & (F.col("not_hit") == 0) & ((F.col("n_must") > 0) | (F.col("should_hit") == 1) | (F.col("any") == 1)))
    max_k = max([k for _, _, k, _ in prof.values() if k is not None] or [DEFAULT_K])
    matched = per_doc.join(info, "query_id").where(ok).select(
        "query_id", "doc_id", (F.coalesce("score", F.lit(0.0)) + F.col("base")).alias("score") if every else F.col("score"), "k")
    if every:
        asking = info.where("any = 1 AND none = 0 AND n_must = 0 AND has_filter = 0 AND k > 0").select("query_id", "k", "base")
        rest = _unmatched(idx, per_doc.select("query_id", "doc_id"), asking.select("query_id", "k"), small)
        matched = matched.unionByName(rest.join(_small(asking, small), "query_id").select("query_id", "doc_id", F.col("base").alias("score"), "k"))
    return matched, max_k


def top_k(matched: DataFrame, max_k: int | None = None) -> DataFrame:
    """Top ``k`` per query by score (rounded), ties to the smaller doc id.

    The literal bound ``max_k`` (largest k of the batch) lets Spark plan a
    partial WindowGroupLimit before the shuffle, so a query that matches a
    large part of the corpus ships at most ``max_k`` rows per task.
    """
    rounded = matched.withColumn("score", F.round("score", SCORE_DIGITS))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = rounded.withColumn("rank", F.row_number().over(w))
    if max_k is not None:
        ranked = ranked.where(F.col("rank") <= F.lit(max_k))
    return (ranked.where(F.col("rank") <= F.col("k"))
            .select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score"))


def _wanted_postings(idx: Index, words: DataFrame, patterns: list[str], places: bool, small: bool) -> DataFrame:
    """Postings of ``words`` (field, term), and all of the fields ``patterns``; ``places``: with the list of places."""
    cols = ["field", "term", "doc_id", "dl", "tf"]
    if places and "positions" not in idx.postings.columns:
        lists = idx.positions.groupBy("field", "term", "doc_id", "dl").agg(F.collect_list("pos").alias("positions"))
        idx = replace(idx, postings=idx.postings.join(lists, ["field", "term", "doc_id", "dl"]), buckets=None)
    post, keys = postings_for(idx, cols + ["positions"] if places else cols)
    wanted = _small(_with_bucket(idx, words), small)
    if not patterns:
        found = post.join(wanted, keys, "left_semi")
    else:
        by_word = post.where(~F.col("field").isin(patterns)).join(wanted, keys, "left_semi")
        found = post.where(F.col("field").isin(patterns)).select(*by_word.columns).unionByName(by_word)
    return found.select(*cols, *(["positions"] if places else []))


def _counted_postings(idx: Index, words: DataFrame, patterns: list[str], own: list[dict], places: bool, small: bool) -> DataFrame:
    """``_wanted_postings`` of an index built in the plan, stored: the documents are read and analysed once.

    ``own`` are the clauses of the batch. Of a phrase whose last word is a prefix only places are taken where two of
    its words are neighbours. There is a row without a term for each text field of each document, which has its length.
    """
    wanted, pairs = {f: set() for f in TEXT_FIELDS}, {}
    for c in own:
        f, terms = c["field"], c["terms"]
        if f not in wanted:
            continue
        if c["kind"] == "range" or c["kind"] == "prefix" and len(terms) == 1:
            wanted[f] = None
        elif c["kind"] == "prefix":
            last = len(terms) - 2
            pairs.setdefault(f, set()).update((u, v, i == last) for i, (u, v) in enumerate(zip(terms, terms[1:], strict=False)))
        elif wanted[f] is not None:
            wanted[f].update(t.decode() for t in terms)
    rows = text_postings(idx.docs.repartition("id").withColumnRenamed("id", "doc_id"), words=wanted, positions=places, pairs=pairs)
    raw = _wanted_postings(replace(idx, postings=raw_postings(idx.docs), buckets=None), words.where(F.col("field").isin(list(RAW_FIELDS))),
                           [f for f in patterns if f in RAW_FIELDS], places, small)
    return _staged(rows.select(*raw.columns).unionByName(raw))


def _alike(clauses: DataFrame) -> DataFrame:
    """(query_id, clauses, members): queries with the same clauses are answered once, under the smallest id of them."""
    rest = [c for c in clauses.columns if c != "query_id"]
    return (clauses.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("clauses"))
            .groupBy("clauses").agg(F.min("query_id").alias("query_id"), F.collect_list("query_id").alias("members")))


def _query(row) -> dict | None:
    """A query for ``fold``; None where it has no hits."""
    own = [c.asDict() for c in row["clauses"]]
    k = max((c["k"] for c in own if c["k"] is not None), default=DEFAULT_K)
    every = [c for c in own if c["kind"] == "all"]
    if k <= 0 or any(c["occur"] == "must_not" for c in every):
        return None
    out = []
    for e in dict.fromkeys(c["entity"] for c in own if c["entity"] is not None):  # see ``_entity_clauses``
        out.append(dict(clause_no=-1, occur="filter", kind="exact", field="entity", terms=(e.encode(),), slop=0, boost=1.0))
    for c in own:
        terms = tuple(t.encode() for t in c["terms"] or () if t is not None)
        if c["kind"] != "all" and len(terms) == len(c["terms"] or ()):
            for f in [c["field"]] if c["field"] is not None else TEXT_FIELDS:
                out.append(dict(clause_no=c["clause_no"], occur=c["occur"], kind=c["kind"], field=f, terms=terms, slop=c["slop"] or 0, boost=c["boost"]))
    return dict(query_id=row["query_id"], k=k, clauses=out, any=bool(every), base=sum(c["boost"] for c in every))


def _batch_hits(idx: Index, clauses: DataFrame, alike: DataFrame, small: bool) -> DataFrame:
    """(query_id, doc_id, score, k): the best hits of the queries ``alike`` (stored) in every block of documents."""
    all_clauses = clauses.unionByName(_entity_clauses(clauses))
    words = (_with_fields(all_clauses.where(F.col("kind").isin("term", "exact", "set", "phrase", "prefix")))
             .select("field", F.explode("terms").alias("term")).distinct())
    queries = [q for q in map(_query, alike.select("query_id", "clauses").collect()) if q]
    own = [c for q in queries for c in q["clauses"]]
    fields = sorted({c["field"] for c in own if c["kind"] in ("range", "prefix")})
    places = any(c["kind"] == "phrase" or c["kind"] == "prefix" and len(c["terms"]) > 1 for c in own)
    if idx.docs is not None:
        counted = _counted_postings(idx, words, fields, own, places, small)
        rows, lengths = counted.where(F.col("term").isNotNull()), counted.where(F.col("term").isNull())
        idx = replace(idx, doc_stats=lengths.select("field", "doc_id", "dl"), corpus=corpus_of(lengths), term_stats=term_stats_of(rows))
    else:
        rows = _wanted_postings(idx, words, fields, places, small)
    corpus = {r["field"]: (r["n_docs"], r["avgdl"]) for r in _corpus_all_fields(idx).collect()}  # a row per field
    stats = idx.term_stats.join(_small(words, small), ["field", "term"], "left_semi").select("field", "term", "df").collect()  # of the batch's words
    df = {(r["field"], r["term"].encode()): r["df"] for r in stats}
    batch = Batch(queries, {}, {f: a for f, (_, a) in corpus.items()}, K1, B, SCORE_DIGITS)
    every = any(q["any"] for q in queries)
    for q in queries:
        q["clauses"] = [c for c in q["clauses"] if c["field"] in corpus or c["kind"] in ("set", "range", "prefix") or c["occur"] == "must"]
        for c in q["clauses"]:
            n = corpus.get(c["field"], (0, 1.0))[0]
            batch.idf.update({(c["field"], t): math.log(1.0 + (n - d + 0.5) / (d + 0.5)) for t in c["terms"] for d in [df.get((c["field"], t), 0)]})
            if c["kind"] == "phrase" or c["kind"] == "prefix" and len(c["terms"]) > 1:
                by_prefix = c["kind"] == "prefix"
                batch.phrases[c["field"]].add((c["terms"], 0 if by_prefix else c["slop"], by_prefix))
    batch.phrases = dict(batch.phrases)
    if every:  # every document may be a hit
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "doc_id"]
        rows = rows.unionByName(idx.doc_stats.where(F.col("field") == TEXT_FIELDS[0]).select("doc_id", *none))
    n_docs = max([n for n, _ in corpus.values()], default=0)
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_docs // BLOCK))
    return rows.repartition(blocks, "doc_id").mapInArrow(best_of_blocks(batch), "query_id long, doc_id string, score double, k int")


def search(idx: Index, clauses: DataFrame) -> DataFrame:
    """Ranked hits: query_id, rank, doc_id, score.

    The postings that the batch needs are brought together by document, in
    blocks of some thousand; each block gives the best k of every query
    (``vellum.operators.fold``), and these are ranked. Pairs of query and
    document are never rows. Batches of more than ``QUERY_ROWS`` clauses are
    answered in parts.
    """
    clauses = normalize(clauses)
    prof = clause_profile(clauses)
    n = sum(n for n, *_ in prof.values())
    small = (sum(n * t for n, t, _, _ in prof.values()) + n) * len(TEXT_FIELDS) <= BROADCAST_ROW_LIMIT
    max_k = max([k for _, _, k, _ in prof.values() if k is not None] or [DEFAULT_K])
    alike = _staged(_alike(clauses))
    parts = max(1, -(-n // QUERY_ROWS))
    hits = []
    for part in range(parts):
        some = alike.where(F.pmod(F.hash("query_id"), F.lit(parts)) == part) if parts > 1 else alike
        own = clauses.join(some.select("query_id"), "query_id", "left_semi") if parts > 1 else clauses
        hits.append(_batch_hits(idx, own, some, small))
    ranked = top_k(reduce(DataFrame.unionByName, hits), max_k)
    members = _small(alike.select("query_id", F.explode("members").alias("member")), small)
    return ranked.join(members, "query_id").select(F.col("member").alias("query_id"), "rank", "doc_id", "score")


def single_top_k(matched: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """O3: one query, global top-k (plans TakeOrderedAndProject)."""
    return (matched.withColumn("score", F.round("score", SCORE_DIGITS))
            .orderBy(F.col("score").desc(), F.col("doc_id")).limit(k)
            .select("doc_id", "score"))
