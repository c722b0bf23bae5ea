"""Inverted index as tables (X1, A7, A8) and its maintenance.

``postings``   field, term, doc_id, dl, tf, positions  (one row per field, term, doc)
``positions``  field, term, doc_id, dl, pos       (one row per token; phrases only)
``doc_stats``  field, doc_id, dl
``term_stats`` field, term, df
``corpus``     field, n_docs, avgdl            (one row per field)

Text fields (title, content, tags) are analysed; raw fields (id, entity,
topic, name) are indexed as one untokenised term each (tf = dl = 1), which is
what the exact-match clauses and the entity filter look up.

``dl`` is carried on every posting, so scoring needs no join with
``doc_stats``; ``term_stats`` is read only for the (few) query terms.

Postings are counted where a document is read: documents are shuffled by id
once (so that copies of an id meet), and a small Arrow helper groups the tokens
of each; no token or posting row is shuffled or sorted by Spark.

A stored index is laid out by document shards: ``postings`` (with the list of
positions) is a table bucketed by document and partitioned by document shard
and term bucket. All postings of a document lie in one shard, so scores are
folded without an exchange, a search reads the term buckets of its terms, and
maintenance rewrites the shards of the documents it touches. ``term_stats``
also has the largest ``impact`` of each term, tf / (tf + norm), which bounds
its score (``vellum.operators.ranking``). Impacts are taken at the average
lengths of the first build (``corpus.ref``), so that they stay comparable.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import explode_terms, field_length, kept_count, kept_places, pieces, raw_tokens, tags_text
from vellum.schema import RAW_FIELDS, TEXT_FIELDS
from vellum.session import bounded_broadcast, ensure_checkpoint_dir

DEFAULT_BUCKETS = 64
FILE_BUFFER = 32 << 20  # bytes a task holds at most for a file it writes
# BM25 parameters.
K1 = 1.2
B = 0.75


@dataclass
class Index:
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus: DataFrame
    buckets: int | None = None   # term buckets of a persisted layout
    positions: DataFrame | None = None
    path: str | None = None      # where a stored index lies
    shards: int | None = None    # its document shards
    ref: DataFrame | None = None  # (field, ref): the lengths that a stored index takes impacts at
    docs: DataFrame | None = None  # the documents of an index that is built in the plan


def term_bucket(term: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def field_texts(docs: DataFrame, with_tokens: bool = False) -> DataFrame:
    """(doc_id, field, text, dl): one row per document and text field
    (``with_tokens``: also the raw token array, split once and reused)."""
    fields = F.array(
        F.struct(F.lit("title").alias("field"), F.col("title").alias("text")),
        F.struct(F.lit("content").alias("field"), F.col("content").alias("text")),
        F.struct(F.lit("tags").alias("field"), tags_text(F.col("tags")).alias("text")),
    )
    rows = docs.select(F.col("id").alias("doc_id"), F.explode(fields).alias("f")).select(
        "doc_id", "f.field", "f.text")
    if with_tokens:
        rows = rows.withColumn("toks", raw_tokens(F.col("text")))
        return rows.withColumn("dl", kept_count(F.col("toks")))
    return rows.withColumn("dl", field_length(F.col("text")))


def text_tokens(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Token rows of the analysed fields: field, term, doc_id, dl, pos [, tb]."""
    tokens = explode_terms(field_texts(docs, with_tokens=True), "text", ["doc_id", "field", "dl"],
                           tokens_col="toks")
    tokens = tokens.select("field", "term", "doc_id", "dl", "pos")
    if buckets:
        tokens = tokens.withColumn("tb", term_bucket(F.col("term"), buckets))
    return tokens


POSTINGS = "field string, term string, doc_id string, dl int, tf int, positions array<int>"


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, nulls being one value, and the values numbered."""
    coded = values.dictionary_encode("encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _pair_codes(pairs: set) -> list[tuple]:
    """``pairs`` (word, next word or what it begins with, whether a prefix) as (bytes of the prefix, words, next ones, numbers of the pairs)."""
    out = []
    for size in {len(v) if by_prefix else None for _, v, by_prefix in pairs}:
        some = [(u, v) for u, v, by_prefix in pairs if (len(v) if by_prefix else None) == size]
        first, then = ({w: i for i, w in enumerate(sorted({pair[at] for pair in some}))} for at in (0, 1))
        codes = np.unique(np.array([first[u] * len(then) + then[v] for u, v in some], np.int64))
        out.append((size, pa.array(first, pa.binary()), pa.array(then, pa.binary()), codes))
    return out


def _in_pairs(of: np.ndarray, pos: np.ndarray, term: np.ndarray, terms: pa.Array, pairs: list[tuple]) -> np.ndarray:
    """Marks the places that stand beside another one of their list as a pair (``_pair_codes``) does."""
    marked, known = np.zeros(len(of), bool), terms.cast(pa.binary())
    at = np.flatnonzero((of[1:] == of[:-1]) & (pos[1:] == pos[:-1] + 1))
    for size, first, then, codes in pairs:
        begins = known if size is None else pc.binary_slice(known, 0, size)
        u, v = (pc.fill_null(pc.index_in(x, y), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x, y in ((known, first), (begins, then)))
        a, b = u[term[at]], v[term[at + 1]]
        found = at[(a >= 0) & (b >= 0) & np.isin(a * len(then) + b, codes)]
        marked[found] = marked[found + 1] = True
    return marked


def _counted(rows: pa.Table, words: dict | None = None, positions: bool = True, pairs: dict | None = None) -> pa.RecordBatch:
    """The postings of token lists (``_token_lists``); lists of one id, field and length are taken together.

    ``words`` (field: terms, or None for all of them) names the postings that are wanted; with it each list
    also gives a row without a term, which has its length. ``pairs`` (field: ``_pair_codes``) names places
    wanted besides, those of two neighbours; copies of an id have all places of such a field, as a phrase
    counts places in all of them.
    """
    rows = rows.combine_chunks()
    ids, fields = rows["doc_id"].combine_chunks(), rows["field"].combine_chunks()
    of, pos, flat = kept_places(rows["tokens"].combine_chunks(), rows["analysed"].to_numpy())
    dl = np.bincount(of, minlength=len(rows))
    (doc, _), (at, names) = _codes(ids), _codes(fields)
    unit = (doc * (at.max(initial=0) + 1) + at) * (dl.max(initial=0) + 1) + dl
    _, first, unit = np.unique(unit, return_index=True, return_inverse=True)
    term, terms = _codes(flat)
    if words is not None:
        wanted = np.zeros((len(names), len(terms)), bool)
        for no, f in enumerate(names.to_pylist()):
            some = words.get(f, terms[:0])
            wanted[no] = True if some is None else pc.is_in(terms, some).to_numpy(zero_copy_only=False)
        some = wanted[at[of], term]
        copied = (np.bincount(unit) > 1)[unit]
        for no, f in enumerate(names.to_pylist()):
            if f in (pairs or {}):
                own = np.flatnonzero(at[of] == no)
                some[own] |= copied[of[own]] | _in_pairs(of[own], pos[own], term[own], terms, pairs[f])
        of, pos, term = of[some], pos[some], term[some]
    key = unit[of] * max(len(terms), 1) + term
    order = np.argsort(key, kind="stable") if len(first) == len(dl) else np.lexsort((pos, key))
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[starts, len(key)])
    to = first[key[starts] // max(len(terms), 1)]
    ends, places, word = np.r_[starts, len(key)], pos[order], term[order[starts]]
    known = np.ones(len(starts), bool)
    if not positions:
        ends, places = np.zeros(len(starts) + 1, np.int64), places[:0]
    if words is not None:
        n = len(rows)
        to, tf, word, known = np.r_[to, np.arange(n)], np.r_[tf, np.zeros(n, np.int64)], np.r_[word, np.zeros(n, np.int64)], np.r_[known, np.zeros(n, bool)]
        ends = np.r_[ends, np.full(n, ends[-1])]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [fields.take(pa.array(to)), terms.take(pa.array(word, mask=~known)), ids.take(pa.array(to)),
         pa.array(dl[to].astype(np.int32)), pa.array(tf.astype(np.int32)), lists], ["field", "term", "doc_id", "dl", "tf", "positions"])


def _count_tokens(words: dict | None = None, positions: bool = True, pairs: dict | None = None):
    """The function for ``mapInArrow``: token lists in id order in, postings out; the last id of a batch waits for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        sought = None if words is None else {f: None if w is None else pa.array(sorted(w), pa.string()) for f, w in words.items()}
        beside = {f: _pair_codes(some) for f, some in (pairs or {}).items()}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not len(rows):
                continue
            ids, _ = _codes(rows["doc_id"].combine_chunks())
            other = np.flatnonzero(ids != ids[-1])
            whole = other[-1] + 1 if len(other) else 0
            held = rows.slice(whole)
            if whole:
                yield _counted(rows.slice(0, whole), sought, positions, beside)
        if held is not None and len(held):
            yield _counted(held, sought, positions, beside)

    return run


def _token_lists(docs: DataFrame, raw: bool) -> DataFrame:
    """(doc_id, field, tokens, analysed) of the analysed fields, with ``raw`` of the raw fields as well; ``docs`` has (doc_id, ...)."""
    texts = {"title": F.col("title"), "content": F.col("content"), "tags": tags_text(F.col("tags"))}

    def one(field, tokens, analysed):
        return F.struct(F.lit(field).alias("field"), tokens.alias("tokens"), F.lit(analysed).alias("analysed"))

    fields = [one(f, pieces(t), True) for f, t in texts.items()]
    if raw:
        values = {f: F.coalesce(F.col("doc_id" if f == "id" else f), F.lit("")) for f in RAW_FIELDS}
        fields += [one(f, F.array(t), False) for f, t in values.items()]
    return docs.select("doc_id", F.explode(F.array(*fields)).alias("f")).select("doc_id", "f.field", "f.tokens", "f.analysed")


def text_postings(docs: DataFrame, raw: bool = False, words: dict | None = None, positions: bool = True, pairs: dict | None = None) -> DataFrame:
    """Postings of the analysed fields with their places, one per (field, term, doc_id, dl); with ``raw`` those of the raw fields.

    ``docs`` (doc_id, ...) must hold all rows of an id in one partition. For ``words`` and
    ``pairs`` (field: what ``_pair_codes`` takes) see ``_counted``; without ``positions`` the lists of places are empty.
    """
    return _token_lists(docs.sortWithinPartitions("doc_id"), raw).mapInArrow(_count_tokens(words, positions, pairs), POSTINGS)


def raw_postings(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One posting per document and raw field (the value is the term)."""
    raw = F.array(*[F.struct(F.lit(f).alias("field"),
                             F.coalesce(F.col(f), F.lit("")).alias("term")) for f in RAW_FIELDS])
    out = (docs.select(F.col("id").alias("doc_id"), F.explode(raw).alias("r"))
           .select("r.field", "r.term", "doc_id", F.lit(1).alias("dl"), F.lit(1).alias("tf"), F.array(F.lit(0)).alias("positions")))
    if buckets:
        out = out.withColumn("tb", term_bucket(F.col("term"), buckets))
    return out


def build_index(docs: DataFrame, buckets: int | None = None) -> Index:
    """Index every document of ``docs`` (id, entity, topic, name, title, content, tags)."""
    postings = text_postings(docs.repartition("id").withColumnRenamed("id", "doc_id"))
    if buckets:
        postings = postings.withColumn("tb", term_bucket(F.col("term"), buckets))
    postings = postings.unionByName(raw_postings(docs, buckets))
    tokens = text_tokens(docs, buckets)
    doc_stats = field_texts(docs).select("field", "doc_id", "dl")
    return Index(postings, doc_stats, term_stats_of(postings), corpus_of(doc_stats),
                 buckets=buckets, positions=tokens, docs=docs)


def term_stats_of(postings: DataFrame) -> DataFrame:
    """Document frequency per (field, term): postings hold one row per doc."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_of(doc_stats: DataFrame) -> DataFrame:
    """N and average field length per text field (A8): at most one row per field."""
    return doc_stats.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


# ---------------------------------------------------------------- persistence

def doc_shard(doc_id: F.Column, shards: int) -> F.Column:
    """The shard of a document: the bucket that Spark's hash partitioning gives its id."""
    return F.pmod(F.hash(doc_id), F.lit(shards)).cast("int")


def sharded_rows(docs: DataFrame, buckets: int, shards: int) -> DataFrame:
    """Postings with positions, computed where the documents of a shard are: the documents are shuffled once, nothing after."""
    rows = text_postings(docs.repartition(shards, "id").withColumnRenamed("id", "doc_id"), raw=True)
    return rows.select("*", doc_shard(F.col("doc_id"), shards).alias("shard"), term_bucket(F.col("term"), buckets).alias("tb"))


@contextmanager
def unsorted_writes(spark: SparkSession, files: int):
    """Within it a task keeps up to ``files`` files open and rows go to theirs as they come; else they are sorted by folder first."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(files))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def bucketed_scans(spark: SparkSession):
    """Within it a task of a scan reads a whole bucket of a bucketed table, also where no join or aggregation asks for it."""
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _lengths(postings: DataFrame) -> DataFrame:
    """(doc_id, field, dl, shard) for every document and text field; 0 where a field has no token."""
    per = postings.groupBy("doc_id", "shard").agg(*[
        F.coalesce(F.max(F.when(F.col("field") == f, F.col("dl"))), F.lit(0)).alias(f) for f in TEXT_FIELDS])
    return per.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("dl")) for f in TEXT_FIELDS])).alias("f"),
                      "shard").select("doc_id", "f.field", "f.dl", "shard")


def _bounds(postings: DataFrame, ref: DataFrame) -> DataFrame:
    """(field, term, df, impact, tb); ``ref`` (field, ref) has the lengths that impacts are taken at."""
    at = F.lit(1.0)
    for r in ref.where(F.col("ref").isNotNull()).collect():  # a row per text field
        at = F.when(F.col("field") == r["field"], F.lit(r["ref"])).otherwise(at)
    impact = F.col("tf") / (F.col("tf") + length_norm(F.col("dl"), at))
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.max(impact).alias("impact"), F.max("tb").alias("tb"))


def length_norm(dl: F.Column, avgdl: F.Column) -> F.Column:
    """The part of BM25 that depends on the field's length."""
    return F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * dl / avgdl)


def table_name(path: str, name: str) -> str:
    return f"vellum_{name}_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def _staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_index(docs: DataFrame, path: str, buckets: int = DEFAULT_BUCKETS, shards: int | None = None) -> None:
    """Build and write the index (U2: replace all), laid out by document shards.

    ``shards`` (as many as shuffle partitions unless given) is the parallelism
    of searches; at scale choose it so that a shard is some GB, and ``buckets``
    so that a (shard, term bucket) folder holds a file of 100 MB or more. The
    sharding is by hash of the id, so a shard has its share of every hot term,
    entity or topic.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = table_name(path, "postings")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    with unsorted_writes(spark, 2 * buckets):
        (sharded_rows(docs, buckets, shards).write.format("parquet").mode("overwrite").option("path", f"{path}/postings")
         .option("parquet.block.size", FILE_BUFFER).partitionBy("shard", "tb").bucketBy(shards, "doc_id").saveAsTable(name))
    postings = spark.table(name)
    _lengths(postings).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/doc_stats")
    totals = _totals(spark.read.parquet(f"{path}/doc_stats"))
    totals.withColumn("ref", F.greatest(F.col("tokens") / F.col("n_docs"), F.lit(1e-9))).write.mode("overwrite").parquet(f"{path}/corpus")
    # the counts of a term come from every shard, summed there first
    _bounds(postings, spark.read.parquet(f"{path}/corpus")).repartition("tb").write.mode("overwrite").partitionBy("tb").parquet(f"{path}/term_stats")
    spark.createDataFrame([(buckets, shards)], "buckets int, shards int").write.mode("overwrite").json(f"{path}/_layout")


def _totals(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("dl").cast("long")).alias("tokens"))


def read_index(spark: SparkSession, path: str) -> Index:
    """The stored index; its postings table is registered with this session if another wrote it."""
    lay = spark.read.json(f"{path}/_layout").first()
    name = table_name(path, "postings")
    if not spark.catalog.tableExists(name):
        spark.sql(f"""CREATE TABLE {name} (field STRING, term STRING, doc_id STRING, dl INT, tf INT, positions ARRAY<INT>, shard INT, tb INT)
            USING parquet PARTITIONED BY (shard, tb) CLUSTERED BY (doc_id) INTO {lay['shards']} BUCKETS
            LOCATION '{path}/postings'""")
        spark.sql(f"MSCK REPAIR TABLE {name}")
    there = F.col("field").isNotNull()  # rows without a field only keep a folder (see ``_replace``)
    corpus = spark.read.parquet(f"{path}/corpus").where("n_docs > 0").select(
        "field", "n_docs", (F.col("tokens") / F.col("n_docs")).alias("avgdl"), "ref")
    return Index(spark.table(name).where(there),
                 spark.read.parquet(f"{path}/doc_stats").where(there).select("field", "doc_id", "dl"),
                 spark.read.parquet(f"{path}/term_stats").where(there),
                 corpus.drop("ref"), buckets=lay["buckets"], path=path, shards=lay["shards"], ref=corpus.select("field", "ref"))


def _replace(spark: SparkSession, path: str, gone: DataFrame, new_docs: DataFrame | None) -> Index:
    """The stored index without the documents ``gone`` (doc_id) and with ``new_docs``.

    Only the shards of these documents are rewritten, by dynamic partition
    overwrite; df, document counts and lengths change by what was taken out
    and put in. Everything is computed before the first folder is replaced:
    the small tables are staged, and the postings kept are written once, from
    the table beside itself. A folder that loses all its rows is replaced by one that holds
    a row without field and term, which no search meets. An impact stays where
    a document goes: it remains a bound. After a failure between two tables
    ``write_index`` sets all right.
    """
    idx = read_index(spark, path)
    buckets, shards = idx.buckets, idx.shards
    name = table_name(path, "postings")
    new = _staged(sharded_rows(new_docs, buckets, shards)) if new_docs is not None else None
    ids = gone.select("doc_id") if new is None else gone.select("doc_id").unionByName(new.select("doc_id"))
    ids = _staged(ids.where(F.col("doc_id").isNotNull()).distinct().withColumn("shard", doc_shard(F.col("doc_id"), shards)))
    touched = [r["shard"] for r in ids.select("shard").distinct().collect()]  # at most ``shards`` numbers
    if not touched:
        return idx
    small = bounded_broadcast(ids.select("doc_id"))
    there = F.col("field").isNotNull()
    old = spark.table(name).where(there & F.col("shard").isin(touched))
    ref = spark.read.parquet(f"{path}/corpus").select("field", "ref")
    out = _staged(_bounds(old.join(small, "doc_id", "left_semi"), ref))
    rows = old.join(small, "doc_id", "left_anti").select("field", "term", "doc_id", "dl", "tf", "positions", "shard", "tb")
    rows = rows if new is None else rows.unionByName(new.select(*rows.columns))
    folders = (spark.createDataFrame([(s,) for s in touched], "shard int").withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
               .join(F.broadcast(rows.select("shard", "tb").distinct()), ["shard", "tb"], "left_anti"))  # a row per folder
    rows = rows.unionByName(folders.coalesce(1).select(
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("field", "term", "doc_id", "dl", "tf", "positions")], "shard", "tb"))

    changes = out.select("field", "term", (-F.col("df")).alias("df"), "impact", "tb")
    if new is not None:
        changes = changes.unionByName(_bounds(new, ref))
    terms = spark.read.parquet(f"{path}/term_stats").where(there).select("field", "term", "df", "impact", "tb")
    bounds = (terms.unionByName(changes).groupBy("field", "term", "tb")
              .agg(F.sum("df").alias("df"), F.max("impact").alias("impact")).where("df > 0")
              .select("field", "term", "df", "impact", "tb"))
    none = [F.lit(None).cast(bounds.schema[c].dataType).alias(c) for c in ("field", "term", "df", "impact")]
    bounds = _staged(bounds.unionByName(spark.range(buckets).select(*none, F.col("id").cast("int").alias("tb"))))

    lengths = spark.read.parquet(f"{path}/doc_stats").where(there & F.col("shard").isin(touched)).select("doc_id", "field", "dl", "shard")
    lost = _totals(lengths.join(small, "doc_id", "left_semi")).select("field", (-F.col("n_docs")).alias("n_docs"), (-F.col("tokens")).alias("tokens"))
    kept = lengths.join(small, "doc_id", "left_anti")
    corpus = spark.read.parquet(f"{path}/corpus").select("field", "n_docs", "tokens", "ref").unionByName(lost, allowMissingColumns=True)
    if new is not None:
        fresh = _staged(_lengths(new))
        kept, corpus = kept.unionByName(fresh), corpus.unionByName(_totals(fresh), allowMissingColumns=True)
    kept = _staged(kept.unionByName(spark.createDataFrame([(None, None, None, s) for s in touched], kept.schema)))
    corpus = _staged(corpus.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"), F.max("ref").alias("ref")))

    dynamic = {"partitionOverwriteMode": "dynamic"}
    mode, before = "spark.sql.sources.partitionOverwriteMode", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set(mode, "dynamic")  # inserts into a table take it from the session alone
    try:
        # a task a shard, none are shuffled; Spark writes beside the table that it reads and replaces folders after the last task
        with bucketed_scans(spark), unsorted_writes(spark, 32 * buckets):
            rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)
    bounds.repartition("tb").write.options(**dynamic).mode("overwrite").partitionBy("tb").parquet(f"{path}/term_stats")
    kept.write.options(**dynamic).mode("overwrite").partitionBy("shard").parquet(f"{path}/doc_stats")
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    spark.catalog.refreshTable(name)
    return read_index(spark, path)


def upsert_stored(spark: SparkSession, path: str, docs: DataFrame) -> Index:
    """M7/U1 on a stored index: documents of known ids are replaced, others added."""
    return _replace(spark, path, docs.select(F.col("id").alias("doc_id")), docs)


def remove_stored(spark: SparkSession, path: str, ids: DataFrame) -> Index:
    """M8 on a stored index: documents by ``id``; unknown ids change nothing."""
    return _replace(spark, path, ids.select(F.col("id").alias("doc_id")), None)


def positions_of(idx: Index, words: DataFrame) -> DataFrame:
    """Rows of ``words`` (with the keys of ``postings_for``) at every place ``pos`` where their term stands."""
    if idx.positions is not None:
        pos, keys = postings_for(idx, ["field", "term", "doc_id", "dl", "pos"], table="positions")
        return pos.join(words, keys)
    post, keys = postings_for(idx, ["field", "term", "doc_id", "dl", "positions"])
    return post.join(words, keys).withColumn("pos", F.explode("positions")).drop("positions")


def postings_for(idx: Index, cols: list[str], table: str = "postings") -> tuple[DataFrame, list[str]]:
    """Columns ``cols`` of postings (or positions) and the join keys for
    query-term rows. On a persisted layout the term bucket is a
    join key too, so dynamic partition pruning reads only the buckets of the
    query terms."""
    df = idx.postings if table == "postings" else idx.positions
    if idx.buckets and "tb" in df.columns:
        return df.select(*cols, "tb"), ["field", "tb", "term"]
    return df.select(*cols), ["field", "term"]


# ---------------------------------------------------------------- maintenance

def upsert(idx: Index, changed_docs: DataFrame) -> Index:
    """Drop every posting of the changed ids, add their new postings."""
    new = build_index(changed_docs, idx.buckets)
    ids = changed_docs.select(F.col("id").alias("doc_id"))

    def swap(old: DataFrame, fresh: DataFrame) -> DataFrame:
        return old.join(ids, "doc_id", "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))

    postings = swap(idx.postings, new.postings)
    doc_stats = swap(idx.doc_stats, new.doc_stats)
    positions = swap(idx.positions, new.positions) if idx.positions is not None else None
    return Index(postings, doc_stats, term_stats_of(postings), corpus_of(doc_stats),
                 buckets=idx.buckets, positions=positions)


def remove(idx: Index, ids: DataFrame) -> Index:
    """M8: remove documents (``ids`` has column ``id``) from the index."""
    ids = ids.select(F.col("id").alias("doc_id"))

    def drop(old: DataFrame) -> DataFrame:
        return old.join(ids, "doc_id", "left_anti").select(*old.columns)

    postings = drop(idx.postings)
    doc_stats = drop(idx.doc_stats)
    positions = drop(idx.positions) if idx.positions is not None else None
    return Index(postings, doc_stats, term_stats_of(postings), corpus_of(doc_stats),
                 buckets=idx.buckets, positions=positions)
