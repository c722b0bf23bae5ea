"""Hits with stored fields and snippets (P8, X13, S7, F12); ``whole_hits`` has all of a hit in one row.

Late materialisation: the document table is joined only to the top-k rows,
and the snippet helper runs on those rows only, batched through Arrow. From a
document store (``write_documents``: bucketed and sorted by id) only the
buckets of the hits are read, and of their files the row groups with hits.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.snippet import best_fragment
from vellum.operators.index import Index, table_name
from vellum.operators.search import clause_profile, normalize
from vellum.session import BROADCAST_ROW_LIMIT, bounded_broadcast, ensure_checkpoint_dir


@F.pandas_udf(T.StringType())
def _snippet_udf(content: pd.Series, terms: pd.Series, weights: pd.Series) -> pd.Series:
    out = []
    for text, ts, ws in zip(content, terms, weights):
        w = {} if ts is None else dict(zip(ts, ws))
        out.append(best_fragment(text, w))
    return pd.Series(out, dtype=object)


def snippet_terms(idx: Index, clauses: DataFrame) -> DataFrame:
    """(query_id, terms, weights): the positive term and phrase words of each
    query that can match content, weighted by 1 / (1 + df in content)."""
    c = normalize(clauses)
    words = (c.where(F.col("kind").isin("term", "phrase") & F.col("occur").isin("should", "must")
                     & (F.col("field").isNull() | (F.col("field") == "content")))
             .select("query_id", F.explode("terms").alias("term")).distinct())
    df = idx.term_stats.where(F.col("field") == "content").select("term", "df")
    w = words.join(df, "term", "left").select(
        "query_id", "term", (F.lit(1.0) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))).alias("w"))
    return w.groupBy("query_id").agg(
        F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"))


# Documents up to which hits are looked up by their ids.
LOOKUP_IDS = 20_000


def write_documents(docs: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store documents bucketed and sorted by id, for lookups by hits.

    ``buckets`` (as many as shuffle partitions unless given): choose it so
    that a bucket is one file of some 100 MB.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = table_name(path, "documents")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (docs.repartition(buckets, "id").write.format("parquet").mode("overwrite").option("path", f"{path}/documents")
     .bucketBy(buckets, "id").sortBy("id").saveAsTable(name))
    spark.createDataFrame([(buckets, docs.schema.json())], "buckets int, fields string").write.mode("overwrite").json(f"{path}/_documents")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The document store; it is registered with this session if another wrote it."""
    name = table_name(path, "documents")
    if not spark.catalog.tableExists(name):
        lay = spark.read.json(f"{path}/_documents").first()
        fields = T.StructType.fromJson(json.loads(lay["fields"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {lay['buckets']} BUCKETS "
                  f"LOCATION '{path}/documents'")
    return spark.table(name)


def _found(ranked: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Ranked rows with ``columns`` of their documents.

    The ids of up to ``LOOKUP_IDS`` documents become a filter, so a store is
    read by bucket and row group; above that the documents are streamed past
    the ranked rows.
    """
    ensure_checkpoint_dir(ranked.sparkSession)
    rows = ranked.checkpoint()
    ids = [r[0] for r in rows.select("doc_id").distinct().limit(LOOKUP_IDS + 1).collect()]
    if len(ids) <= LOOKUP_IDS:
        docs = docs.where(F.col("id").isin(ids))
    return docs.select(F.col("id").alias("doc_id"), *columns).join(bounded_broadcast(rows), "doc_id")


def hits(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked rows with the stored fields of their documents."""
    d = _found(ranked, docs, ["entity", "topic", "name", "title", "tags"])
    return d.select(*ranked.columns, "entity", "topic", "name",
                                                         "title", "tags")


def with_snippets(ranked: DataFrame, docs: DataFrame, idx: Index, clauses: DataFrame) -> DataFrame:
    """Adds ``snippets`` (array of at most one highlighted fragment)."""
    # one row per query; its size is bounded by the clause table, which the
    # cheap clause profile measures (no need to count the joined frame)
    prof = clause_profile(normalize(clauses))
    bound = sum(n * t for n, t, _, _ in prof.values())
    terms = snippet_terms(idx, clauses)
    terms = F.broadcast(terms) if bound <= BROADCAST_ROW_LIMIT else terms
    s = (_found(ranked, docs, ["content"]).join(terms, "query_id", "left")
         .withColumn("snippet", _snippet_udf("content", "terms", "weights")))
    return s.select(*ranked.columns, "snippet").withColumn(
        "snippets", F.when(F.col("snippet").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array("snippet"))).drop("snippet")


def whole_hits(ranked: DataFrame, docs: DataFrame, idx: Index, clauses: DataFrame) -> DataFrame:
    """(query_id, rank, id, entity, topic, name, title, tags, snippets, score): the whole hit, from one pass over the documents.

    ``topic`` is null where a document has none, ``tags`` and ``snippets`` are
    arrays (no match in content: no snippet), ``score`` is a number.
    """
    prof = clause_profile(normalize(clauses))
    words = snippet_terms(idx, clauses)
    words = F.broadcast(words) if sum(n * t for n, t, _, _ in prof.values()) <= BROADCAST_ROW_LIMIT else words
    rows = (_found(ranked, docs, ["entity", "topic", "name", "title", "tags", "content"]).join(words, "query_id", "left")
            .withColumn("snippet", _snippet_udf("content", "terms", "weights")))
    return rows.select("query_id", "rank", F.col("doc_id").alias("id"), "entity", F.nullif("topic", F.lit("")).alias("topic"), "name", "title", "tags",
                       F.when(F.col("snippet").isNull(), F.array().cast("array<string>")).otherwise(F.array("snippet")).alias("snippets"), "score")


def hits_json(h: DataFrame) -> DataFrame:
    """One JSON object per whole hit."""
    return h.select("query_id", "rank", F.to_json(F.struct(
        "id", "entity", "topic", "name", "title", "tags", "snippets", "score"), {"ignoreNullFields": "false"}).alias("json"))


def hit_text(h: DataFrame) -> DataFrame:
    """A whole hit as printed: score with two decimals, name and path, then its snippets."""
    head = F.format_string("[%.2f] %s  (%s)", F.col("score"), F.col("name"), F.concat_ws("/", "entity", "topic"))
    lines = F.concat(F.array(head), F.transform("snippets", lambda s: F.concat(F.lit("       "), s)))
    return h.select("query_id", "rank", F.array_join(lines, "\n").alias("text"))
