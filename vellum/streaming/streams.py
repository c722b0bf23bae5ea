"""Streams of changes (T1) and of documents to index.

T1: a file stream of change-log rows. The table is log-structured: the base
rows are segment ``batch=-1`` of ``upserts``; each micro-batch applies the
batch operator (M10) in delta form to the part of the current view it can
affect (documents it targets by id or whose names its saves use: decided on
(id, name, segment), stored once; content is read only of the rows it patches)
and writes only its upserted rows
(``upserts/batch=<id>``, partitioned by id bucket), deleted ids
(``deletes/batch=<id>``) and rejects. The current view is the latest upsert of every id without a
delete. A micro-batch reads the view of the segments before it, so a replay
rewrites the same segments (idempotent), and its cost follows the batch and
the narrow decision columns, not the table's content. Contract: ``seq``
never decreases across micro-batches (the log arrives in order).

T2: a file stream of documents; each micro-batch appends the postings of its
documents as a new segment ``batch=<id>`` and records (doc_id, batch) in a
version table. Readers keep, per document, only the postings of its latest
batch, so an upsert never rewrites old segments.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import changes as chg
from vellum.operators import index as ix
from vellum.schema import CHANGES
from vellum.session import bounded_broadcast


def _batch_dirs(path: str, prefix: str) -> list[int]:
    if not os.path.isdir(path):
        return []
    return sorted(int(d[len(prefix):]) for d in os.listdir(path)
                  if d.startswith(prefix) and os.path.exists(os.path.join(path, d, "_SUCCESS")))


def _segments(spark: SparkSession, path: str, lo: int | None, hi: int | None) -> DataFrame | None:
    """Rows of ``path/batch=*`` with lo < batch < hi (bounds optional)."""
    batches = [b for b in _batch_dirs(path, "batch=")
               if (lo is None or b > lo) and (hi is None or b < hi)]
    if not batches:
        return None
    return spark.read.option("basePath", path).parquet(*[os.path.join(path, f"batch={b}") for b in batches])


ID_BUCKETS = 64


def id_bucket(col) -> F.Column:
    return F.pmod(F.xxhash64(col), F.lit(ID_BUCKETS)).cast("int")


def _write_rows(df: DataFrame, path: str) -> None:
    """Document rows partitioned by id bucket, so a micro-batch can read
    only the buckets of the documents it touches. The rows of a bucket are
    brought together first (a large bucket is split again by size): every
    later micro-batch opens these files, and without it each writing task
    leaves a small one in every bucket."""
    rows = df.withColumn("idb", id_bucket(F.col("id"))).hint("rebalance", "idb")
    rows.write.mode("overwrite").partitionBy("idb").parquet(path)


def _upserts(spark: SparkSession, root: str, lo: int | None, before: int | None) -> DataFrame:
    """Rows of the compacted base ``lo`` (None: no base) and of the upsert segments after it, with their ``batch``."""
    ups = _segments(spark, os.path.join(root, "upserts"), lo, before)
    if lo is None:
        return ups
    base = spark.read.parquet(os.path.join(root, "compacted", f"upto={lo}")).withColumn("batch", F.lit(lo))
    return base if ups is None else base.unionByName(ups)


def _base_of(root: str, before: int | None) -> int | None:
    """The newest compaction before ``before``."""
    comp = [c for c in _batch_dirs(os.path.join(root, "compacted"), "upto=")
            if before is None or c < before]
    return comp[-1] if comp else None


def _live(spark: SparkSession, root: str, before: int | None, *cols: str) -> DataFrame:
    """``cols`` and ``batch`` of the latest upsert of every id without a delete."""
    lo = _base_of(root, before)
    ups = _upserts(spark, root, lo, before).select(*cols, "batch")
    dels = _segments(spark, os.path.join(root, "deletes"), lo, before)
    latest = ups.groupBy("id").agg(F.max("batch").alias("batch"))
    view = ups.join(latest, ["id", "batch"], "left_semi")
    return view if dels is None else view.join(dels.select("id"), "id", "left_anti")


def change_view(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The documents table as of the segments before ``before`` (all when
    None): the newest compacted base before that point, then the latest
    upsert per id from later segments, minus ids deleted in them."""
    return _live(spark, root, before, *chg.DOC_COLS).drop("batch")


def touched_view(spark: SparkSession, root: str, before: int, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents of the view that a batch of changes can affect: (id, name), stored, and their rows.

    These are the documents whose id it targets, or whose name one of its
    saves uses. They are found on narrow columns and stored with the segment
    that holds them, so that their rows are a filter of the buckets they lie
    in, whatever is read of them how often.
    """
    keys = _live(spark, root, before, "id", "name")
    saves = batch.where(F.col("op") == "save").select("name")
    relevant = (batch.where(F.col("op") != "save").select("id")
                .unionByName(keys.join(saves, "name", "left_semi").select("id")).distinct())
    keys = ix._staged(keys.join(relevant, "id", "left_semi"))
    buckets = [r[0] for r in keys.select(id_bucket(F.col("id")).alias("idb")).distinct().collect()]
    rows = _upserts(spark, root, _base_of(root, before), before).where(F.col("idb").isin(buckets))
    rows = rows.join(bounded_broadcast(keys.select("id", "batch").distinct()), ["id", "batch"], "left_semi")
    return keys.select("id", "name"), rows.select(*chg.DOC_COLS)


def compact_changes(spark: SparkSession, root: str, upto: int) -> None:
    """Write the view through batch ``upto`` as a compacted base; readers
    after it skip every older segment. Deterministic, so a rerun rewrites
    the same files."""
    _write_rows(change_view(spark, root, before=upto + 1), os.path.join(root, "compacted", f"upto={upto}"))


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return change_view(spark, root)


def start_change_stream(spark: SparkSession, source_dir: str, root: str, base_docs: DataFrame,
                        entities: DataFrame, files_per_batch: int = 1, compact_every: int = 8):
    """Start the stream; returns the StreamingQuery (``availableNow``).
    Every ``compact_every`` micro-batches the view is compacted."""
    _write_rows(base_docs, os.path.join(root, "upserts", "batch=-1"))
    ents_path = os.path.join(root, "entities")
    entities.write.mode("overwrite").parquet(ents_path)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        names, rows = touched_view(spark, root, batch_id, batch)
        ents = spark.read.parquet(ents_path)
        ups, dels, rejects = chg.apply_changes_delta(rows, ents, batch, names)
        _write_rows(ups, os.path.join(root, "upserts", f"batch={batch_id}"))
        dels.write.mode("overwrite").parquet(os.path.join(root, "deletes", f"batch={batch_id}"))
        rejects.write.mode("overwrite").parquet(os.path.join(root, "rejects", f"batch={batch_id}"))
        batch.unpersist()
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_changes(spark, root, batch_id)

    stream = (spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch)
              .parquet(source_dir))
    return (stream.writeStream.foreachBatch(apply_batch)
            .option("checkpointLocation", os.path.join(root, "_stream_checkpoint"))
            .trigger(availableNow=True).start())


INDEX_PARTS = ("postings", "positions", "doc_stats", "versions")


def start_index_stream(spark: SparkSession, source_dir: str, root: str, schema,
                       files_per_batch: int = 1, compact_every: int = 8):
    """Start the stream of documents to index (upserts by id). Within a
    micro-batch the newest version of a document (by ``updated_at``) wins.
    Every ``compact_every`` micro-batches the live index is compacted."""

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        cols = batch.columns
        newest = batch.groupBy("id").agg(F.max_by(F.struct(*cols), F.col("updated_at")).alias("d"))
        docs = newest.select("d.*")
        idx = ix.build_index(docs)
        idx.postings.drop("positions").write.mode("overwrite").parquet(os.path.join(root, "postings", f"batch={batch_id}"))
        idx.positions.write.mode("overwrite").parquet(os.path.join(root, "positions", f"batch={batch_id}"))
        idx.doc_stats.write.mode("overwrite").parquet(os.path.join(root, "doc_stats", f"batch={batch_id}"))
        (docs.select(F.col("id").alias("doc_id"))
         .write.mode("overwrite").parquet(os.path.join(root, "versions", f"batch={batch_id}")))
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_index(spark, root, batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    return (stream.writeStream.foreachBatch(index_batch)
            .option("checkpointLocation", os.path.join(root, "_stream_checkpoint"))
            .trigger(availableNow=True).start())


def read_stream_index(spark: SparkSession, root: str, before: int | None = None) -> ix.Index:
    """The live index: per document, the segment of its latest batch only,
    starting from the newest compaction before ``before``."""
    comp = [c for c in _batch_dirs(os.path.join(root, "compacted"), "upto=")
            if before is None or c < before]
    lo = comp[-1] if comp else None
    tables = {}
    for part in INDEX_PARTS:
        seg = _segments(spark, os.path.join(root, part), lo, before)
        if lo is not None:
            base = spark.read.parquet(os.path.join(root, "compacted", f"upto={lo}", part)).withColumn(
                "batch", F.lit(lo))
            seg = base if seg is None else base.unionByName(seg)
        tables[part] = seg
    latest = tables["versions"].groupBy("doc_id").agg(F.max("batch").alias("batch"))
    post, pos, stats = (tables[p].join(latest, ["doc_id", "batch"], "left_semi").drop("batch")
                        for p in ("postings", "positions", "doc_stats"))
    return ix.Index(post, stats, ix.term_stats_of(post), ix.corpus_of(stats), positions=pos)


def compact_index(spark: SparkSession, root: str, upto: int) -> None:
    """Write the live index through batch ``upto`` as one compacted base."""
    idx = read_stream_index(spark, root, before=upto + 1)
    out = os.path.join(root, "compacted", f"upto={upto}")
    idx.postings.write.mode("overwrite").parquet(os.path.join(out, "postings"))
    idx.positions.write.mode("overwrite").parquet(os.path.join(out, "positions"))
    idx.doc_stats.write.mode("overwrite").parquet(os.path.join(out, "doc_stats"))
    idx.doc_stats.select("doc_id").distinct().write.mode("overwrite").parquet(os.path.join(out, "versions"))
    # the folder is complete only once every part is written
    open(os.path.join(out, "_SUCCESS"), "w").close()


def write_in_order(df: DataFrame, target: str, order_col: str, chunks: int, files: int = 1) -> None:
    """Producer side of the stream contract: write ``df`` as ``chunks`` log
    segments in ``order_col`` order, ``files`` files per segment, one commit
    after the other, so the file stream (oldest file first, ``files`` a
    micro-batch) replays them in order. Segment bounds come from approximate
    quantiles (1% rank error): any bounds give disjoint, ordered segments, and
    the summaries stay small. Tasks without rows write no file; empty ones are
    added, so that no micro-batch holds files of two segments."""
    spark = df.sparkSession
    bounds = sorted(set(df.approxQuantile(order_col, [i / chunks for i in range(1, chunks)], 0.01)))
    edges = [None] + bounds + [None]
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        part = df
        if lo is not None:
            part = part.where(F.col(order_col) > F.lit(lo))
        if hi is not None:
            part = part.where(F.col(order_col) <= F.lit(hi))
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.mode("append").parquet(target)
        for _ in range((i + 1) * files - len(spark.read.schema(df.schema).parquet(target).inputFiles())):
            df.limit(0).coalesce(1).write.mode("append").parquet(target)
