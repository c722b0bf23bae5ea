"""Exact duplicates through an extendible-hash index on shared files.

Method: texts are hashed; the directory of an extendible hash table starts
with one bucket and doubles, a bit at a time, until no bucket holds more than
``bucket_bytes`` of text (a bucket of one key can't be split and stays). The
directory runs over the keys' leading bits, so buckets are key ranges, and
each owner task takes the entries of its buckets in key order, chains those
of equal key and compares their bytes. The index (entries with their place in
the chain) is written to the shared folder; groups are read off it.

Scale: equal texts of one Arrow batch become one entry first, so a text that
a third of all rows hold reaches its owner a few times per task, not once per
row. Texts are shuffled once; all else is hashes and ids. The directory on
the driver has 8 bytes per ``bucket_bytes`` of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import batch, chunks, doc_rows, store, table, with_uid

BUCKET_BYTES = 8 << 20
KEY_BITS = 64

ENTRY = pa.schema([("key", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("bucket", pa.int32()),
                   ("rows", pa.list_(pa.struct([("uid", pa.int64()), ("doc_id", pa.int64())])))])
ENTRY_SQL = "key long, sha string, body binary, bucket int, rows array<struct<uid: long, doc_id: long>>"


def normalised(text: str | None) -> bytes:
    """A-Z lower-cased, nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _entries(texts: list[str | None]) -> list[tuple[bytes, bytes, list[int]]]:
    """(digest, bytes, row numbers) of the distinct texts."""
    found: dict[bytes, list] = {}
    for i, t in enumerate(texts):
        body = normalised(t)
        chain = found.setdefault(hashlib.sha256(body).digest(), [])
        for other, at in chain:
            if other == body:
                at.append(i)
                break
        else:
            chain.append((body, [i]))
    return [(digest, body, at) for digest, chain in found.items() for body, at in chain]


def _texts(b: pa.RecordBatch):
    """The texts of a batch, in pieces of bounded size, with their offset."""
    texts = b.column("text").to_pylist()
    for lo, hi in chunks(texts, 32_000_000):
        yield lo, texts[lo:hi]


def _unsigned(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big")


def sizes(docs: DataFrame) -> DataFrame:
    """(key, bytes) of the entries: what the directory is built from."""
    schema = pa.schema([("key", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        for b in batches:
            for _, texts in _texts(b):
                e = _entries(texts)
                keys = np.array([_unsigned(d) for d, _, _ in e], np.uint64).view(np.int64)
                yield batch(schema, [keys, np.array([len(x) + 64 for _, x, _ in e], np.int64)])

    return doc_rows(docs).mapInArrow(run, "key long, bytes long")


def directory(keyed: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> np.ndarray:
    """Lower bounds of the buckets' key ranges, unsigned and ascending.

    Buckets start as one of depth 0. Every round splits the overfull ones;
    ``step`` doublings are counted in one pass over the (narrow) stored keys.
    A bucket whose entries share one key is not split further.
    """
    step = 8
    done: list[int] = []
    depth, full = 0, [0]
    while full:
        to = min(KEY_BITS, depth + step)
        top = F.shiftrightunsigned("key", KEY_BITS - depth) if depth else F.lit(0).cast("long")
        slot = F.shiftrightunsigned("key", KEY_BITS - to) if to < KEY_BITS else F.col("key")
        counted = keyed if depth == 0 else keyed.where(top.isin(full))
        got = counted.groupBy(slot.alias("slot")).agg(
            F.sum("bytes").alias("bytes"), (F.min("key") == F.max("key")).alias("one")).collect()
        size = {(r.slot & ((1 << 64) - 1)): (r.bytes, r.one) for r in got}
        level = {p: None for p in full}
        for d in range(depth, to + 1):
            split = []
            weight: dict[int, list] = {}
            for s, (n, one) in size.items():
                if (p := s >> (to - d)) in level:
                    x = weight.setdefault(p, [0, 0])
                    x[0] += n
                    x[1] += 1 if one else 2
            for p in level:
                n, keys = weight.get(p, (0, 0))
                if n > bucket_bytes and keys > 1 and d < KEY_BITS:
                    split.append(p)
                else:
                    done.append(p << (KEY_BITS - d))
            if d == to:
                full = split
                break
            level = {q: None for p in split for q in (2 * p, 2 * p + 1)}
            if not level:
                full = []
                break
        depth = to
    return np.array(sorted(done), np.uint64)


def index(docs: DataFrame, bounds: np.ndarray, uid: str | None = None) -> DataFrame:
    """(key, chain, sha, rows): every entry with its place among the texts of its key."""

    def spread(batches):
        for b in batches:
            uid, doc = b.column("uid").to_pylist(), b.column("doc_id").to_pylist()
            for lo, texts in _texts(b):
                e = _entries(texts)
                keys = np.array([_unsigned(d) for d, _, _ in e], np.uint64)
                yield batch(ENTRY, [keys.view(np.int64), [d.hex() for d, _, _ in e], [x for _, x, _ in e],
                                    (np.searchsorted(bounds, keys, "right") - 1).astype(np.int32),
                                    [[{"uid": uid[lo + i], "doc_id": doc[lo + i]} for i in at] for _, _, at in e]])

    out = pa.schema([("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.string()), ENTRY.field("rows")])

    def own(batches):
        key, chain = None, []
        for b in batches:
            places = []
            for k, body in zip(b.column("key").to_pylist(), b.column("body")):
                if k != key:
                    key, chain = k, []
                body = body.as_py()
                place = next((i for i, other in enumerate(chain) if other == body), len(chain))
                if place == len(chain):
                    chain.append(body)
                places.append(place)
            yield batch(out, [b.column("key"), places, b.column("sha"), b.column("rows")])

    owned = (doc_rows(docs, uid).mapInArrow(spread, ENTRY_SQL).repartition(len(bounds), "bucket")
             .sortWithinPartitions("bucket", "key"))
    return store(owned.mapInArrow(own, "key long, chain int, sha string, rows array<struct<uid: long, doc_id: long>>"), "exact-index")


def exact_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, uid: str | None = None) -> DataFrame:
    """(uid, doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty. Of equal texts the row of largest doc_id is kept; of rows that also
    share the id (repeated rows), the first in the table. Null ids are smaller
    than any id; keep_id is null only if all ids of the group are. An empty
    table gives an empty result. Only doc_id and text are read, so extra
    columns of any name do no harm.
    """
    keyed = store(sizes(docs), "exact-keys")
    entries = index(docs, directory(keyed, bucket_bytes), uid)
    best = F.array_max(F.transform("rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), (-r["uid"]).alias("first"))))
    groups = entries.select("key", "chain", F.size("rows").alias("n"), best.alias("best")).groupBy("key", "chain").agg(
        F.max("best").alias("best"), F.sum("n").cast("long").alias("group_size"))
    return (entries.join(groups, ["key", "chain"]).select("sha", "best", "group_size", F.explode("rows").alias("r"))
            .select(F.col("r.uid").alias("uid"), F.col("r.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"),
                    "group_size", (F.col("r.uid") == -F.col("best.first")).alias("kept"), F.col("sha").alias("text_sha256")))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that stay, with the columns they came with.

    The defined results are those of ``exact_groups``; columns of any name
    pass through as they are.
    """
    docs, uid = with_uid(docs)
    kept = exact_groups(docs, uid=uid).where("kept").select(F.col("uid").alias(uid))
    return docs.join(kept, uid, "left_semi").drop(uid)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("uid")


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rn,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, rn) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
