"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Method: a vector is a sparse row of (dimension, integer weight) terms.
Candidates are cut into blocks, queries into blocks; every pair of blocks is
one task's work. A task builds the posting list of each dimension in its
candidate block, and for one dimension after another scatters query weight
times posting weight into a dense array of scores (candidates x queries).
Per query a partition selection takes the block's best ``k``; the final merge
ranks the few rows of all blocks.

The query set is given (a fixed share of the rows), so all queries meet all
candidates: the work is the product of both by the contract's definition.
Blocks bound every task: ``QUERY_BLOCK`` x ``CANDIDATE_BLOCK`` scores at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import store, table

SCALE = 64
K = 20
QUERY_EVERY = 20
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4096
SLICE = 512  # candidates whose scores are summed at once, so that they stay in the processor's cache


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, v): components floor(scale * x); vectors null or with a null or non-finite component are left out.

    A component that a long cannot hold is refused, as are scores (see ``top_k``).
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.when(F.abs(e) < 2.0 ** 62 / scale, F.floor(e * scale).cast("long")).otherwise(
            F.raise_error(F.lit("a component is too large for 64 bits")).cast("long"))).alias("v"))


def _terms(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, weight) of the non-zero components of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    dim = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(values)
    return row[at], dim[at], values[at]


def _postings(terms) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (rows, weights)."""
    row, dim, weight = terms
    order = np.argsort(dim, kind="stable")
    row, dim, weight = row[order], dim[order], weight[order]
    cuts = np.flatnonzero(np.r_[True, dim[1:] != dim[:-1]]) if len(dim) else np.zeros(0, int)
    return {int(dim[a]): (row[a:b], weight[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(dim)])}


def accumulate(candidates, queries, n: int, m: int, kind) -> np.ndarray:
    """Scores (m queries, n candidates) in integers of ``kind``, one dimension at a time.

    A posting list that names over a quarter of its block is scattered once
    into a dense row, whose zeros add nothing; a shorter one is added at its
    places only.
    """
    scores, add = np.zeros((m, n), kind), np.empty((m, n), kind)

    def dense(rows, weights, size):
        if 4 * len(rows) <= size:
            return rows, weights.astype(kind)
        row = np.zeros(size, kind)
        row[rows] = weights
        return None, row

    mine = _postings(queries)
    for dim, found in _postings(candidates).items():
        if dim in mine:
            asked, w = dense(*mine[dim], m)
            rows, weights = dense(*found, n)
            part = add[:len(w), :len(weights)]
            np.multiply(w[:, None], weights[None, :], out=part)
            if asked is None and rows is None:
                scores += part
            elif rows is None:
                scores[asked] += part
            elif asked is None:
                scores[:, rows] += part
            else:
                scores[asked[:, None], rows[None, :]] += part
    return scores


def _norm(terms) -> float:
    return np.bincount(terms[0], terms[2].astype(float) ** 2).max(initial=0) ** 0.5


def best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of each query's k highest scores, ties to the lower column; column ``own`` (-1: none) is left out."""
    m, n = scores.shape
    free = np.ones((m, n), bool)
    has = own >= 0
    free[np.flatnonzero(has), own[has]] = False
    low = np.iinfo(scores.dtype).min  # no score reaches it
    scores = np.where(free, scores, low)
    edge = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(m, low, scores.dtype)
    q, c = np.nonzero((scores >= edge[:, None]) & free)
    tie = scores[q, c] == edge[q]
    order = np.lexsort((c, tie, q))  # per query: above the edge first, then ties by column
    q, c = q[order], c[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], c[place < k]


def top_k(vectors: DataFrame, is_query, k: int = K, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` best other rows.

    ``vectors`` has (uid, vec_id, v); ``is_query`` is a condition on it.
    Vectors of unequal length are compared on the dimensions both have. A row
    is its own only by ``uid``: a repeated row is a candidate of its copy and
    a query of its own. Ties go to the smaller vec_id (null last). Empty
    vectors score 0. Vectors whose scores could pass 64 bits are refused, by
    the product of their lengths. An empty table gives an empty result.
    Columns but vec_id and embedding are not read.
    """
    rows = store(vectors, "vectors")
    asked = rows.where(is_query)
    q_blocks = max(1, -(-asked.count() // query_block))
    c_blocks = max(1, -(-rows.count() // candidate_block))
    spread = F.pmod(F.xxhash64("uid"), F.lit(q_blocks * c_blocks * 1_000_003))
    mine = asked.select("uid", "vec_id", "v", F.lit(True).alias("q"), (spread % q_blocks).cast("int").alias("i"),
                        F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("j"))
    others = rows.select("uid", "vec_id", "v", F.lit(False).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("i"),
                         (spread % c_blocks).cast("int").alias("j"))
    schema = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, t):
        is_q = t.column("q").to_numpy(zero_copy_only=False)
        q, c = t.filter(pa.array(is_q)), t.filter(pa.array(~is_q))
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        c = c.sort_by([("vec_id", "ascending"), ("uid", "ascending")])  # null last
        asked_terms, v = _terms(q.column("v")), c.column("v").combine_chunks()
        parts = [(_terms(v.slice(a, SLICE)), min(SLICE, len(v) - a)) for a in range(0, len(v), SLICE)]
        bound = _norm(asked_terms) * max(_norm(x) for x, _ in parts)  # of every partial sum
        if bound >= 2.0 ** 63:
            raise ValueError("scores could pass 64 bits: components are too large")
        kind = next(x for x in (np.int16, np.int32, np.int64) if bound < np.iinfo(x).max or x is np.int64)
        scores = np.concatenate([accumulate(x, asked_terms, n, q.num_rows, kind) for x, n in parts], axis=1)
        c_uid, q_uid = c.column("uid").to_numpy(), q.column("uid").to_numpy()
        at = {u: i for i, u in enumerate(c_uid.tolist())}
        col, cat = best(scores, np.array([at.get(u, -1) for u in q_uid.tolist()]), k)
        return pa.table([pa.array(q_uid[col]), q.column("vec_id").take(pa.array(col)),
                         pa.array(c_uid[cat]), c.column("vec_id").take(pa.array(cat)),
                         pa.array(scores[col, cat].astype(np.int64))], schema=schema)

    found = mine.unionByName(others).groupBy("i", "j").applyInArrow(
        run, "query_uid long, query_id long, uid long, vec_id long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
