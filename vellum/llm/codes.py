"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

Codebooks are found by rounds of integer k-means per part position. Method
(adaptive distance bounds): every part keeps its entry with an upper bound,
its ``b`` next closest entries with ordered lower bounds, and one outer bound
for all others. When entries move, bounds move with them; a part whose upper
bound stays below all its lower bounds keeps its entry without a distance
being computed. Uncertain parts are settled by exact integer distances: of
the entries on their list, or of all entries where the outer bound fails.
``b`` follows how deep the lists were read in the round before. Bounds are
rounded away from the truth, so they only ever save work; ties go to the
lower index because a tie is never certain.

Scale: vectors are read once, into blocks of ``BLOCK`` rows (vectors, entries
and bounds) that are written to the shared folder each round; the round before
is deleted when the next stands. A task sends counts and sums of each entry,
at most parts x entries rows; the driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import discard, keep, table
from vellum.session import bounded_broadcast

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 4096  # rows of a stored block
DEEP = 0.02  # share of parts that may need more than b entries before b grows
LABELS = 1_000_000  # labels up to which their sums are broadcast

_OPEN = 255  # no entry at this place of a list


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries) of int64 rows; callers bound the components."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 52:  # exact in doubles
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


class Bounds:
    """The lists of one part position for a block of rows."""

    def __init__(self, entry, upper, near, low, outer):
        self.entry, self.upper, self.near, self.low, self.outer = entry, upper, near, low, outer

    @classmethod
    def of(cls, x: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
        """Exact lists of ``b`` entries."""
        n, k = len(x), len(entries)
        d = distances(x, entries)
        order = np.argsort(d, axis=1, kind="stable")  # ties to the lower index
        d = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        near, low = np.full((n, b), _OPEN, np.uint8), np.full((n, b), np.inf, np.float32)
        m = min(b, k - 1)
        near[:, :m], low[:, :m] = order[:, 1:1 + m], down(d[:, 1:1 + m])
        outer = down(d[:, 1 + m]) if k > 1 + m else np.full(n, np.inf, np.float32)
        return cls(order[:, 0].astype(np.uint8), up(d[:, 0]), near, low, outer)

    def resize(self, b: int) -> None:
        """Lists of ``b`` places; what is cut off falls under the outer bound, new places are open."""
        old = self.low.shape[1]
        if b < old:
            order = np.argsort(self.low, axis=1, kind="stable")
            self.near, self.low = np.take_along_axis(self.near, order, 1), np.take_along_axis(self.low, order, 1)
            self.outer = np.minimum(self.outer, self.low[:, b])
            self.near, self.low = self.near[:, :b], self.low[:, :b]
        elif b > old:
            n = len(self.entry)
            self.near = np.hstack([self.near, np.full((n, b - old), _OPEN, np.uint8)])
            self.low = np.hstack([self.low, np.full((n, b - old), np.inf, np.float32)])

    def update(self, x: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """Nearest entries after entries moved by at most ``moved``; how deep each part's list was read (b + 1: all entries)."""
        b = self.low.shape[1]
        shift = np.append(moved, np.zeros(256 - len(moved)))  # an open place has no entry that could move
        self.upper = up(self.upper.astype(np.float64) + shift[self.entry])
        self.low = down(self.low.astype(np.float64) - shift[self.near])
        self.outer = down(self.outer.astype(np.float64) - moved.max(initial=0))
        depth = np.zeros(len(x), np.int64)
        lowest = np.minimum(self.low.min(1, initial=np.inf), self.outer)
        at = np.flatnonzero(self.upper >= lowest)
        own = ((x[at] - entries[self.entry[at]]) ** 2).sum(1)
        self.upper[at] = up(np.sqrt(own.astype(np.float64)))
        open_ = self.upper[at] >= lowest[at]
        at, own = at[open_], own[open_]
        all_ = self.outer[at] <= self.upper[at]
        depth[at] = np.where(all_, b + 1, (self.low[at] <= self.upper[at, None]).sum(1))
        listed, own, full = at[~all_], own[~all_], at[all_]
        if len(listed):
            near = self.near[listed]
            gap = x[listed][:, None, :] - entries[np.minimum(near, len(entries) - 1)]
            d = np.where(near == _OPEN, np.iinfo(np.int64).max, (gap ** 2).sum(2))
            names = np.column_stack([self.entry[listed], near])
            d = np.column_stack([own, d])
            order = np.lexsort((names, d), axis=1)
            names, d = np.take_along_axis(names, order, 1), np.take_along_axis(d, order, 1)
            root = np.sqrt(d.astype(np.float64))
            self.entry[listed], self.upper[listed], self.near[listed] = names[:, 0], up(root[:, 0]), names[:, 1:]
            self.low[listed] = np.where(names[:, 1:] == _OPEN, np.float32(np.inf), down(root[:, 1:]))
        if len(full):
            new = Bounds.of(x[full], entries, b)
            for name in ("entry", "upper", "near", "low", "outer"):
                getattr(self, name)[full] = getattr(new, name)
        return depth


def moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry moved, rounded up: (parts, entries)."""
    return up(np.sqrt(((new - old) ** 2).sum(2).astype(np.float64))).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), label, "embedding")


def integers(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of (rows, length) as (rows, parts, part length); refuses what a long could not hold."""
    x = np.floor(vectors.astype(np.float64) * scale)
    most = float(np.abs(x).max(initial=0)) + 1
    if max(1, x.shape[1]) * (2 * most) ** 2 >= 2.0 ** 63:
        raise ValueError(f"a component of {most / scale:g} is too large: squared distances pass 64 bits")
    return x.astype(np.int64).reshape(len(vectors), parts, x.shape[1] // parts)


STATE = "n int, vec_id array<long>, label array<{label}>, x binary, entry binary, upper binary, near binary, low binary, outer binary"
TOTALS = "part int, place int, count long, sums array<long>"


def _state_schema(label: pa.DataType) -> pa.Schema:
    return pa.schema([("n", pa.int32()), ("vec_id", pa.list_(pa.int64())), ("label", pa.list_(label))]
                     + [(c, pa.binary()) for c in ("x", "entry", "upper", "near", "low", "outer")]
                     + [("part", pa.int32()), ("place", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])


class _Totals:
    """Counts and component sums of each entry, and how deep lists were read, over a task's rows."""

    def __init__(self, parts: int, k: int, d: int):
        self.count, self.sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        self.depth = np.zeros(257, np.int64)

    def add(self, part: int, x: np.ndarray, entry: np.ndarray, depth: np.ndarray | None = None) -> None:
        one = np.zeros((len(x), self.count.shape[1]))
        one[np.arange(len(x)), entry] = 1.0
        self.count[part] += one.sum(0).astype(np.int64)
        self.sums[part] += (one.T @ x.astype(np.float64)).astype(np.int64)  # exact: a block's sums are far below 2^53
        if depth is not None:
            self.depth += np.bincount(depth, minlength=257)

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        parts, k = self.count.shape
        out = [dict(part=p, place=e, count=int(self.count[p, e]), sums=self.sums[p, e].tolist())
               for p in range(parts) for e in range(k) if self.count[p, e]]
        out.append(dict(part=-1, place=0, count=0, sums=self.depth.tolist()))
        return pa.RecordBatch.from_pylist(out, schema=schema)


def _blocks(batches, label: pa.DataType, parts: int, scale: int, dim: int):
    """(vec_id, label, x) of blocks of rows."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            part = b.slice(lo, BLOCK)
            vectors = part.column("embedding")
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            if (lengths != dim).any():
                raise ValueError(f"vectors of lengths {sorted({dim, *lengths.tolist()})}: all need one length")
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
            yield part.column("vec_id"), part.column("label").cast(label), integers(x, parts, scale)


def _unpacked(row: dict, parts: int) -> tuple[np.ndarray, list[Bounds]]:
    n = row["n"]
    x = np.frombuffer(row["x"], np.int32).reshape(n, parts, -1).astype(np.int64)
    read = {c: np.frombuffer(row[c], np.uint8 if c in ("entry", "near") else np.float32).reshape(parts, n, -1).copy()
            for c in ("entry", "upper", "near", "low", "outer")}
    return x, [Bounds(read["entry"][p][:, 0], read["upper"][p][:, 0], read["near"][p], read["low"][p], read["outer"][p][:, 0]) for p in range(parts)]


def _packed(schema: pa.Schema, vec_id, label, x: np.ndarray, lists: list[Bounds]) -> pa.RecordBatch:
    n = len(x)
    blobs = [x.astype(np.int32).tobytes()] + [b"".join(np.ascontiguousarray(getattr(p, c)).tobytes() for p in lists)
                                              for c in ("entry", "upper", "near", "low", "outer")]
    one = [pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), vec_id),
           pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), label)] + [pa.array([x], pa.binary()) for x in blobs]
    return pa.RecordBatch.from_arrays(one + [pa.nulls(1, f.type) for f in list(schema)[len(one):]], schema=schema)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                 first_b: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, entry, error) stored, codebooks (parts, entries, part length)).

    ``entry`` has the entry number of each part, ``error`` the final squared
    distances summed over parts. Rows whose vector is null or holds null or
    non-finite components take no part. Codebooks start as the vectors of
    smallest vec_id (null ids last, rows of equal id by their components); with
    fewer vectors than ``entries`` there are fewer entries. Repeated rows are
    rows of their own. Distance ties go to the lower entry. An empty table
    gives an empty result and codebooks of length 0. Vectors of differing
    lengths, lengths that ``parts`` does not divide, and components whose
    squared distances pass 64 bits are refused. Columns besides vec_id, label
    and embedding are not read; without a label column labels are null.
    """
    if not 1 <= entries <= 254:
        raise ValueError("entries: 1 to 254")
    rows = usable(vectors)
    start = [r.embedding for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    spark = vectors.sparkSession
    label_sql = rows.schema["label"].dataType.simpleString()
    if not start:
        empty = f"vec_id long, label {label_sql}, entry binary, error long"
        return spark.createDataFrame([], empty), np.zeros((parts, 0, 0), np.int64)
    dim = len(start[0])
    if dim % parts or {len(v) for v in start} != {dim}:
        raise ValueError(f"vectors of lengths {sorted({len(v) for v in start})}: all need one length that {parts} divides")
    books = integers(np.array(start, np.float64).reshape(len(start), dim), parts, scale).transpose(1, 0, 2)
    k, d = books.shape[1:]
    from pyspark.sql.pandas.types import to_arrow_type

    label_type = to_arrow_type(rows.schema["label"].dataType)
    schema = _state_schema(label_type)
    sql = STATE.format(label=label_sql) + ", " + TOTALS
    b = min(254, max(1, first_b or -(-k // 4)))

    def begin(books, b):
        def run(batches):
            total = _Totals(parts, k, d)
            for vec_id, label, x in _blocks(batches, label_type, parts, scale, dim):
                lists = [Bounds.of(x[:, p], books[p], b) for p in range(parts)]
                for p, one in enumerate(lists):
                    total.add(p, x[:, p], one.entry)
                yield _packed(schema, vec_id, label, x, lists)
            yield total.rows(schema)
        return run

    def step(books, moved, b):
        def run(batches):
            total = _Totals(parts, k, d)
            for batch_ in batches:
                for i in range(batch_.num_rows):
                    row = {c: batch_.column(c)[i].as_py() for c in ("n", "x", "entry", "upper", "near", "low", "outer")}
                    x, lists = _unpacked(row, parts)
                    for p, one in enumerate(lists):
                        one.resize(b)
                        depth = one.update(x[:, p], books[p], moved[p])
                        total.add(p, x[:, p], one.entry, depth)
                    yield _packed(schema, batch_.column("vec_id")[i].values, batch_.column("label")[i].values, x, lists)
            yield total.rows(schema)
        return run

    def finish(books, moved, b):
        out = pa.schema([("vec_id", pa.int64()), ("label", label_type), ("entry", pa.binary()), ("error", pa.int64())])

        def run(batches):
            for batch_ in batches:
                for i in range(batch_.num_rows):
                    row = {c: batch_.column(c)[i].as_py() for c in ("n", "x", "entry", "upper", "near", "low", "outer")}
                    x, lists = _unpacked(row, parts)
                    error = np.zeros(len(x), np.int64)
                    for p, one in enumerate(lists):
                        one.resize(b)
                        one.update(x[:, p], books[p], moved[p])
                        error += ((x[:, p] - books[p][one.entry]) ** 2).sum(1)
                    code = np.ascontiguousarray(np.stack([one.entry for one in lists], 1)).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [batch_.column("vec_id")[i].values, batch_.column("label")[i].values,
                         pa.array([code[parts * j:parts * (j + 1)] for j in range(len(x))], pa.binary()), pa.array(error)], schema=out)
        return run

    state, path = keep(rows.mapInArrow(begin(books, b), sql), "codes")
    moved = np.zeros((parts, k))
    for turn in range(rounds):
        totals = (state.where("part is not null").select("part", "place", "count", F.posexplode("sums").alias("i", "v"))
                  .groupBy("part", "place", "i").agg(F.sum("count").alias("count"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
        depth, new = np.zeros(257, np.int64), books.copy()
        for r in totals:
            if r.part < 0:
                depth[r.i] = int(r.v)
            else:
                new[r.part, r.place, r.i] = int(r.v) // r["count"]
        b = next_b(depth, b, k)
        books, moved = new, moves(books, new)
        if turn < rounds - 1:
            fresh, at = keep(state.where("n is not null").mapInArrow(step(books, moved, b), sql), "codes")
            discard(spark, path)
            state, path = fresh, at
    blocks = state.where("n is not null")
    coded, _ = keep(blocks.mapInArrow(finish(books, moved, b), f"vec_id long, label {label_sql}, entry binary, error long"), "coded")
    discard(spark, path)
    return coded, books


def next_b(depth: np.ndarray, b: int, k: int) -> int:
    """The shortest lists that all but ``DEEP`` of the parts would have got by with; one longer than now, and an eighth of ``k``, bound it.

    ``depth[z]`` counts parts that read z places, ``b + 1`` those that needed all entries.
    """
    total = int(depth.sum())
    if not total:
        return b
    beyond = total - np.cumsum(depth)  # parts that read more than z places
    enough = int(np.argmax(beyond <= DEEP * total))
    return max(1, -(-k // 8), min(enough, b + 1, k - 1))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: errors summed over equal labels, nulls together.

    Sums are combined before their shuffle; they are broadcast only where at
    most ``LABELS`` labels are counted, else joined (a hot label is split by AQE).
    """
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = bounded_broadcast(sums.withColumnRenamed("label", "__of"), LABELS)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__of"))).drop("__of")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return label_errors(coded).select("vec_id", F.lower(F.hex("entry")).alias("code"), "error", "label_error",
                                      F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds as a chain of tables."""
    ctes = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""u AS (SELECT r, unnest(range(len(embedding))) AS i, unnest(embedding) AS f, len(embedding) // {PARTS} AS d FROM v)""",
            f"""x AS MATERIALIZED (SELECT r, i // d AS part, i % d AS pos, CAST(floor({SCALE} * CAST(f AS DOUBLE)) AS BIGINT) AS c FROM u)""",
            f"""c0 AS MATERIALIZED (SELECT part, r AS entry, pos, c FROM x WHERE r < {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT r, part, min(s * {ENTRIES} + entry) % {ENTRIES} AS entry, min(s * {ENTRIES} + entry) // {ENTRIES} AS s
  FROM (SELECT x.r, x.part, e.entry, CAST(sum((x.c - e.c) * (x.c - e.c)) AS BIGINT) AS s FROM x JOIN c{k} e ON x.part = e.part AND x.pos = e.pos
        GROUP BY x.r, x.part, e.entry) GROUP BY r, part)""")
        if k < ROUNDS:
            ctes.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.part, o.entry, o.pos, CASE WHEN n.n IS NULL THEN o.c ELSE
    CAST((n.s - ((n.s % n.n) + n.n) % n.n) // n.n AS BIGINT) END AS c
  FROM c{k} o LEFT JOIN (SELECT x.part, a.entry, x.pos, CAST(sum(x.c) AS BIGINT) AS s, count(*) AS n
                         FROM x JOIN a{k} a ON x.r = a.r AND x.part = a.part GROUP BY x.part, a.entry, x.pos) n
  ON o.part = n.part AND o.entry = n.entry AND o.pos = n.pos)""")
    return "WITH " + ",\n".join(ctes) + f"""
, q AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(s) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT v.vec_id, q.code, q.error, CAST(sum(q.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM v JOIN q ON v.r = q.r
"""


ORACLE = _oracle()
