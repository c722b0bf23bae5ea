"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import ensure_checkpoint_dir

#: Name of the row identity that stages add (see ``with_uid`` for inputs that have a column of this name).
UID = "__row_uid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared checkpoint folder and read back, and where it lies.

    Cuts the lineage with files that every executor can reach, so that a lost
    executor costs only the tasks that were running on it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def store(df: DataFrame, label: str) -> DataFrame:
    """The table of ``keep``."""
    return keep(df, label)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``keep`` that nothing reads any more, through the file system it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_uid(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` plus a row identity, and that column's name, which no column of ``docs`` has.

    Rows are told apart by their place in the stored files, so repeated rows
    and null or repeated ids stay separate. The identity is the file's number
    (in the order of paths) and the row's number in the file: both are the
    same in every scan, however files are split and tasks are run again. What
    is no plain scan of files is written to the shared folder once with its
    numbers, and only that copy is read. The list of files is collected, as
    Spark's own file listing is.
    """
    spark, uid = docs.sparkSession, free_name(docs, UID)
    scan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if not scan or "_metadata" in {c.lower() for c in docs.columns}:
        return store(docs.withColumn(uid, F.monotonically_increasing_id()), "rows"), uid
    path, number = free_name(docs, "__path"), free_name(docs, "__file")
    placed = docs.withColumn(path, F.col("_metadata.file_path")).withColumn(uid, F.col("_metadata.row_index"))
    files = sorted(r[0] for r in placed.select(path).distinct().collect())
    numbers = spark.createDataFrame(list(enumerate(files)), f"`{number}` long, `{path}` string")
    return placed.join(F.broadcast(numbers), path).withColumn(
        uid, F.shiftleft(number, 36).bitwiseOR(F.col(uid))).drop(path, number), uid


def doc_rows(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """(uid, doc_id, text) of a documents table; other columns are not read.

    Without the name of an identity column, ``uid`` numbers the rows of this
    scan alone: enough where the result is stored before it is read again.
    """
    own = F.monotonically_increasing_id() if uid is None else F.col(uid)
    return docs.select(own.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def chunks(texts: list[str | None], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters (one text may exceed it)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class WordTable:
    """Word ids and one float vector per distinct word, filled as words appear.

    ``compute(words)`` gives the vectors of new words. The table is emptied
    when it passes ``limit`` words, so a task's memory is bounded whatever the
    vocabulary.
    """

    class _Index(dict):
        def __missing__(self, word: str) -> int:
            self[word] = i = len(self)
            return i

    def __init__(self, compute, dim: int, limit: int = 200_000):
        self.compute, self.dim, self.limit = compute, dim, limit
        self.index, self.vectors = self._Index(), np.zeros((0, dim), np.float32)

    def ids(self, words_of: list[list[str]]) -> np.ndarray:
        """Ids of all words, concatenated; ``vectors`` then covers them."""
        if len(self.index) > self.limit:
            self.index, self.vectors = self._Index(), np.zeros((0, self.dim), np.float32)
        get = self.index.__getitem__
        flat: list[int] = []
        for ws in words_of:
            flat += map(get, ws)
        out = np.array(flat, np.int64)
        if (known := len(self.vectors)) < len(self.index):
            new = list(self.index)[known:]
            if len(self.index) > (room := getattr(self, "_buffer", self.vectors).shape[0]) or known == 0:
                grown = np.zeros((max(1024, 2 * len(self.index), room), self.dim), np.float32)
                grown[:known] = self.vectors
                self._buffer = grown
            for k in range(0, len(new), 8192):  # bounds what computing the vectors holds
                part = new[k:k + 8192]
                self._buffer[known + k:known + k + len(part)] = self.compute(part)
            self.vectors = self._buffer[:len(self.index)]
        return out


def letters_only(words: list[str]) -> list[str]:
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]


def gram_ids(words: list[str], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of ``^word$`` for every word and size, flat, with each gram's word number.

    A word too short for a size has no gram of it.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32)
    word_of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    out, of = [], []
    h = np.zeros(len(codes), np.uint32)
    for k in range(max(sizes)):
        n = max(0, len(codes) - k)
        h = (h[:n] ^ codes[k:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k + 1 in sizes:
            inside = np.flatnonzero(word_of[:n] == word_of[k:])
            out.append(((h[inside] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int64))
            of.append(word_of[inside])
    return np.concatenate(out), np.concatenate(of)
