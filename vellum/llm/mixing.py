"""Mixing sources to target weights by Poisson replication.

Method: each document is repeated a Poisson-distributed number of times whose
mean is its source's target repetition rate. The draw inverts the Poisson
distribution at a uniform number taken from a seeded hash of the document's
id, so it needs no state, no second pass and comes out the same on every run.
Documents are exploded by their counts and shuffled globally by a hash of row
and copy.

Scale: one aggregation (a row per source, combined before its shuffle) and
one shuffle of the result. No shuffle is keyed by source, so a source with a
third of all rows is spread like the rest. The table of sources is broadcast
only if it has at most ``BROADCAST_SOURCES`` rows; beyond that it is joined
on source and a salt. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import free_name, table

TEMPERATURE = 0.5
SEED = 20240
BROADCAST_SOURCES = 50_000
SALTS = 64


def mass(text: str = "text") -> F.Column:
    """Size of a document: its characters and its end."""
    return F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long") + 1


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE,
                 epochs: float = 1.0) -> DataFrame:
    """(source, rate): expected copies of each document of the source.

    ``weights`` are target shares of the mixture's characters by source;
    sources not named get 0. Without weights the share of a source is
    its size to the power ``temperature``. The mixture's expected size is
    ``epochs`` times the input's. Null is a source of its own.
    """
    per = docs.groupBy("source").agg(F.sum(mass()).alias("mass"))
    if weights is None:
        per = per.withColumn("weight", F.pow(F.col("mass").cast("double"), F.lit(float(temperature))))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        per = per.withColumn("weight", weight)
    total = per.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    return per.crossJoin(F.broadcast(total)).select(  # one row
        "source", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * (F.lit(float(epochs)) * F.col("all_mass")) / F.col("mass"))
        .otherwise(F.lit(0.0)).alias("rate"))


def poisson_steps(rate: F.Column) -> F.Column:
    """P(count <= k) for k = 0, 1, ... until the rest is below double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def add(acc, k):
        log = acc["log"] + F.log(rate) - F.log(k)
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, add)["steps"]).otherwise(F.array(F.lit(1.0)))


def uniform(seed: int) -> F.Column:
    """A number in [0, 1) from 52 bits of the seeded hash of doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE,
        epochs: float = 1.0, seed: int = SEED, copy: str = "copy") -> DataFrame:
    """``docs`` repeated to the target shares, in random order, with the copy's number (from 1) in column ``copy``.

    The copy number replaces a column of its name in the input. Documents
    drawn zero times are absent. Rows of one id draw alike (also null ids,
    and repeated rows); null and empty texts count as one character, texts of
    any length with all of theirs; a null source is a source. Ties cannot
    arise. Columns of any name pass through (but ``copy``). An empty table
    gives an empty result.
    """
    rates = source_rates(docs, weights, temperature, epochs).select(
        F.col("source").alias("__source"), poisson_steps(F.col("rate")).alias("__steps"))
    own = {name: free_name(docs, name) for name in ("__source", "__steps", "__u", "__n", "__order", "__row", "__own", "__salt")}
    source, steps, u, n, order, row, salt_of, salt = own.values()
    rates = rates.toDF(source, steps)
    rows = docs.drop(copy).withColumn(row, F.monotonically_increasing_id())  # only spreads rows; nothing is found by it
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col(source)))
    else:
        rates = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt_of, F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")).join(
            rates, F.col("source").eqNullSafe(F.col(source)) & (F.col(salt_of) == F.col(salt))).drop(salt_of, salt)
    rows = rows.withColumn(u, uniform(seed)).withColumn(n, F.size(F.filter(steps, lambda p: p <= F.col(u))))
    rows = rows.where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(source, steps, u, n)
    return (rows.withColumn(order, F.xxhash64(F.lit(seed), row, copy)).repartition(F.col(order))
            .sortWithinPartitions(order).drop(order, row))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixture, with the columns of documents and the defined results of ``mix``."""
    copy = free_name(docs, "__copy")
    return mix(docs, copy=copy).drop(copy)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH per AS (SELECT source, sum(coalesce(length(text), 0) + 1) AS mass FROM documents GROUP BY source),
     w AS (SELECT source, mass, pow(mass, {TEMPERATURE}) AS weight FROM per),
     r AS (SELECT source, weight / (SELECT sum(weight) FROM w) * (1.0 * (SELECT sum(mass) FROM w)) / mass AS rate FROM w),
     steps AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
               FROM (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 25) AS BIGINT) + 1)) AS k FROM r)),
     d AS (SELECT *, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / {float(1 << 52)} AS u
           FROM documents),
     n AS (SELECT d.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.p <= d.u) AS copies FROM d)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM n
"""
