"""Session construction and a few plan-level helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound, in rows, for a side we are willing to broadcast explicitly.
# Anything larger goes through a shuffle join (AQE may still turn it into a
# broadcast at runtime from measured sizes).
BROADCAST_ROW_LIMIT = 2_000_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "vellum") -> SparkSession:
    """A session configured the way the library expects (tests, bench)."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and we only
    read it. Only when it is unset (local tests, the bench) do we pick a
    scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="vellum-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for derived tables under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "tables", name)


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only if it is proven to hold at most ``limit`` rows.

    The check is a bounded count (``limit(limit + 1)``), so it never scans
    more than ``limit + 1`` rows of the small side. Above the bound the frame
    is returned unchanged and Spark plans a shuffle join.
    """
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df
