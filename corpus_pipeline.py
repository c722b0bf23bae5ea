"""A corpus from raw documents to packed sequences; each stage is one operator of ``vellum.llm``.

``STAGES`` are run in order, each result written to the shared folder and
read back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import store, table
from vellum.llm.exact import drop_exact_duplicates
from vellum.llm.mixing import mix_sources
from vellum.llm.packing import pack_stage
from vellum.llm.simhash import drop_near_duplicates
from vellum.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_stage),
]

#: Training a network and packing have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed corpus made from the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
