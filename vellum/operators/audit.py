"""Rules the knowledge base documents, as queries over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A wikilink target runs up to ']', '|' (alias) or '#' (heading);
# audit limits for topic use.
WIKILINK = r"\[\[([^\]|#]+)"
MAX_DOCS_WITHOUT_TOPIC = 7
MIN_DOCS_PER_TOPIC = 3


def wikilink_edges(docs: DataFrame) -> DataFrame:
    """(src_id, src_entity, dst_name) for every ``[[name]]`` in content."""
    return docs.select(F.col("id").alias("src_id"), F.col("entity").alias("src_entity"),
                       F.explode(F.regexp_extract_all("content", F.lit(WIKILINK), 1)).alias("dst_name")) \
        .select("src_id", "src_entity", F.trim("dst_name").alias("dst_name"))


def resolve_links(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges joined to their target by the (vault-unique) name; NULL when broken."""
    t = docs.select(F.col("name").alias("dst_name"), F.col("id").alias("dst_id"),
                    F.col("entity").alias("dst_entity"))
    return edges.join(t, "dst_name", "left")


def backlinks(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Per linked document, backlink count and the number of other
    entities linking to it. Edges are pre-aggregated per (target name,
    source entity) before the join, so a much-linked target is one row per
    source entity, never a per-key list."""
    per = edges.groupBy("dst_name", "src_entity").agg(F.count(F.lit(1)).alias("n"))
    t = docs.select(F.col("name").alias("dst_name"), F.col("id").alias("dst_id"),
                    F.col("entity").alias("dst_entity"))
    j = per.join(t, "dst_name")
    return j.groupBy("dst_id", "dst_name").agg(
        F.sum("n").cast("long").alias("backlinks"),
        F.count(F.when(F.col("src_entity") != F.col("dst_entity"), F.lit(1))).cast("long")
        .alias("foreign_entities"))


def broken_links(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """D3: links whose target name no document holds."""
    return edges.join(docs.select(F.col("name").alias("dst_name")), "dst_name", "left_anti")


def tag_counts(docs: DataFrame) -> DataFrame:
    """Documents and entities per tag. Ids are unique, so a document's
    distinct tags are counted per (tag, entity), then per tag."""
    t = docs.select("entity", F.explode(F.array_distinct("tags")).alias("tag"))
    per = t.groupBy("tag", "entity").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("tag").agg(F.sum("n").alias("n_docs"), F.count("entity").alias("n_entities"))


def docs_with_tag(docs: DataFrame, tag: str) -> DataFrame:
    """Documents carrying ``tag``, across entities."""
    return docs.where(F.array_contains("tags", tag))


def topic_audit(counts: DataFrame) -> DataFrame:
    """D5 from tree counts (entity, topic, document_count): entities with more
    than 7 documents and no topic; topics with at most 2 documents."""
    per_entity = counts.groupBy("entity").agg(
        F.sum("document_count").alias("n"), F.count("topic").alias("n_topics"))
    crowded = per_entity.where((F.col("n") > MAX_DOCS_WITHOUT_TOPIC) & (F.col("n_topics") == 0)).select(
        F.lit("entity_without_topics").alias("finding"), "entity", F.lit(None).cast("string").alias("topic"),
        F.col("n").cast("long").alias("n"))
    thin = counts.where(F.col("topic").isNotNull() & (F.col("document_count") < MIN_DOCS_PER_TOPIC)).select(
        F.lit("thin_topic").alias("finding"), "entity", "topic", F.col("document_count").cast("long").alias("n"))
    return crowded.unionByName(thin)


def tag_path_audit(docs: DataFrame) -> DataFrame:
    """Documents whose tags repeat their entity or topic name."""
    rep = F.filter("tags", lambda t: (t == F.col("entity")) | (t == F.coalesce(F.col("topic"), F.lit(""))))
    return docs.select("id", "entity", "topic", rep.alias("repeated")).where(F.size("repeated") > 0)
