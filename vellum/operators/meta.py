"""Relational queries over the entity and document tables.

P1 entity by name, P2 document by id, P3 scope check, P6 name availability,
J1 documents with their entity, J2/A1-A5 the entity/topic tree, A6 counts,
O1/O2 orderings. Lookups are batched: a table of keys in, one row per key out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.schema import SCOPES
from vellum.session import bounded_broadcast

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
RFC3339_TEXT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.]\d+)?(Z|[+-]\d\d:\d\d)\z"


def rfc3339(c: Column) -> Column:
    """UTC timestamp as RFC 3339 text (session time zone is UTC).

    The fraction has three or six digits, or is absent when zero.
    """
    return F.regexp_replace(F.date_format(c, RFC3339), "([.]000000|000)Z$", "Z")


def parse_rfc3339(c: Column) -> Column:
    """F7 inverse: RFC 3339 text with any fraction to timestamp (microseconds), NULL when malformed."""
    return F.when(c.rlike(RFC3339_TEXT), F.try_to_timestamp(F.regexp_replace(c, r"([.]\d{6})\d+", "$1")))


def tags_to_json(c: Column) -> Column:
    """tags as JSON array text (the metadata store's encoding)."""
    return F.to_json(c)


def json_to_tags(c: Column) -> Column:
    """F6 inverse: JSON array text to tags; malformed text gives NULL."""
    return F.from_json(c, "array<string>")


def valid_scope(c: Column) -> Column:
    return F.coalesce(c.isin(*SCOPES), F.lit(False))


def list_entities(entities: DataFrame) -> DataFrame:
    """O1: entities in name order."""
    return entities.orderBy("name")


def entities_by_name(entities: DataFrame, keys: DataFrame) -> DataFrame:
    """P1 batched: ``keys(key)`` -> the matching entity or NULLs."""
    return keys.join(entities.withColumnRenamed("name", "key"), "key", "left")


def docs_with_entity(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Documents joined to their entity row (inner: orphans drop out)."""
    ents = bounded_broadcast(entities.select(
        F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), "scope"))
    return docs.join(ents, "entity_id")


def docs_by_id(docs: DataFrame, entities: DataFrame, keys: DataFrame) -> DataFrame:
    """P2 batched: ``keys(key)`` -> the document (with its entity) or NULLs."""
    found = docs_with_entity(docs, entities).withColumnRenamed("id", "key")
    return keys.join(found, "key", "left")


def names_available(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """P6 batched: a name is available when no document holds it."""
    taken = docs.select(F.col("name").alias("candidate")).distinct().withColumn("taken", F.lit(True))
    return candidates.join(taken, "candidate", "left").select(
        "candidate", F.col("taken").isNull().alias("available"))


def tree_counts(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """J2 + A1: document count per (entity, topic); an entity without
    documents gives one row with topic NULL and count 0.

    Documents are aggregated before the join, so only one row per
    (entity, topic) meets the entity table.
    """
    counts = docs.groupBy("entity_id", "topic").agg(F.count("id").alias("document_count"))
    return (entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity"))
            .join(counts, "entity_id", "left")
            .select("entity", "topic",
                    F.coalesce("document_count", F.lit(0)).cast("long").alias("document_count")))


def tree_rollup(counts: DataFrame) -> DataFrame:
    """A2: topic rows and entity totals; ``level`` = grouping_id (0 topic row,
    1 entity total). ``grouping_id`` tells the NULL topic from the subtotal."""
    r = counts.rollup("entity", "topic").agg(
        F.sum("document_count").cast("long").alias("document_count"),
        F.grouping_id().alias("level"))
    return r.where(F.col("level") < 3).select(
        "entity", "topic", F.col("level").cast("long").alias("level"), "document_count")


def tree(counts: DataFrame, depth: int = 2) -> DataFrame:
    """A3/A4: one row per entity: total and its sorted topic children
    (children only when ``depth >= 2``; counts never change with depth)."""
    child = F.when(F.col("topic").isNotNull() & F.lit(depth >= 2),
                   F.struct(F.col("topic").alias("name"), F.col("document_count")))
    return counts.groupBy("entity").agg(
        F.sum("document_count").cast("long").alias("document_count"),
        F.array_sort(F.collect_list(child)).alias("children"))


def tree_for(counts: DataFrame, names: DataFrame, depth: int = 2) -> DataFrame:
    """A5: trees for requested entity names; unknown names get 0 and no children."""
    t = tree(counts.join(names.select(F.col("name").alias("entity")), "entity", "left_semi"), depth)
    return names.select(F.col("name").alias("entity")).join(t, "entity", "left").select(
        "entity", F.coalesce("document_count", F.lit(0)).cast("long").alias("document_count"),
        F.coalesce("children", F.array().cast(t.schema["children"].dataType)).alias("children"))


def tree_text(tree_df: DataFrame) -> DataFrame:
    """the text block per entity (``name/  (N documents)``, topics
    indented two spaces). Blocks joined by newlines in entity order give the
    whole listing; an empty tree gives no rows (empty text)."""
    head = F.format_string("%s/  (%d documents)", F.col("entity"), F.col("document_count"))
    kids = F.transform("children", lambda c: F.format_string(
        "  %s/  (%d documents)", c["name"], c["document_count"]))
    return tree_df.select("entity", F.array_join(F.concat(F.array(head), kids), "\n").alias("text"))


def tree_json(tree_df: DataFrame) -> DataFrame:
    """The tree as JSON, one object per entity."""
    return tree_df.select("entity", F.to_json(F.struct(
        F.col("entity").alias("name"), "document_count",
        F.transform("children", lambda c: F.struct(c["name"].alias("name"), c["document_count"].alias(
            "document_count"), F.array().cast("array<string>").alias("children"))).alias("children")
    )).alias("json"))
