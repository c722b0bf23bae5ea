"""Document paths (P4, P5): validation, building and splitting, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a path segment is a non-empty run of lowercase ASCII, digits and '-'.
SEGMENT = r"^[a-z0-9-]+\z"


def valid_segment(c: Column) -> Column:
    return F.coalesce(c.rlike(SEGMENT), F.lit(False))


def valid_path(entity: Column, topic: Column, name: Column) -> Column:
    return valid_segment(entity) & (topic.isNull() | valid_segment(topic)) & valid_segment(name)


def display_path(entity: Column, topic: Column, name: Column) -> Column:
    """``entity[/topic]/name``; ``concat_ws`` skips a NULL topic."""
    return F.concat_ws("/", entity, topic, name)


def fs_path(entity: Column, topic: Column, name: Column) -> Column:
    """Vault-relative file path ``entities/entity[/topic]/name.md``."""
    return F.concat(F.lit("entities/"), display_path(entity, topic, name), F.lit(".md"))


def hit_path(entity: Column, topic: Column) -> Column:
    return F.concat_ws("/", entity, topic)


def split_fs_path(path: Column):
    """Inverse of :func:`fs_path` for a path relative to the vault root (or
    ending in one): returns (entity, topic, name) columns; topic is NULL for
    two-part paths."""
    rel = F.regexp_extract(path, r"(?:^|/)entities/(.+)\.md$", 1)
    parts = F.split(rel, "/")
    n = F.size(parts)
    entity = F.when(n.isin(2, 3), parts[0])
    topic = F.when(n == 3, parts[1])
    name = F.when(n == 2, parts[1]).when(n == 3, parts[2])
    return entity, topic, name
