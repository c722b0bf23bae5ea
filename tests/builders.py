"""Small tables for the tests (a module of its own name: several folders have a conftest)."""

import datetime as dt

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def make_docs(spark, rows):
    """rows: dicts with id, entity, name and optional topic/title/content/tags."""
    from vellum.schema import DOCUMENTS
    full = []
    for r in rows:
        full.append((r["id"], "ent-" + r["entity"], r["entity"], r.get("topic"), r["name"],
                     r.get("title", "Title"), r.get("content", "Content"), r.get("tags", []), T0, T0))
    return spark.createDataFrame(full, DOCUMENTS)


def make_entities(spark, names, scope="knowledge"):
    from vellum.schema import ENTITIES
    return spark.createDataFrame(
        [("ent-" + n, n, scope, f"About {n}", [], T0, T0) for n in names], ENTITIES)
