from builders import make_docs, make_entities
from vellum.operators import meta as me


def test_tree_counts_direct_and_topics(spark):
    ents = make_entities(spark, ["elasticsearch", "empty"])
    docs = make_docs(spark, [
        dict(id="1", entity="elasticsearch", topic="mapping", name="nested-vector"),
        dict(id="2", entity="elasticsearch", topic="mapping", name="dynamic-templates"),
        dict(id="3", entity="elasticsearch", name="reindex-strategy")])
    counts = me.tree_counts(ents, docs)
    t = {r.entity: r for r in me.tree(counts).collect()}
    assert t["elasticsearch"].document_count == 3
    assert [(c.name, c.document_count) for c in t["elasticsearch"].children] == [("mapping", 2)]
    assert t["empty"].document_count == 0 and t["empty"].children == []
    d1 = {r.entity: r for r in me.tree(counts, depth=1).collect()}
    assert d1["elasticsearch"].document_count == 3 and d1["elasticsearch"].children == []
    roll = {(r.entity, r.topic, r.level): r.document_count for r in me.tree_rollup(counts).collect()}
    assert roll[("elasticsearch", None, 1)] == 3 and roll[("elasticsearch", None, 0)] == 1
    text = {r.entity: r.text for r in me.tree_text(me.tree(counts)).collect()}
    assert text["elasticsearch"] == "elasticsearch/  (3 documents)\n  mapping/  (2 documents)"
    names = spark.createDataFrame([("elasticsearch",), ("nope",)], "name string")
    one = {r.entity: r.document_count for r in me.tree_for(counts, names).collect()}
    assert one == {"elasticsearch": 3, "nope": 0}


def test_empty_tree(spark):
    ents = make_entities(spark, ["x"]).limit(0)
    docs = make_docs(spark, [dict(id="1", entity="x", name="a")]).limit(0)
    assert me.tree_text(me.tree(me.tree_counts(ents, docs))).count() == 0


def test_lookups(spark):
    ents = make_entities(spark, ["elasticsearch"])
    keys = spark.createDataFrame([("elasticsearch",), ("missing",)], "key string")
    got = {r.key: r.id for r in me.entities_by_name(ents, keys).collect()}
    assert got == {"elasticsearch": "ent-elasticsearch", "missing": None}
    docs = make_docs(spark, [dict(id="1", entity="elasticsearch", name="a")])
    cand = spark.createDataFrame([("a",), ("b",)], "candidate string")
    assert {r.candidate: r.available for r in me.names_available(docs, cand).collect()} == {"a": False, "b": True}
