import datetime as dt
import random

from pyspark.sql import functions as F

from builders import T0, make_docs, make_entities
from vellum.functions.similarity import is_similar, jaro, jaro_winkler
from vellum.operators import entities as en
from vellum.operators import fuzzy as fz


def requests(spark, rows):
    return spark.createDataFrame(
        [(s, n, sc, None, [], T0 + dt.timedelta(seconds=s)) for s, n, sc in rows],
        "seq long, name string, scope string, description string, tags array<string>, ts timestamp")


def test_jaro_winkler_known_values():
    assert abs(jaro_winkler("elastic-search", "elasticsearch") - 0.9857142857142858) < 1e-12
    # jaro 0.4833; the boost applies at any jaro value: 0.4833 + 0.1 * (1 - 0.4833)
    assert abs(jaro_winkler("rust", "redis") - 0.535) < 1e-12
    assert abs(jaro("rust", "redis") - 0.48333333333333334) < 1e-12
    assert is_similar(jaro_winkler("elastic-search", "elasticsearch"))
    assert not is_similar(jaro_winkler("rust", "redis"))


def test_create_similar_rejected(spark):
    ents = make_entities(spark, ["elasticsearch"])
    table, rej = en.create_entities(ents, requests(spark, [
        (1, "elastic-search", "knowledge"), (2, "rust", "knowledge"), (3, "redis", "project"),
        (4, "rust", "project"), (5, "rusty", "knowledge"), (6, "bad name", "knowledge"),
        (7, "fine", "invalid")]))
    names = {r.name for r in table.collect()}
    assert names == {"elasticsearch", "rust", "redis"}
    got = sorted((r.seq, r.reason, r.detail) for r in rej.collect())
    assert got == [(1, "similar_entity_exists", "elasticsearch"), (4, "similar_entity_exists", "rust"),
                   (5, "similar_entity_exists", "rust"), (6, "invalid_path", "bad name"),
                   (7, "invalid_scope", "invalid")]


def test_chain_of_similar_requests(spark):
    # b is similar to a and c, but a and c are not similar to each other:
    # a accepted, b rejected (a accepted earlier), c accepted (its only
    # earlier neighbour b was rejected).
    a, b, c = "abcdefgh", "abcdefgx", "abcdefxx"
    assert is_similar(jaro_winkler(a, b)) and is_similar(jaro_winkler(b, c))
    if is_similar(jaro_winkler(a, c)):
        return  # the premise does not hold for this alphabet; nothing to check
    table, _ = en.create_entities(make_entities(spark, ["zzz"]), requests(spark, [
        (1, a, "knowledge"), (2, b, "knowledge"), (3, c, "knowledge")]))
    assert {r.name for r in table.collect()} == {"zzz", a, c}


def test_blocked_join_equals_brute_force(spark):
    # characters, not bytes: accented letters are single characters here
    rnd = random.Random(7)
    alphabet = "abcdeéñß-12"
    names = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.a, r.b) for r in fz.similar_pairs(df, df).collect()}
    want = {(x, y) for x in names for y in names if is_similar(jaro_winkler(x, y))}
    assert got == want


def test_update_and_delete_cascade(spark):
    ents = make_entities(spark, ["elasticsearch", "rust"])
    patches = spark.createDataFrame(
        [(1, "ent-elasticsearch", "project", "new description", ["new-tag"], T0),
         (2, "ent-nope", None, "x", None, T0), (3, "ent-rust", "bogus", None, None, T0)],
        "seq long, id string, scope string, description string, tags array<string>, ts timestamp")
    out, rej = en.update_entities(ents, patches)
    e = {r.name: r for r in out.collect()}
    assert (e["elasticsearch"].scope, e["elasticsearch"].description, e["elasticsearch"].tags) == \
        ("project", "new description", ["new-tag"])
    assert sorted((r.seq, r.reason) for r in rej.collect()) == [(2, "not_found"), (3, "invalid_scope")]
    docs = make_docs(spark, [dict(id="1", entity="rust", name="a"), dict(id="2", entity="elasticsearch", name="b")])
    dels = spark.createDataFrame([(1, "ent-rust"), (2, "ent-rust"), (3, "ent-nope")], "seq long, id string")
    ents2, docs2, _, rej2 = en.delete_entities(ents, docs, dels)
    assert {r.name for r in ents2.collect()} == {"elasticsearch"}
    assert {r.id for r in docs2.collect()} == {"2"}
    assert sorted((r.seq, r.reason) for r in rej2.collect()) == [(2, "not_found"), (3, "not_found")]
