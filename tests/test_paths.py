from pyspark.sql import functions as F

from vellum.functions import paths as pa


def test_path_rules(spark):
    cases = [
        ("rust", None, "anyhow-vs-thiserror", True, "rust/anyhow-vs-thiserror"),
        ("elasticsearch", "mapping", "nested-dense-vector", True, "elasticsearch/mapping/nested-dense-vector"),
        ("Rust", None, "foo", False, None),
        ("", None, "foo", False, None),
        ("rust", None, "", False, None),
        ("rust", None, "foo_bar", False, None),
        ("rust", None, "foo bar", False, None),
        ("rust", "a/b", "foo", False, None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "entity string, topic string, name string")
    e, t, n = F.col("entity"), F.col("topic"), F.col("name")
    out = df.select(pa.valid_path(e, t, n).alias("ok"), pa.display_path(e, t, n).alias("p"),
                    pa.fs_path(e, t, n).alias("fs")).collect()
    for c, r in zip(cases, out):
        assert r.ok == c[3]
        if c[3]:
            assert r.p == c[4]
            assert r.fs == f"entities/{c[4]}.md"


def test_split_is_inverse(spark):
    df = spark.createDataFrame([("rust", None, "a"), ("es", "mapping", "b")], "entity string, topic string, name string")
    fs = pa.fs_path(F.col("entity"), F.col("topic"), F.col("name"))
    e, t, n = pa.split_fs_path(fs)
    rows = df.select(e.alias("e"), t.alias("t"), n.alias("n")).collect()
    assert [tuple(r) for r in rows] == [("rust", None, "a"), ("es", "mapping", "b")]
