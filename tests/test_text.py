from pyspark.sql import functions as F

from vellum.functions import text as tx


def test_tokens_positions_and_long_tokens(spark):
    long_tok = "x" * 40
    df = spark.createDataFrame([(1, f"Hello, World! {long_tok} error-handling"),], "id int, text string")
    rows = tx.explode_terms(df, "text", ["id"]).orderBy("pos").collect()
    assert [(r.pos, r.term) for r in rows] == [(0, "hello"), (1, "world"), (3, "error"), (4, "handling")]
    assert df.select(tx.field_length(F.col("text"))).first()[0] == 4


def test_non_ascii_and_bytes(spark):
    # 20 two-byte letters = 40 bytes: dropped; 19 of them = 38 bytes: kept
    df = spark.createDataFrame([("é" * 20 + " " + "é" * 19 + " Ünïcode 42",)], "text string")
    assert df.select(tx.terms(F.col("text"))).first()[0] == ["é" * 19, "ünïcode", "42"]


def test_tags_joined_by_space(spark):
    df = spark.createDataFrame([(["error-handling", "rust"],), ([],)], "tags array<string>")
    assert [r[0] for r in df.select(tx.tags_text(F.col("tags"))).collect()] == ["error-handling rust", ""]
