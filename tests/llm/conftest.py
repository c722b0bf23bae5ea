import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, Kept string"


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """A stored documents table from (doc_id, text[, lang, source]) rows, with two extra columns of clashing names."""
    count = [0]

    def build(rows, parts=3):
        full = [(r[0], r[1], (r + ("en", "s0"))[2] if len(r) < 3 else r[2], r[3] if len(r) > 3 else "s0",
                 len(r[1] or ""), "x", "y") for r in rows]
        path = str(tmp_path_factory.mktemp(f"docs{count[0]}") / "documents.parquet")
        count[0] += 1
        spark.createDataFrame(full, DOC_SCHEMA).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return build
