"""The snippet helper's tokenizer (Python) must agree with the Spark analyzer."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import snippet as sn
from vellum.functions import text as tx

ALPHABET = list("abcXYZ019 ,.-_'\n\téèÜßøΩλЖж中文日本語한국") + ["́", " ", "İ", "ǅ", "²", "Ⅻ"]

texts = st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=1, max_size=40)


def python_terms(text):
    out = []
    for m in sn._TOKEN.finditer(text):
        t = m.group()
        if len(t.encode("utf-8")) < sn._MAX_TOKEN_BYTES:
            out.append(t.lower())
    return out


@settings(max_examples=20, deadline=None)
@given(texts)
def test_python_and_spark_tokens_agree(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, text string")
    got = {r.i: r.t for r in df.select("i", tx.terms(F.col("text")).alias("t")).collect()}
    for i, t in enumerate(batch):
        assert got[i] == python_terms(t), repr(t)
