"""Fixed schemas of the tables the library works on."""

from pyspark.sql import types as T

S = T.StringType()
TS = T.TimestampType()
TAGS = T.ArrayType(T.StringType(), containsNull=False)

ENTITIES = T.StructType([
    T.StructField("id", S, False),
    T.StructField("name", S, False),
    T.StructField("scope", S, False),
    T.StructField("description", S, True),
    T.StructField("tags", TAGS, False),
    T.StructField("created_at", TS, False),
    T.StructField("updated_at", TS, False),
])

DOCUMENTS = T.StructType([
    T.StructField("id", S, False),
    T.StructField("entity_id", S, False),
    T.StructField("entity", S, False),
    T.StructField("topic", S, True),
    T.StructField("name", S, False),
    T.StructField("title", S, False),
    T.StructField("content", S, False),
    T.StructField("tags", TAGS, False),
    T.StructField("created_at", TS, False),
    T.StructField("updated_at", TS, False),
])

CHANGES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", TS, False),
    T.StructField("op", S, False),          # save | update | delete
    T.StructField("id", S, True),
    T.StructField("entity", S, True),
    T.StructField("topic", S, True),
    T.StructField("name", S, True),
    T.StructField("title", S, True),
    T.StructField("content", S, True),
    T.StructField("tags", T.ArrayType(S), True),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("clause_no", T.IntegerType(), False),
    T.StructField("occur", S, False),        # should | must | must_not
    T.StructField("field", S, True),         # NULL = default fields
    T.StructField("terms", T.ArrayType(S), False),
    T.StructField("slop", T.IntegerType(), True),
    T.StructField("boost", T.DoubleType(), True),
    T.StructField("entity", S, True),
    T.StructField("k", T.IntegerType(), True),
])

REJECTS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("reason", S, False),
    T.StructField("detail", S, True),
])

# The closed scope domain and the full-text fields.
SCOPES = ("knowledge", "project")
TEXT_FIELDS = ("title", "content", "tags")
RAW_FIELDS = ("id", "entity", "topic", "name")
