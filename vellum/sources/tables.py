"""The library's tables, derived from the driver's parquet tables.

Mapping (fixed, shared with the DuckDB oracle in ``vellum.plans.oracle``):

* document id ``'D'`` and doc_id in eight digits or more, entity = ``source``,
  topic = NULL for English else ``lang``, name ``'doc-' || doc_id``,
  title = the first line, content = ``text``,
  tags from ``labels`` (``quality-<q>``, plus ``toxic``), created/updated at
  2024-01-01 plus ``doc_id`` minutes.
* entities = distinct sources (with documents) and kebab-cased nation names
  (without documents); id ``'ent-' || name``; scope ``knowledge`` when the
  trailing number is even, else ``project``.
* queries: all terms of each ``benchmark`` text.
* changes: the ``events`` table as an ordered change log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import terms

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(doc_id: F.Column) -> F.Column:
    """``D`` and the number, padded to eight digits; longer numbers keep all of theirs."""
    digits = doc_id.cast("string")
    return F.concat(F.lit("D"), F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits))


def label_tags(labels: DataFrame) -> DataFrame:
    """(doc_id, tags) for labelled documents.

    One label row per document (duplicates would resolve to the max). The
    aggregate makes the key visibly unique, so Catalyst drops the left join
    from every plan that never reads ``tags``.
    """
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return labels.select(
        "doc_id",
        F.concat(
            F.array(F.concat(F.lit("quality-"), F.col("quality").cast("string"))),
            F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")),
        ).alias("tags"),
    )


def documents(spark: SparkSession, sf_dir: str, with_tags: bool = True) -> DataFrame:
    """Documents in the library's schema.

    ``with_tags=False`` skips the labels join; jobs that never look at tags
    (tree counts, the title/content part of the index) use it so the text
    column is never shuffled for a join it does not need.
    """
    src = read(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 60)
    base = src.select(
        doc_key(F.col("doc_id")).alias("id"),
        F.concat(F.lit("ent-"), F.col("source")).alias("entity_id"),
        F.col("source").alias("entity"),
        F.when(F.col("lang") == "en", F.lit(None).cast("string")).otherwise(F.col("lang")).alias("topic"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("text").alias("content"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.col("doc_id"),
    )
    if with_tags:
        base = base.join(label_tags(read(spark, sf_dir, "labels")), "doc_id", "left").withColumn(
            "tags", F.coalesce(F.col("tags"), F.array().cast("array<string>")))
    else:
        base = base.withColumn("tags", F.array().cast("array<string>"))
    return base.select("id", "entity_id", "entity", "topic", "name", "title", "content", "tags",
                       "created_at", "updated_at")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = (read(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
               .select("name", F.concat(F.lit("About "), F.col("name")).alias("description"),
                       F.array(F.lit("source")).alias("tags")))
    nations = read(spark, sf_dir, "nation").select(
        F.lower(F.regexp_replace("n_name", "_", "-")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.array().cast("array<string>").alias("tags"))
    both = sources.unionByName(nations)
    num = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    ts = F.timestamp_seconds(F.lit(EPOCH_2024))
    return both.select(
        F.concat(F.lit("ent-"), F.col("name")).alias("id"),
        "name",
        F.when(num % 2 == 0, F.lit("knowledge")).otherwise(F.lit("project")).alias("scope"),
        "description",
        "tags",
        ts.alias("created_at"),
        ts.alias("updated_at"),
    )


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, terms) with all terms of each benchmark text."""
    return read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        terms(F.col("text")).alias("terms"),
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, entity, k): benchmark texts as typed queries.

    Every second one has its first two words joined by a hyphen, every third
    one asks within an entity; k is 3 to 9.
    """
    q, i = read(spark, sf_dir, "benchmark"), F.col("item_id")
    return q.select(
        i.alias("query_id"),
        F.when(i % 2 == 1, F.regexp_replace("text", r"^([^ ]+) ([^ ]+)", "$1-$2")).otherwise(F.col("text")).alias("text"),
        F.when(i % 3 == 0, F.concat(F.lit("src"), (i % 20).cast("string"))).alias("entity"),
        (i % 7 + 3).cast("int").alias("k"))


def or_queries(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Default-operator (OR) queries over the default fields, one clause per term."""
    q = query_terms(spark, sf_dir)
    return q.select("query_id", F.posexplode("terms").alias("clause_no", "term")).select(
        "query_id",
        F.col("clause_no").cast("int"),
        F.lit("should").alias("occur"),
        F.lit("term").alias("kind"),
        F.lit(None).cast("string").alias("field"),
        F.array("term").alias("terms"),
        F.lit(None).cast("int").alias("slop"),
        F.lit(1.0).alias("boost"),
        F.lit(None).cast("string").alias("entity"),
        F.lit(k).alias("k"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as an ordered document change log.

    seq = event_id (the log order (ts, event_id) equals event_id order);
    signup -> save of a new document ``'E' || event_id`` named
    ``'evt-' || (event_id % 500)`` under entity ``'src' || (user_id % 25)``
    (src20..src24 do not exist), topic from ``user_id % 10`` (9 gives an
    invalid segment); click -> new title; view -> new content;
    purchase -> new tags; error -> delete. Targets of update/delete: the
    base document ``event_id % N`` for even ids, else ``'E' || (event_id - 7)``.
    """
    n_docs = read(spark, sf_dir, "documents").count()  # one scalar, the modulus
    ev = read(spark, sf_dir, "events")
    target = F.when(F.col("event_id") % 2 == 0, doc_key(F.col("event_id") % F.lit(n_docs))) \
        .otherwise(F.concat(F.lit("E"), (F.col("event_id") - 7).cast("string")))
    et = F.col("event_type")
    topic = (F.when(F.col("user_id") % 10 == 9, F.lit("Bad_Topic"))
             .when(F.col("user_id") % 10 < 3, F.lit("fr"))
             .when(F.col("user_id") % 10 < 5, F.lit("de")))
    is_save = et == "signup"
    none_s = F.lit(None).cast("string")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(is_save, "save").when(et == "error", "delete").otherwise("update").alias("op"),
        F.when(is_save, F.concat(F.lit("E"), F.col("event_id").cast("string"))).otherwise(target).alias("id"),
        F.when(is_save, F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string"))).otherwise(none_s).alias("entity"),
        F.when(is_save, topic).otherwise(none_s).alias("topic"),
        F.when(is_save, F.concat(F.lit("evt-"), (F.col("event_id") % 500).cast("string"))).otherwise(none_s).alias("name"),
        F.when(is_save | (et == "click"), F.concat(F.lit("Title "), F.col("event_id").cast("string"))).otherwise(none_s).alias("title"),
        F.when(is_save | (et == "view"), F.concat(F.col("props"), F.lit(" "), F.col("value").cast("string"))).otherwise(none_s).alias("content"),
        F.when(is_save, F.array(F.lit("new")))
         .when(et == "purchase", F.array(F.lit("purchase"), F.concat(F.lit("v"), F.floor("value").cast("string"))))
         .otherwise(F.lit(None).cast("array<string>")).alias("tags"),
    )


PLACES = 1 << 20  # query numbers kept free for the places of one text


def benchmark_clauses(spark: SparkSession, sf_dir: str, form: str, k: int = 10) -> DataFrame:
    """Clause tables for the search forms, from all words of each benchmark text.

    Forms whose clauses stand together (field, exact, boost, entity, set,
    range, all) make one query a text, with a clause a word. The others make
    one query a place of the text (``query_id * PLACES + place``), from the
    word there and the ones behind it. A place near the end of a text that
    lacks words for the form gives no query.
    """
    q = query_terms(spark, sf_dir)
    behind = [F.get(F.col("terms"), F.col("place") + i) for i in range(5)]
    w = q.select("query_id", "terms", F.posexplode("terms").alias("place", "t0")).select(
        "query_id", "place", *[x.alias(f"t{i}") for i, x in enumerate(behind)])
    t = [F.col(f"t{i}") for i in range(5)]
    here, place = F.col("query_id") * PLACES + F.col("place"), F.col("place")
    none = F.lit(None).cast("string")

    def c(rows, query, no, kind, terms, occur="should", field=none, slop=None, boost=F.lit(1.0), entity=none):
        return rows.select(
            query.alias("query_id"), no.cast("int").alias("clause_no"), F.lit(occur).alias("occur"),
            F.lit(kind).alias("kind"), field.alias("field"),
            (F.array(*terms).cast("array<string>") if isinstance(terms, list) else terms).alias("terms"),
            F.lit(slop).cast("int").alias("slop"), boost.cast("double").alias("boost"),
            entity.alias("entity"), F.lit(k).alias("k"))

    text, first, second = F.col("query_id"), F.lit(0), F.lit(1)
    if form == "term":
        parts = [c(w, here, first, "term", [t[0]])]
    elif form == "and":
        pairs = w.where(t[1].isNotNull())
        parts = [c(pairs, here, first, "term", [t[0]], "must"), c(pairs, here, second, "term", [t[1]], "must")]
    elif form == "not":
        pairs = w.where(t[1].isNotNull())
        parts = [c(pairs, here, first, "term", [t[0]]), c(pairs, here, second, "term", [t[1]], "must_not")]
    elif form == "phrase":
        parts = [c(w, here, first, "phrase", [t[0], t[1]])]
    elif form == "phrase_slop":
        parts = [c(w, here, first, "phrase", [t[0], t[2], t[4]], slop=2)]
    elif form == "field":
        field = F.when(place % 2 == 0, F.lit("title")).otherwise(F.lit("content"))
        parts = [c(w, text, place, "term", [t[0]], field=field)]
    elif form == "exact":
        parts = [c(q, text, first, "exact", [F.concat(F.lit("doc-"), (text * 7).cast("string"))], field=F.lit("name")),
                 c(w, text, place + 1, "term", [t[0]])]
    elif form == "boost":
        boost = F.when(place % 3 == 0, 2.0).when(place % 3 == 1, 1.0).otherwise(0.5)
        parts = [c(w, text, place, "term", [t[0]], boost=boost)]
    elif form == "entity":
        parts = [c(w, text, place, "term", [t[0]], entity=F.concat(F.lit("src"), (text % 20).cast("string")))]
    elif form == "set":
        parts = [c(q.where(F.size("terms") > 0), text, first, "set", F.col("terms"))]
    elif form == "range":  # between neighbours of the text's words in dictionary order
        words = F.sort_array(F.array_distinct("terms"))
        steps = q.select("query_id", words.alias("ws")).select("query_id", "ws", F.posexplode("ws").alias("place", "t0"))
        parts = [c(steps, text, place, "range", [F.col("t0"), F.get(F.col("ws"), place + 1)])]
    elif form == "prefix":
        parts = [c(w, here, first, "prefix", [F.substring(t[0], 1, 3)])]
    elif form == "phrase_prefix":
        parts = [c(w, here, first, "prefix", [t[0], F.substring(t[1], 1, 2)])]
    elif form == "all":
        parts = [c(q, text, first, "all", []), c(w, text, place + 1, "term", [t[0]])]
    else:
        raise ValueError(form)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.forall("terms", lambda x: x.isNotNull()))


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``conversations`` table as a second corpus: one document per turn,
    entity = role, id ``'C' || conv_id || '-' || turn``."""
    c = read(spark, sf_dir, "conversations")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    ts = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("conv_id") * 60 + F.col("turn"))
    return c.select(
        F.concat(F.lit("C"), key).alias("id"), F.concat(F.lit("ent-"), F.col("role")).alias("entity_id"),
        F.col("role").alias("entity"), F.lit(None).cast("string").alias("topic"),
        F.concat(F.lit("conv-"), key).alias("name"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.coalesce(F.col("text"), F.lit("")).alias("content"),
        F.array().cast("array<string>").alias("tags"), ts.alias("created_at"), ts.alias("updated_at"))
