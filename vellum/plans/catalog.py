"""Named queries over the driver tables: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each function reads the given tables (or data Spark derives from them) and
returns a DataFrame whose columns match the SQL of the same name in
``vellum.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import index as ix
from vellum.operators import ranking as rk
from vellum.operators import search as se
from vellum.session import ensure_checkpoint_dir, scratch_path
from vellum.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def corpus_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    return ix.build_index(tb.documents(spark, sf_dir))


def stored_index(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> ix.Index:
    """The index written to the shared scratch folder, laid out by document shards, and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/index-{uuid.uuid4().hex}"
    ix.write_index(tb.documents(spark, sf_dir) if docs is None else docs, path, buckets=8)
    return ix.read_index(spark, path)


@register("search_bm25")
def search_bm25(spark, sf_dir):
    """OR queries of all words of the benchmark texts, top 10 each, ranked with bounds from a stored index."""
    return rk.ranked(stored_index(spark, sf_dir), tb.or_queries(spark, sf_dir))


@register("search_text")
def search_text(spark, sf_dir):
    """Query texts in, ranked hits out: analysis, phrases of hyphenated words, entity filter and limit per query."""
    return rk.search_text(stored_index(spark, sf_dir), tb.text_queries(spark, sf_dir))


# ------------------------------------------------------------------ helpers

from vellum.functions import paths as pa  # noqa: E402
from vellum.operators import changes as chg  # noqa: E402
from vellum.operators import meta as me  # noqa: E402


def _tags(c="tags"):
    return F.array_join(c if not isinstance(c, str) else F.col(c), ",")


def _entity_keys(spark, sf_dir):
    names = tb.entities(spark, sf_dir).select(F.col("name").alias("key"))
    return names.unionByName(names.select(F.concat("key", F.lit("-x")).alias("key")))


def _doc_keys(spark, sf_dir):
    return (tb.changes(spark, sf_dir).where(F.col("op") != "save")
            .select(F.col("id").alias("key")).distinct())


def _entity_requests(spark, sf_dir):
    ev = tb.read(spark, sf_dir, "events")
    scope = (F.when(F.col("event_type") == "click", "knowledge")
             .when(F.col("event_type") == "view", "project")
             .when(F.col("event_type") == "purchase", "Project")
             .otherwise(F.col("event_type")))
    return ev.select(F.col("event_id").alias("seq"),
                     F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"),
                     scope.alias("scope"))


# ------------------------------------------------------------------ metadata

@register("list_entities")
def list_entities(spark, sf_dir):
    e = me.list_entities(tb.entities(spark, sf_dir))
    return e.select("id", "name", "scope", "description", _tags().alias("tags"),
                    me.rfc3339(F.col("created_at")).alias("created_at"))


@register("entity_by_name")
def entity_by_name(spark, sf_dir):
    r = me.entities_by_name(tb.entities(spark, sf_dir), _entity_keys(spark, sf_dir))
    return r.select("key", "id", "scope", "description")


@register("docs_with_entity")
def docs_with_entity(spark, sf_dir):
    r = me.docs_with_entity(tb.documents(spark, sf_dir, with_tags=False), tb.entities(spark, sf_dir))
    return r.select("id", "name", "entity_id", "entity_name", "scope")


@register("doc_by_id")
def doc_by_id(spark, sf_dir):
    r = me.docs_by_id(tb.documents(spark, sf_dir), tb.entities(spark, sf_dir), _doc_keys(spark, sf_dir))
    return r.select("key", "name", "entity", "topic", "title", _tags().alias("tags"), "scope",
                    me.rfc3339(F.col("created_at")).alias("created_at"))


@register("validate_scope")
def validate_scope(spark, sf_dir):
    r = _entity_requests(spark, sf_dir)
    return r.select("seq", "name", "scope", me.valid_scope(F.col("scope")).alias("valid"))


def _path_candidates(spark, sf_dir):
    d = tb.documents(spark, sf_dir, with_tags=False).select("entity", "topic", "name")
    p = tb.read(spark, sf_dir, "part").select(
        F.lower(F.regexp_replace("p_brand", "#", "-")).alias("entity"),
        F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string"))
         .when(F.col("p_size") % 3 == 1, F.lower("p_type")).otherwise(F.col("p_type")).alias("topic"),
        F.when(F.col("p_size") % 2 == 0, F.regexp_replace("p_name", " ", "-"))
         .otherwise(F.col("p_name")).alias("name"))
    return d.unionByName(p)


@register("validate_paths")
def validate_paths(spark, sf_dir):
    c = _path_candidates(spark, sf_dir)
    return c.select("entity", "topic", "name",
                    pa.valid_path(F.col("entity"), F.col("topic"), F.col("name")).alias("valid"),
                    pa.display_path(F.col("entity"), F.col("topic"), F.col("name")).alias("path"))


@register("doc_paths")
def doc_paths(spark, sf_dir):
    d = tb.documents(spark, sf_dir, with_tags=False)
    fs = pa.fs_path(F.col("entity"), F.col("topic"), F.col("name"))
    e, t, n = pa.split_fs_path(fs)
    return d.select("id", fs.alias("fs_path"),
                    pa.display_path(F.col("entity"), F.col("topic"), F.col("name")).alias("display_path"),
                    pa.hit_path(F.col("entity"), F.col("topic")).alias("hit_path"),
                    ((e == F.col("entity")) & F.equal_null(t, F.col("topic")) & (n == F.col("name")))
                    .alias("round_trip"))


@register("name_available")
def name_available(spark, sf_dir):
    ev = tb.read(spark, sf_dir, "events")
    cand = ev.select(F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("candidate")) \
        .unionByName(ev.select(F.concat(F.lit("evt-"), (F.col("event_id") % 500).cast("string")).alias("candidate"))) \
        .distinct()
    return me.names_available(tb.documents(spark, sf_dir, with_tags=False), cand)


def _counts(spark, sf_dir):
    return me.tree_counts(tb.entities(spark, sf_dir), tb.documents(spark, sf_dir, with_tags=False))


def _children_text(c="children"):
    return F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="),
                                                          x["document_count"].cast("string"))), ",")


@register("tree_counts")
def tree_counts(spark, sf_dir):
    return _counts(spark, sf_dir).orderBy(F.asc("entity"), F.asc_nulls_first("topic"))


@register("tree_rollup")
def tree_rollup(spark, sf_dir):
    return me.tree_rollup(_counts(spark, sf_dir))


@register("tree_nested")
def tree_nested(spark, sf_dir):
    t = me.tree(_counts(spark, sf_dir), depth=2)
    return t.select("entity", "document_count", _children_text().alias("children"))


@register("tree_depth1")
def tree_depth1(spark, sf_dir):
    t = me.tree(_counts(spark, sf_dir), depth=1)
    return t.select("entity", "document_count", F.size("children").cast("long").alias("n_children"))


@register("tree_entity")
def tree_entity(spark, sf_dir):
    names = _entity_keys(spark, sf_dir).select(F.col("key").alias("name"))
    t = me.tree_for(_counts(spark, sf_dir), names)
    return t.select("entity", "document_count", _children_text().alias("children"))


@register("tree_text")
def tree_text(spark, sf_dir):
    return me.tree_text(me.tree(_counts(spark, sf_dir)))


@register("tree_json")
def tree_json(spark, sf_dir):
    return me.tree_json(me.tree(_counts(spark, sf_dir)))


@register("rebuild_count")
def rebuild_count(spark, sf_dir):
    """Number of documents indexed by a rebuild."""
    idx = corpus_index(spark, sf_dir)
    return idx.doc_stats.where(F.col("field") == "title").agg(
        F.count(F.lit(1)).alias("n_documents"))


@register("corpus_all")
def corpus_all(spark, sf_dir):
    """Metadata of all documents and a vault that lacks every seventh file: the others with their bodies, ordered."""
    d = tb.documents(spark, sf_dir)
    root = _written_vault(spark, sf_dir, d.where(_number(d) % 7 != 3))
    rows, _ = va.read_corpus(d, va.scan_document_files(spark, root))
    return (rows.select("id", "entity", "topic", "name", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"))
            .orderBy(F.asc("entity"), F.asc_nulls_first("topic"), F.asc("name")))


# ------------------------------------------------------------------ changes

def _apply(spark, sf_dir, fn=chg.apply_changes):
    return fn(tb.documents(spark, sf_dir), tb.entities(spark, sf_dir), tb.changes(spark, sf_dir))


def _doc_out(d):
    return d.select("id", "entity", "topic", "name", "title", F.md5("content").alias("content_md5"),
                    _tags().alias("tags"), me.rfc3339(F.col("created_at")).alias("created_at"),
                    me.rfc3339(F.col("updated_at")).alias("updated_at"))


@register("apply_changes")
def apply_changes(spark, sf_dir):
    return _doc_out(_apply(spark, sf_dir)[0])


@register("apply_changes_rejects")
def apply_changes_rejects(spark, sf_dir):
    return _apply(spark, sf_dir)[1]


@register("save_batch")
def save_batch(spark, sf_dir):
    return _doc_out(_apply(spark, sf_dir, chg.save_batch)[0])


@register("save_batch_rejects")
def save_batch_rejects(spark, sf_dir):
    return _apply(spark, sf_dir, chg.save_batch)[1]


@register("update_batch")
def update_batch(spark, sf_dir):
    return _doc_out(_apply(spark, sf_dir, chg.update_batch)[0])


@register("delete_batch")
def delete_batch(spark, sf_dir):
    return _doc_out(_apply(spark, sf_dir, chg.delete_batch)[0]).select("id", "name")


@register("save_entity_exists")
def save_entity_exists(spark, sf_dir):
    """Saves whose entity exists (semi) and those that do not (anti)."""
    s = tb.changes(spark, sf_dir).where(F.col("op") == "save").select("seq", "entity")
    e = tb.entities(spark, sf_dir).select(F.col("name").alias("entity"))
    ok = s.join(e, "entity", "left_semi").withColumn("exists", F.lit(True))
    bad = s.join(e, "entity", "left_anti").withColumn("exists", F.lit(False))
    return ok.unionByName(bad)


@register("save_name_unique")
def save_name_unique(spark, sf_dir):
    """Saves whose name no current document holds (anti join on name)."""
    s = tb.changes(spark, sf_dir).where(F.col("op") == "save").select("seq", "name")
    d = tb.documents(spark, sf_dir, with_tags=False).select("name")
    return s.join(d, "name", "left_anti").select("seq", "name")


# ------------------------------------------------------------------ search forms

def _search_form(form, k=10):
    def fn(spark, sf_dir):
        return se.search(corpus_index(spark, sf_dir), tb.benchmark_clauses(spark, sf_dir, form, k))
    return fn


for _key, _form, _k in [
    ("search_term", "term", 10),        # X2
    ("search_all_terms", "and", 10),    # X4
    ("search_not", "not", 10),          # X5
    ("search_phrase", "phrase", 10),    # X6
    ("search_phrase_slop", "phrase_slop", 10),
    ("search_field", "field", 10),      # X7
    ("search_exact", "exact", 10),      # X8
    ("search_boost", "boost", 10),      # X9
    ("search_entity_filter", "entity", 10),  # X11 / P7
    ("search_term_set", "set", 10),     # X15
    ("search_term_range", "range", 10),
    ("search_prefix", "prefix", 10),
    ("search_phrase_prefix", "phrase_prefix", 10),
    ("search_all", "all", 10),          # X14
]:
    register(_key)(_search_form(_form, _k))


@register("search_topk")
def search_topk(spark, sf_dir):
    """Per-query top-k (k = 3) from a stored index."""
    return rk.ranked(stored_index(spark, sf_dir), tb.or_queries(spark, sf_dir, k=3))


@register("search_single")
def search_single(spark, sf_dir):
    """O3: one query made of all terms of all benchmark texts; global top 10."""
    q = (tb.query_terms(spark, sf_dir).select(F.explode("terms").alias("term")).distinct()
         .select(F.lit(0).alias("query_id"), F.pmod(F.xxhash64("term"), F.lit(2147483647)).cast("int").alias("clause_no"),
                 F.array("term").alias("terms")))
    matched = se.match(corpus_index(spark, sf_dir), q)
    return se.single_top_k(matched, 10)


# ------------------------------------------------------------------ hits and snippets

from vellum.operators import snippet as sn  # noqa: E402


def _ranked(spark, sf_dir):
    """The document store, the stored index, the queries and their ranked hits."""
    idx = stored_index(spark, sf_dir)
    sn.write_documents(tb.documents(spark, sf_dir), idx.path)
    clauses = tb.or_queries(spark, sf_dir)
    return sn.read_documents(spark, idx.path), idx, clauses, rk.ranked(idx, clauses)


@register("search_hits")
def search_hits(spark, sf_dir):
    docs, _, _, ranked = _ranked(spark, sf_dir)
    h = sn.hits(ranked, docs)
    return h.select("query_id", "rank", "doc_id", "entity", "topic", "name", "title",
                    _tags().alias("tags"), "score")


@register("search_snippets")
def search_snippets(spark, sf_dir):
    docs, idx, clauses, ranked = _ranked(spark, sf_dir)
    s = sn.with_snippets(ranked, docs, idx, clauses)
    return s.select("query_id", "rank", "doc_id", F.array_join("snippets", "\n").alias("snippet"))


def _whole_hits(spark, sf_dir):
    docs, idx, clauses, ranked = _ranked(spark, sf_dir)
    return sn.whole_hits(ranked, docs, idx, clauses)


@register("search_hits_full")
def search_hits_full(spark, sf_dir):
    """The whole hit in one row: stored fields, snippets and a numeric score."""
    h = _whole_hits(spark, sf_dir)
    return h.select("query_id", "rank", "id", "entity", "topic", "name", "title", _tags().alias("tags"),
                    F.array_join("snippets", "\n").alias("snippets"), F.size("snippets").cast("long").alias("n_snippets"), "score")


@register("hits_json")
def hits_json(spark, sf_dir):
    return sn.hits_json(_whole_hits(spark, sf_dir))


@register("hits_text")
def hits_text(spark, sf_dir):
    return sn.hit_text(_whole_hits(spark, sf_dir))


# ------------------------------------------------------------------ index tables and maintenance

from vellum.functions import text as tx  # noqa: E402


@register("tokenize_docs")
def tokenize_docs(spark, sf_dir):
    """Every indexed token with its position."""
    f = ix.field_texts(tb.documents(spark, sf_dir))
    return tx.explode_terms(f, "text", ["doc_id", "field"]).select(
        "doc_id", "field", F.col("pos").cast("long").alias("pos"), "term")


@register("postings")
def postings(spark, sf_dir):
    """Postings of the analysed fields."""
    return _posting_rows(corpus_index(spark, sf_dir))


@register("term_stats")
def term_stats(spark, sf_dir):
    """Document frequency per analysed (field, term)."""
    t = corpus_index(spark, sf_dir).term_stats
    return t.where(F.col("field").isin("title", "content", "tags"))


@register("corpus_stats")
def corpus_stats(spark, sf_dir):
    """Documents and average field length per text field."""
    c = corpus_index(spark, sf_dir).corpus
    return c.select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def _changed(base, final):
    """Rows of ``final`` that are new or changed: every accepted change
    stamps ``updated_at``, so key + ``updated_at`` identifies a version."""
    b = base.select("id", F.col("updated_at").alias("b_updated"))
    return (final.join(b, "id", "left")
            .where(F.col("b_updated").isNull() | (F.col("updated_at") != F.col("b_updated")))
            .drop("b_updated"))


def _posting_rows(idx):
    """Every stored posting of the analysed fields, with its places."""
    p = idx.postings.where(F.col("field").isin("title", "content", "tags"))
    return p.select("field", "term", "doc_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"),
                    F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


def _maintained_index(spark, sf_dir):
    """M7 + M8 on the stored base index with the log's effect: upsert every
    document the log created or changed, remove every document it deleted."""
    base = tb.documents(spark, sf_dir)
    final, _ = chg.apply_changes(base, tb.entities(spark, sf_dir), tb.changes(spark, sf_dir))
    path = stored_index(spark, sf_dir).path
    ix.upsert_stored(spark, path, _changed(base, final))
    return ix.remove_stored(spark, path, base.select("id").join(final.select("id"), "id", "left_anti"))


def _removed_index(spark, sf_dir):
    """M8 on the stored base index: without the documents deleted by the log."""
    base = tb.documents(spark, sf_dir)
    final, _ = chg.delete_batch(base, tb.entities(spark, sf_dir), tb.changes(spark, sf_dir))
    gone = base.select("id").join(final.select("id"), "id", "left_anti")
    return ix.remove_stored(spark, stored_index(spark, sf_dir).path, gone)


def _rebuilt_index(spark, sf_dir):
    """The stored base index replaced by one of the final table."""
    final, _ = _apply(spark, sf_dir)
    path = stored_index(spark, sf_dir).path
    ix.write_index(final, path, buckets=8)
    return ix.read_index(spark, path)


def _corpus_rows(idx):
    return idx.corpus.select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def _df_rows(idx):
    return idx.term_stats.where(F.col("field").isin("title", "content", "tags")).select("field", "term", "df")


for _key, _of in [("index_upsert", _maintained_index), ("index_remove", _removed_index), ("index_rebuild", _rebuilt_index)]:
    register(_key)(lambda spark, sf_dir, of=_of: _posting_rows(of(spark, sf_dir)))
    register(f"{_key}_terms")(lambda spark, sf_dir, of=_of: _df_rows(of(spark, sf_dir)))
    register(f"{_key}_corpus")(lambda spark, sf_dir, of=_of: _corpus_rows(of(spark, sf_dir)))


@register("docs_upsert")
def docs_upsert(spark, sf_dir):
    """Base documents replaced by key with the saved/updated versions."""
    base = tb.documents(spark, sf_dir)
    final, _ = _apply(spark, sf_dir)
    changed = _changed(base, final)
    up = base.join(changed.select("id"), "id", "left_anti").unionByName(changed)
    return up.select("id", "name", F.md5("content").alias("content_md5"), "title")


# ------------------------------------------------------------------ entities and fuzzy names

from vellum.operators import entities as en  # noqa: E402
from vellum.operators import fuzzy as fz  # noqa: E402


def _entity_create_requests(spark, sf_dir):
    p = tb.read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    name = (F.when(key % 11 == 0, F.col("p_name"))
            .when(key % 3 == 0, F.concat(F.lit("nation-"), F.col("p_size").cast("string")))
            .otherwise(F.lower(F.regexp_replace("p_name", " ", "-"))))
    scope = F.when(key % 7 == 0, "team").when(key % 2 == 0, "knowledge").otherwise("project")
    return p.select(key.alias("seq"), name.alias("name"), scope.alias("scope"),
                    F.col("p_type").alias("description"), F.array(F.lower("p_brand")).alias("tags"),
                    F.timestamp_seconds(F.lit(tb.EPOCH_2024) + key).alias("ts"))


@register("similar_entities")
def similar_entities(spark, sf_dir):
    """Requested names with their similar existing entity names."""
    new = _entity_create_requests(spark, sf_dir).select("name").distinct()
    s = fz.suggestions(new, tb.entities(spark, sf_dir).select("name"))
    return s.select("name", F.array_join("suggestions", ",").alias("suggestions"))


def _created(spark, sf_dir):
    return en.create_entities(tb.entities(spark, sf_dir), _entity_create_requests(spark, sf_dir))


@register("create_entities")
def create_entities(spark, sf_dir):
    t, _ = _created(spark, sf_dir)
    return t.select("id", "name", "scope", "description", _tags().alias("tags"),
                    me.rfc3339(F.col("created_at")).alias("created_at"))


@register("create_entities_rejects")
def create_entities_rejects(spark, sf_dir):
    return _created(spark, sf_dir)[1]


def _entity_patches(spark, sf_dir):
    ev = tb.read(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("ent-src"), (F.col("user_id") % 25).cast("string")).alias("id"),
        F.when(F.col("value") > 40, "project").when(F.col("value") > 35, "Knowledge").alias("scope"),
        F.concat(F.lit("Purchase "), F.col("event_id").cast("string")).alias("description"),
        F.when(F.col("value") > 45, F.array(F.lit("vip"))).alias("tags"),
        F.col("ts").cast("timestamp").alias("ts"))


@register("update_entities")
def update_entities(spark, sf_dir):
    t, _ = en.update_entities(tb.entities(spark, sf_dir), _entity_patches(spark, sf_dir))
    return t.select("id", "name", "scope", "description", _tags().alias("tags"),
                    me.rfc3339(F.col("updated_at")).alias("updated_at"))


@register("update_entities_rejects")
def update_entities_rejects(spark, sf_dir):
    return en.update_entities(tb.entities(spark, sf_dir), _entity_patches(spark, sf_dir))[1]


def _entity_deletes(spark, sf_dir):
    ev = tb.read(spark, sf_dir, "events").where(F.col("event_type") == "error")
    n = (F.col("user_id") % 40).cast("string")
    return ev.select(F.col("event_id").alias("seq"),
                     F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("ent-src"), n))
                      .otherwise(F.concat(F.lit("ent-nation-"), n)).alias("id"))


def _deleted(spark, sf_dir):
    docs = tb.documents(spark, sf_dir)
    return en.delete_entities(tb.entities(spark, sf_dir), docs, _entity_deletes(spark, sf_dir),
                              ix.build_index(docs).postings)


@register("delete_entities")
def delete_entities(spark, sf_dir):
    return _deleted(spark, sf_dir)[0].select("id", "name")


@register("delete_entities_docs")
def delete_entities_docs(spark, sf_dir):
    """M3 cascade: documents (and their postings) of deleted entities go."""
    _, docs, post, _ = _deleted(spark, sf_dir)
    n_post = post.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_postings"))
    return docs.select("id", "entity").join(n_post.withColumnRenamed("doc_id", "id"), "id", "left")


@register("delete_entities_rejects")
def delete_entities_rejects(spark, sf_dir):
    return _deleted(spark, sf_dir)[3]


# ------------------------------------------------------------------ vault

import os  # noqa: E402

from vellum.sources import vault as va  # noqa: E402


def _doc_rows(d):
    return d.select("id", "entity", "topic", "name", "title", _tags().alias("tags"),
                    me.rfc3339(F.col("created_at")).alias("created_at"),
                    me.rfc3339(F.col("updated_at")).alias("updated_at"),
                    F.md5("content").alias("content_md5"))


def _written_vault(spark, sf_dir, docs=None):
    root = scratch_path(spark, f"vault-{uuid.uuid4().hex}")
    docs = tb.documents(spark, sf_dir) if docs is None else docs
    va.write_vault(va.render_entities(tb.entities(spark, sf_dir)).unionByName(va.render_documents(docs)), root)
    return root


def _number(docs):
    return F.regexp_extract(docs["name"], r"(\d+)$", 1).cast("long")


def _broken_files(spark, sf_dir):
    """Files of all documents, most of them broken in one of eleven ways by the document's number."""
    docs = tb.documents(spark, sf_dir)
    files = va.render_documents(docs).withColumn("way", F.regexp_extract("path", r"-(\d+)\.md$", 1).cast("long") % 12)
    text, way = F.col("text"), F.col("way")
    broken = (F.when(way == 1, F.regexp_replace(text, r"^---\n", ""))
              .when(way == 2, F.concat(F.substring_index(text, "\ncreated_at", 1), F.lit("\n")))
              .when(way == 3, F.regexp_replace(text, r"(?m)^created_at: .*$", "created_at: 2024-13-45T00:00:00Z"))
              .when(way == 4, F.regexp_replace(text, r"(?m)^title: .*\n", ""))
              .when(way == 5, F.regexp_replace(text, r"(?m)^title: .*$", "title: 12.5"))
              .when(way == 6, F.regexp_replace(F.regexp_replace(text, r"(?m)^tags:\n(- .*\n)+", ""), r"(?m)^updated_at: ", "tags: loose\nupdated_at: "))
              .when(way == 7, F.regexp_replace(text, r"(?m)^id: (.*)$", "id: $1\nid: $1"))
              .when(way == 8, F.regexp_replace(text, r'(?m)^title: .*$', 'title: "open'))
              .otherwise(text))
    path = (F.when(way == 9, F.regexp_replace("path", "/doc-", "/Doc_")).when(way == 10, F.regexp_replace("path", "^entities/", "entities/x"))
            .otherwise(F.col("path")))
    return files.select(path.alias("path"), broken.alias("text"))


@register("vault_rejects")
def vault_rejects(spark, sf_dir):
    """A vault of broken files scanned: every error a reject row with its reason."""
    root = scratch_path(spark, f"vault-{uuid.uuid4().hex}")
    va.write_vault(va.render_entities(tb.entities(spark, sf_dir)).unionByName(_broken_files(spark, sf_dir)), root)
    return va.scan_vault(spark, root)[2]


@register("render_vault")
def render_vault(spark, sf_dir):
    """Markdown files of every entity and document."""
    r = va.render_entities(tb.entities(spark, sf_dir)).unionByName(
        va.render_documents(tb.documents(spark, sf_dir)))
    return r.select("path", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@register("parse_frontmatter")
def parse_frontmatter(spark, sf_dir):
    """S3: rendered files parsed back (round trip equals the table)."""
    files = va.render_documents(tb.documents(spark, sf_dir))
    return _doc_rows(va.parse_documents(files).where(F.col("status") == "ok"))


@register("scan_vault_documents")
def scan_vault_documents(spark, sf_dir):
    """The vault written to the shared scratch folder, scanned back."""
    root = _written_vault(spark, sf_dir)
    _, docs, _ = va.scan_vault(spark, root)
    return _doc_rows(docs)


@register("scan_vault_entities")
def scan_vault_entities(spark, sf_dir):
    """``_entity.md`` files read through the entity-file data source."""
    root = _written_vault(spark, sf_dir)
    ents, _, _ = va.scan_vault(spark, root)
    return ents.select("id", "name", "scope", "description", _tags().alias("tags"),
                       me.rfc3339(F.col("created_at")).alias("created_at"))


@register("rebuild_metadata")
def rebuild_metadata(spark, sf_dir):
    """Both tables rebuilt from the vault files; row counts."""
    root = _written_vault(spark, sf_dir)
    return va.rebuild_metadata(spark, root, root + "-tables")


@register("vault_orphans")
def vault_orphans(spark, sf_dir):
    """Metadata after the change log versus files of the base vault."""
    final, _ = _apply(spark, sf_dir)
    root = _written_vault(spark, sf_dir)
    return va.orphans(final, va.scan_document_files(spark, root))


# ------------------------------------------------------------------ audits

from vellum.operators import audit as au  # noqa: E402


def _linked_docs(spark, sf_dir):
    """Documents whose content ends with wikilinks derived from the doc id:
    one plain link, one with an alias, one with a heading to a name that
    does not exist (ids beyond the corpus)."""
    n = tb.read(spark, sf_dir, "documents").count()  # one scalar, the modulus
    num = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    links = F.concat(
        F.lit("\nSee [[doc-"), ((num * 7 + 3) % n).cast("string"), F.lit("]] and [[doc-"),
        ((num * 13 + 5) % n).cast("string"), F.lit("|see also]] and [[doc-"),
        (num + n).cast("string"), F.lit("#intro]]."))
    return tb.documents(spark, sf_dir).withColumn("content", F.concat("content", links))


@register("wikilink_edges")
def wikilink_edges(spark, sf_dir):
    return au.wikilink_edges(_linked_docs(spark, sf_dir))


@register("backlinks")
def backlinks(spark, sf_dir):
    d = _linked_docs(spark, sf_dir)
    return au.backlinks(au.wikilink_edges(d), d)


@register("broken_links")
def broken_links(spark, sf_dir):
    d = _linked_docs(spark, sf_dir)
    return au.broken_links(au.wikilink_edges(d), d).select("src_id", "dst_name")


@register("docs_by_tag")
def docs_by_tag(spark, sf_dir):
    return au.tag_counts(tb.documents(spark, sf_dir))


@register("docs_tagged_toxic")
def docs_tagged_toxic(spark, sf_dir):
    return au.docs_with_tag(tb.documents(spark, sf_dir), "toxic").select("id", "entity", "topic")


@register("topic_audit")
def topic_audit(spark, sf_dir):
    return au.topic_audit(_counts(spark, sf_dir))


@register("tag_path_audit")
def tag_path_audit(spark, sf_dir):
    """D6 over documents tagged with their language as well."""
    d = tb.documents(spark, sf_dir).join(
        tb.read(spark, sf_dir, "documents").select(tb.doc_key(F.col("doc_id")).alias("id"), "lang"), "id")
    d = d.withColumn("tags", F.concat("tags", F.array("lang")))
    return au.tag_path_audit(d).select("id", "entity", "topic", F.array_join("repeated", ",").alias("repeated"))


# ------------------------------------------------------------------ streams

from vellum.streaming import streams as st  # noqa: E402


@register("stream_apply_changes")
def stream_apply_changes(spark, sf_dir):
    """The change log replayed as a file stream in four segments; the
    final snapshot equals the batch result (``apply_changes``)."""
    root = scratch_path(spark, f"stream-changes-{uuid.uuid4().hex}")
    src = os.path.join(root, "source")
    files = spark.sparkContext.defaultParallelism
    st.write_in_order(tb.changes(spark, sf_dir), src, "seq", 4, files)
    q = st.start_change_stream(spark, src, root, tb.documents(spark, sf_dir), tb.entities(spark, sf_dir), files)
    q.awaitTermination()
    return _doc_out(st.latest_snapshot(spark, root))


@register("stream_index")
def stream_index(spark, sf_dir):
    """Base documents in four segments, then the versions changed by the
    change log; the live index equals a build over the upserted table."""
    root = scratch_path(spark, f"stream-index-{uuid.uuid4().hex}")
    src = os.path.join(root, "source")
    base = tb.documents(spark, sf_dir).withColumn("version", F.xxhash64("id"))
    final, _ = _apply(spark, sf_dir)
    changed = _changed(tb.documents(spark, sf_dir), final).withColumn("version", F.lit(None).cast("long"))
    st.write_in_order(base, src, "version", 4)
    changed.coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    q = st.start_index_stream(spark, src, os.path.join(root, "index"), schema)
    q.awaitTermination()
    t = st.read_stream_index(spark, os.path.join(root, "index")).term_stats
    return t.where(F.col("field").isin("title", "content", "tags"))



# ------------------------------------------------------------------ JSON and second corpus

@register("entry_json")
def entry_json(spark, sf_dir):
    """Each document as the JSON entry a lookup returns."""
    d = tb.documents(spark, sf_dir)
    return d.select("id", F.to_json(F.struct(
        "id", "entity", "topic", "name", "title", "content", "tags",
        me.rfc3339(F.col("created_at")).alias("created_at"),
        me.rfc3339(F.col("updated_at")).alias("updated_at")), {"ignoreNullFields": "false"}).alias("json"),
        me.tags_to_json(F.col("tags")).alias("tags_json"))


@register("tags_json_round_trip")
def tags_json_round_trip(spark, sf_dir):
    """tags -> JSON text -> tags is the identity."""
    d = tb.documents(spark, sf_dir).select("id", "tags")
    back = me.json_to_tags(me.tags_to_json(F.col("tags")))
    return d.select("id", F.array_join(back, ",").alias("tags"),
                    (F.array_join(back, "\u0001") == F.array_join("tags", "\u0001")).alias("same"))


@register("search_conversations")
def search_conversations(spark, sf_dir):
    """X16 over a second corpus: the benchmark queries against conversation turns."""
    return se.search(ix.build_index(tb.conversation_documents(spark, sf_dir)), tb.or_queries(spark, sf_dir))



@register("entities_json")
def entities_json(spark, sf_dir):
    """The entity list as JSON objects, in name order."""
    e = me.list_entities(tb.entities(spark, sf_dir))
    return e.select("name", F.to_json(F.struct(
        "id", "name", "scope", "description", "tags",
        me.rfc3339(F.col("created_at")).alias("created_at"),
        me.rfc3339(F.col("updated_at")).alias("updated_at")), {"ignoreNullFields": "false"}).alias("json"))
