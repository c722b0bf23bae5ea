"""Entity changes in batches (M1-M3): create with similar-name rejection,
patch, delete with cascade to documents and postings.

Create requests are judged in ``seq`` order, as if made one at a time: the
scope must be ``knowledge`` or ``project`` (``invalid_scope``), the name a
valid path segment (``invalid_path``), and no existing or earlier accepted
entity may have a similar name (``similar_entity_exists``, an identical name
scores 1.0 so it is rejected the same way).

Set form: similar pairs are computed once (blocked join). A request similar
to an existing entity is rejected. Identical names: only the first can be
accepted. Among the rest, rounds of joins over the "earlier similar
neighbour" edges: a name with an accepted earlier neighbour is rejected, a
name whose earlier neighbours are all rejected is accepted. Each round's
status table is checkpointed to the shared checkpoint folder, so lineage
stays short and a lost executor recomputes one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.paths import valid_segment
from vellum.operators.fuzzy import similar_pairs
from vellum.operators.meta import valid_scope
from vellum.session import bounded_broadcast, ensure_checkpoint_dir

def _reject(df, reason, detail):
    return df.select("seq", F.lit(reason).alias("reason"), detail.cast("string").alias("detail"))


def create_entities(entities: DataFrame, requests: DataFrame):
    """M1: ``requests(seq, name, scope, description, tags, ts)`` ->
    (new entities table, rejects)."""
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    bad_scope = requests.where(~valid_scope(F.col("scope")))
    r = requests.where(valid_scope(F.col("scope")))
    bad_name = r.where(~valid_segment(F.col("name")))
    r = r.where(valid_segment(F.col("name")))

    existing = entities.select("name")
    vs_existing = similar_pairs(r.select("name").distinct(), existing)
    hit_existing = vs_existing.groupBy(F.col("a").alias("name")).agg(
        F.array_join(F.array_sort(F.collect_list("b")), ",").alias("detail"))
    # Requests with their verdict against existing names, materialised once in
    # the shared checkpoint folder: every step below reads this copy.
    r = r.join(hit_existing, "name", "left").checkpoint()
    rej_existing = r.where(F.col("detail").isNotNull())
    r = r.where(F.col("detail").isNull()).drop("detail")

    # Identical names: the first request stands for the name; later copies
    # are always rejected (the first is accepted, or what rejected it is
    # similar to the copy as well).
    first = r.groupBy("name").agg(F.min("seq").alias("seq"))

    # Earlier-neighbour edges among distinct candidate names.
    pairs = similar_pairs(first.select("name"), first.select("name")).where(F.col("a") != F.col("b"))
    s1 = first.select(F.col("name").alias("a"), F.col("seq").alias("sa"))
    s2 = first.select(F.col("name").alias("b"), F.col("seq").alias("sb"))
    edges = (pairs.join(s1, "a").join(s2, "b").where(F.col("sa") < F.col("sb"))
             .select(F.col("a").alias("u"), F.col("b").alias("v"))).checkpoint()

    status = first.select("name", F.lit("undecided").alias("status")).checkpoint()
    while True:  # each round decides at least the earliest undecided name
        st = status.select(F.col("name").alias("u"), F.col("status").alias("su"))
        per_v = edges.join(st, "u").groupBy(F.col("v").alias("name")).agg(
            F.max((F.col("su") == "accepted").cast("int")).alias("acc"),
            F.max((F.col("su") == "undecided").cast("int")).alias("pending"))
        nxt = status.join(per_v, "name", "left").select(
            "name",
            F.when(F.col("status") != "undecided", F.col("status"))
             .when(F.coalesce("acc", F.lit(0)) == 1, "rejected")
             .when(F.coalesce("pending", F.lit(0)) == 0, "accepted")
             .otherwise("undecided").alias("status")).checkpoint()
        status = nxt
        if status.where(F.col("status") == "undecided").limit(1).count() == 0:
            break

    decided = r.join(status, "name", "left")
    accepted = decided.join(first, ["name", "seq"], "left_semi").where(F.col("status") == "accepted")
    rejected = decided.join(accepted.select("seq"), "seq", "left_anti")
    # Suggestions, as the one-at-a-time rule reports them: the names similar
    # to the request among existing entities and entities accepted earlier.
    acc = accepted.select(F.col("name").alias("b"), F.col("seq").alias("sb"))
    vs_acc = (similar_pairs(rejected.select("name").distinct(), acc.select(F.col("b").alias("name")))
              .join(acc, "b").select(F.col("a").alias("name"), "b", "sb"))
    earlier = (rejected.select("seq", "name").join(vs_acc, "name").where(F.col("sb") < F.col("seq"))
               .select("seq", "b"))
    sugg = (earlier.groupBy("seq").agg(F.collect_list("b").alias("s_new")))
    rej_round = (rejected.join(sugg, "seq", "left")
                 .withColumn("detail", F.array_join(F.array_sort(
                     F.coalesce("s_new", F.array().cast("array<string>"))), ",")))
    rej_existing = rej_existing.select("seq", "name", "detail").join(sugg, "seq", "left").withColumn(
        "detail", F.array_join(F.array_sort(F.concat(
            F.split("detail", ","), F.coalesce("s_new", F.array().cast("array<string>")))), ","))

    new_rows = accepted.select(
        F.concat(F.lit("ent-"), F.col("name")).alias("id"), "name", "scope", "description",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    table = entities.select(*new_rows.columns).unionByName(new_rows)
    rejects = (_reject(bad_scope, "invalid_scope", F.col("scope"))
               .unionByName(_reject(bad_name, "invalid_path", F.col("name")))
               .unionByName(_reject(rej_existing, "similar_entity_exists", F.col("detail")))
               .unionByName(_reject(rej_round, "similar_entity_exists", F.col("detail"))))
    return table, rejects


def update_entities(entities: DataFrame, patches: DataFrame):
    """M2: ``patches(seq, id, scope, description, tags, ts)``; NULL keeps the
    value, tags replace in full, unknown id -> ``not_found``, bad scope ->
    ``invalid_scope`` (the whole patch is refused). Later patches win per
    column."""
    ok_scope = F.col("scope").isNull() | valid_scope(F.col("scope"))
    bad_scope = patches.where(~ok_scope)
    p = patches.where(ok_scope)
    known = bounded_broadcast(entities.select("id"))
    missing = p.join(known, "id", "left_anti")
    p = p.join(known, "id", "left_semi")
    agg = p.groupBy("id").agg(
        F.max_by("scope", F.when(F.col("scope").isNotNull(), F.col("seq"))).alias("p_scope"),
        F.max_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("p_desc"),
        F.max_by("tags", F.when(F.col("tags").isNotNull(), F.col("seq"))).alias("p_tags"),
        F.max("ts").alias("p_ts"))
    out = entities.join(agg, "id", "left").select(
        "id", "name", F.coalesce("p_scope", "scope").alias("scope"),
        F.coalesce("p_desc", "description").alias("description"),
        F.coalesce("p_tags", "tags").alias("tags"), "created_at",
        F.coalesce("p_ts", "updated_at").alias("updated_at"))
    rejects = (_reject(bad_scope, "invalid_scope", F.col("scope"))
               .unionByName(_reject(missing, "not_found", F.col("id"))))
    return out, rejects


def delete_entities(entities: DataFrame, docs: DataFrame, deletes: DataFrame, postings=None):
    """M3: ``deletes(seq, id)``; removes the entities, cascades to their
    documents (and postings when given). Returns (entities, documents,
    postings or None, rejects)."""
    first = deletes.groupBy("id").agg(F.min("seq").alias("seq"))
    known = entities.select("id")
    hit = first.join(known, "id", "left_semi")
    rejects = (_reject(deletes.join(known, "id", "left_anti"), "not_found", F.col("id"))
               .unionByName(_reject(deletes.join(first, ["id", "seq"], "left_anti")
                                    .join(known, "id", "left_semi"), "not_found", F.col("id"))))
    gone = hit.select("id")
    ents = entities.join(gone, "id", "left_anti")
    gone_docs = docs.join(gone.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("id")
    kept_docs = docs.join(gone.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    kept_post = None
    if postings is not None:
        kept_post = postings.join(gone_docs.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    return ents, kept_docs, kept_post, rejects
