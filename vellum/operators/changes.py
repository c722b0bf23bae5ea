"""Applying batches of document changes (M4-M6, M10, W2) as set operations.

Input: the current ``documents``, the ``entities`` and a change log
(``vellum.schema.CHANGES``) ordered by ``seq``. Output: the new documents
table and a ``rejects`` table (seq, reason, detail), equal to applying the
changes one by one in ``seq`` order:

* save: entity must exist (``not_found``), the name must not be held by a
  live document (``duplicate_name``), the path must be valid
  (``invalid_path``); created = updated = the change time.
* update: the id must be live (``not_found``); non-null fields replace.
* delete: the id must be live (``not_found``); its name becomes free.

Every id lives in one interval [birth, death): base documents from the
start, saved ones from their accepted save; death is the first delete after
birth. Updates and deletes are then judged by joins against that interval.
Only the acceptance of saves is order-dependent (a name is free again after
its holder dies): names whose holders never die are decided by aggregates
alone; for the others the accepted saves form a chain (next valid save at or
after the current holder's death), found with blocked as-of lookups and
pointer doubling, so no name's history is collected into one task.
Save ids are fresh (never reused), as generated ids are.

Lifetimes and names are worked out on (id, name) alone. The documents that
the log touches are then taken out of the table by their ids; all others are
passed on as they are read, and their content is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.paths import valid_path
from vellum.operators.index import _staged
from vellum.operators.ordered import next_at_or_after, path_marks
from vellum.session import bounded_broadcast, ensure_checkpoint_dir

NEVER = 2**62  # death of a document that is never deleted
DOC_COLS = ["id", "entity_id", "entity", "topic", "name", "title", "content", "tags",
            "created_at", "updated_at"]


def _reject(df: DataFrame, reason: str, detail) -> DataFrame:
    return df.select("seq", F.lit(reason).alias("reason"), detail.cast("string").alias("detail"))


def _save_decisions(base: DataFrame, saves: DataFrame) -> DataFrame:
    """For saves with an existing entity: (seq, status) with status
    accepted | duplicate_name | invalid_path."""
    holder0 = base.select("name", F.col("death").alias("d0"))
    s = saves.select("seq", "name", "death", "path_ok")
    finite = s.where(F.col("death") < NEVER).select("name").distinct().withColumn("fold", F.lit(True))
    s = s.join(holder0, "name", "left").join(finite, "name", "left")
    d0 = F.coalesce(F.col("d0"), F.lit(-1))

    # Names whose saved holders never die: the first valid save at or after
    # the base holder's death takes the name for good.
    simple = s.where(F.col("fold").isNull())
    first_ok = (simple.where(F.col("path_ok") & (F.col("seq") >= d0))
                .groupBy("name").agg(F.min("seq").alias("winner")))
    simple = simple.join(first_ok, "name", "left").select(
        "seq",
        F.when(F.col("seq") < d0, "duplicate_name")
         .when(F.col("seq") == F.col("winner"), "accepted")
         .when(F.col("winner").isNotNull() & (F.col("seq") > F.col("winner")), "duplicate_name")
         .when(~F.col("path_ok"), "invalid_path")
         .otherwise("duplicate_name").alias("status"))

    # Names whose holders may die. Accepted saves form a chain: the first
    # valid save at or after the base holder's death, then the first valid
    # save at or after each accepted save's death. Found with as-of lookups
    # and pointer doubling (no per-name collection).
    # The fold-tier saves (a few numbers each) are materialised once in the
    # shared checkpoint folder; the rounds below all read that copy.
    f = _staged(s.where(F.col("fold")).withColumn("d0", d0))
    ok = f.where(F.col("path_ok"))
    targets = ok.select(F.col("name").alias("key"), F.col("seq").alias("pos"))
    start_probes = f.select(F.concat(F.lit("s:"), F.col("name")).alias("pid"),
                            F.col("name").alias("key"), F.col("d0").alias("at")).distinct()
    succ_probes = ok.where(F.col("death") < NEVER).select(
        F.concat(F.lit("d:"), F.col("seq").cast("string")).alias("pid"),
        F.col("name").alias("key"), F.col("death").alias("at"))
    hits = _staged(next_at_or_after(start_probes.unionByName(succ_probes), targets))
    starts = hits.where(F.col("pid").startswith("s:") & F.col("hit").isNotNull()).select(
        F.col("hit").alias("node"))
    succ = hits.where(F.col("pid").startswith("d:")).select(
        F.substring("pid", 3, 30).cast("long").alias("node"), F.col("hit").alias("nxt"))
    accepted = path_marks(starts, succ).select(F.col("node").alias("seq"), F.lit(True).alias("acc"))
    # ``path_marks`` returns a stored frame
    # Holder at each save: death of the last accepted save before it, else d0
    # (as-of on negated positions).
    acc_rows = f.join(accepted, "seq").select("name", "seq", "death")
    back = next_at_or_after(
        f.select(F.col("seq").alias("pid"), F.col("name").alias("key"), (-F.col("seq") + 1).alias("at")),
        acc_rows.select(F.col("name").alias("key"), (-F.col("seq")).alias("pos")))
    prev = back.select(F.col("pid").alias("seq"), (-F.col("hit")).alias("prev_seq"))
    prev = prev.join(acc_rows.select(F.col("seq").alias("prev_seq"), F.col("death").alias("prev_death")),
                     "prev_seq", "left")
    g = f.join(accepted, "seq", "left").join(prev, "seq", "left")
    h = F.coalesce(F.col("prev_death"), F.col("d0"))
    folded = g.select(
        "seq",
        F.when(F.col("acc").isNotNull(), "accepted")
         .when(F.col("seq") < h, "duplicate_name")
         .when(~F.col("path_ok"), "invalid_path")
         .otherwise("duplicate_name").alias("status"))
    return simple.unionByName(folded)


def apply_changes(docs: DataFrame, entities: DataFrame, changes: DataFrame, delta: bool = False, names: DataFrame | None = None):
    """Returns (new_documents, rejects). ``names``: (id, name) of ``docs``, where they are at hand."""
    ensure_checkpoint_dir(changes.sparkSession)
    ch = changes
    deletes = ch.where(F.col("op") == "delete").select("seq", "id")
    updates = ch.where(F.col("op") == "update")
    saves = ch.where(F.col("op") == "save")

    # Lifetimes of base documents.
    base_death = deletes.groupBy("id").agg(F.min("seq").alias("death"))
    names = docs.select("id", "name") if names is None else names
    base = (names.join(base_death, "id", "left")
            .withColumn("birth", F.lit(-1).cast("long"))
            .withColumn("death", F.coalesce("death", F.lit(NEVER)).cast("long")))

    # Saves: entity check, then path check and the per-name fold.
    ents = bounded_broadcast(entities.select(F.col("name").alias("entity"),
                                             F.col("id").alias("entity_id")))
    s = saves.join(ents, "entity", "left")
    no_entity = s.where(F.col("entity_id").isNull())
    s = s.where(F.col("entity_id").isNotNull()).withColumn(
        "path_ok", valid_path(F.col("entity"), F.col("topic"), F.col("name")))
    later_del = (s.select("id", F.col("seq").alias("born")).join(deletes, "id")
                 .where(F.col("seq") > F.col("born")).groupBy("id").agg(F.min("seq").alias("death")))
    # The decision inputs are a few narrow columns per save: materialise them
    # once in the shared checkpoint folder so the steps below share one copy.
    narrow = _staged(s.select("seq", "id", "name", "path_ok").join(later_del, "id", "left")
                     .withColumn("death", F.coalesce("death", F.lit(NEVER)).cast("long")))
    status = _staged(narrow.join(_save_decisions(base, narrow), "seq"))
    accepted = s.join(status.where(F.col("status") == "accepted").select("seq", "death"), "seq")
    save_rejects = status.where(F.col("status") != "accepted").select(
        "seq", F.col("status").alias("reason"), F.col("name").alias("detail"))
    new_docs = accepted.select(
        "id", "entity_id", "entity", "topic", "name",
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.col("seq").alias("birth"), "death")

    span = _staged(base.select("id", "birth", "death").unionByName(new_docs.select("id", "birth", "death")))

    # Deletes and updates are valid inside the target's lifetime.
    d = deletes.join(span, "id", "left")
    d_ok = (F.col("birth") < F.col("seq")) & (F.col("seq") == F.col("death"))
    u = updates.join(span, "id", "left")
    u_ok = (F.col("birth") < F.col("seq")) & (F.col("seq") < F.col("death"))
    good_u = u.where(u_ok)
    patch = good_u.groupBy("id").agg(
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("p_title"),
        F.max_by("content", F.when(F.col("content").isNotNull(), F.col("seq"))).alias("p_content"),
        F.max_by("tags", F.when(F.col("tags").isNotNull(), F.col("seq"))).alias("p_tags"),
        F.max("ts").alias("p_ts"))

    deleted = base.where(F.col("death") < NEVER).select("id")

    def apply_patch(rows: DataFrame, p: DataFrame, how: str) -> DataFrame:
        return rows.join(p, "id", how).select(
            "id", "entity_id", "entity", "topic", "name",
            F.coalesce("p_title", "title").alias("title"),
            F.coalesce("p_content", "content").alias("content"),
            F.coalesce("p_tags", "tags").alias("tags"),
            "created_at",
            F.coalesce("p_ts", "updated_at").alias("updated_at"))

    rejects = (
        _reject(no_entity, "not_found", F.col("entity"))
        .unionByName(save_rejects)
        .unionByName(_reject(d.where(~F.coalesce(d_ok, F.lit(False))), "not_found", F.col("id")))
        .unionByName(_reject(u.where(~F.coalesce(u_ok, F.lit(False))), "not_found", F.col("id")))
    )
    # Narrow ids, materialised once: the documents are scanned twice against them.
    touched = _staged(deleted.unionByName(patch.select("id")).distinct())
    untouched, hit = split_touched(docs, touched)
    upserts = (apply_patch(hit.join(deleted, "id", "left_anti"), patch, "left")
               .unionByName(apply_patch(new_docs.where(F.col("death") >= NEVER), patch, "left")))
    if delta:
        return upserts, deleted, rejects
    return untouched.select(*DOC_COLS).unionByName(upserts), rejects


def split_touched(docs: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents whose id is not in ``touched``, those whose id is).

    Both are filters of the scan where the ids are few enough to broadcast
    (checked); beyond that Spark joins by id.
    """
    ids = bounded_broadcast(touched)
    return docs.join(ids, "id", "left_anti"), docs.join(ids, "id", "left_semi")


def apply_changes_delta(docs: DataFrame, entities: DataFrame, changes: DataFrame, names: DataFrame | None = None):
    """M10 as a delta: (upserted rows, deleted ids, rejects). The new table is
    ``docs`` without the deleted and upserted ids, plus the upserts; only the
    changed documents' content is read."""
    return apply_changes(docs, entities, changes, delta=True, names=names)


def save_batch(docs, entities, changes):
    """M4 + W2: only the saves of a log (first writer of a name wins)."""
    return apply_changes(docs, entities, changes.where(F.col("op") == "save"))


def update_batch(docs, entities, changes):
    """M5: only the updates of a log."""
    return apply_changes(docs, entities, changes.where(F.col("op") == "update"))


def delete_batch(docs, entities, changes):
    """M6: only the deletes of a log."""
    return apply_changes(docs, entities, changes.where(F.col("op") == "delete"))
