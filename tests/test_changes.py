import datetime as dt

from builders import make_docs, make_entities
from vellum.operators import changes as chg
from vellum.schema import CHANGES


def log(spark, rows):
    base = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
    full = []
    for r in rows:
        full.append((r["seq"], base + dt.timedelta(minutes=r["seq"]), r["op"], r.get("id"), r.get("entity"),
                     r.get("topic"), r.get("name"), r.get("title"), r.get("content"), r.get("tags")))
    return spark.createDataFrame(full, CHANGES)


def apply(spark, docs, ents, rows):
    out, rej = chg.apply_changes(docs, ents, log(spark, rows))
    return {r.id: r for r in out.collect()}, sorted((r.seq, r.reason) for r in rej.collect())


def test_save_rules(spark):
    ents = make_entities(spark, ["alpha", "beta", "rust"])
    docs = make_docs(spark, [dict(id="D1", entity="rust", name="anyhow")])
    out, rej = apply(spark, docs, ents, [
        dict(seq=1, op="save", id="N1", entity="alpha", name="shared-name", title="T", content="C", tags=[]),
        dict(seq=2, op="save", id="N2", entity="beta", name="shared-name", title="T", content="C"),
        dict(seq=3, op="save", id="N3", entity="nonexistent", name="doc"),
        dict(seq=4, op="save", id="N4", entity="rust", name="anyhow"),
        dict(seq=5, op="save", id="N5", entity="rust", topic="Bad", name="ok-name"),
    ])
    assert set(out) == {"D1", "N1"}
    assert rej == [(2, "duplicate_name"), (3, "not_found"), (4, "duplicate_name"), (5, "invalid_path")]


def test_delete_frees_name_and_update(spark):
    ents = make_entities(spark, ["rust"])
    docs = make_docs(spark, [dict(id="D1", entity="rust", name="anyhow", title="Old Title", content="Old content")])
    out, rej = apply(spark, docs, ents, [
        dict(seq=1, op="update", id="D1", title="New Title", tags=["updated"]),
        dict(seq=2, op="update", id="D1", content="New content"),
        dict(seq=3, op="save", id="N1", entity="rust", name="anyhow"),       # still held
        dict(seq=4, op="delete", id="D1"),
        dict(seq=5, op="save", id="N2", entity="rust", name="anyhow", title="again"),
        dict(seq=6, op="update", id="D1", title="too late"),
        dict(seq=7, op="delete", id="D1"),
        dict(seq=8, op="delete", id="NOPE"),
        dict(seq=9, op="update", id="N2", content="patched"),
        dict(seq=10, op="delete", id="N2"),
        dict(seq=11, op="save", id="N3", entity="rust", name="anyhow"),
    ])
    assert set(out) == {"N3"}
    assert rej == [(3, "duplicate_name"), (6, "not_found"), (7, "not_found"), (8, "not_found")]
    out2, _ = apply(spark, docs, ents, [dict(seq=1, op="update", id="D1", title="New Title", tags=["updated"]),
                                        dict(seq=2, op="update", id="D1", content="New content")])
    d = out2["D1"]
    assert (d.title, d.content, d.tags) == ("New Title", "New content", ["updated"])


def test_first_writer_wins_in_batch(spark):
    ents = make_entities(spark, ["rust"])
    docs = make_docs(spark, [dict(id="D0", entity="rust", name="other")])
    out, rej = apply(spark, docs, ents, [dict(seq=s, op="save", id=f"N{s}", entity="rust", name="rust")
                                         for s in (3, 1, 2)])
    assert "N1" in out and "N2" not in out and "N3" not in out
    assert rej == [(2, "duplicate_name"), (3, "duplicate_name")]


def simulate(base_docs, entities, rows):
    """One change at a time, as the reference applies them."""
    import re
    live = {d["id"]: dict(d) for d in base_docs}
    rejects = []
    seg = re.compile(r"^[a-z0-9-]+$")
    for r in sorted(rows, key=lambda x: x["seq"]):
        if r["op"] == "save":
            if r["entity"] not in entities:
                rejects.append((r["seq"], "not_found"))
            elif any(d["name"] == r["name"] for d in live.values()):
                rejects.append((r["seq"], "duplicate_name"))
            elif not (seg.match(r["entity"]) and seg.match(r["name"]) and (r.get("topic") is None or seg.match(r["topic"]))):
                rejects.append((r["seq"], "invalid_path"))
            else:
                live[r["id"]] = dict(id=r["id"], name=r["name"], title=r.get("title") or "")
        elif r["op"] == "update":
            if r["id"] not in live:
                rejects.append((r["seq"], "not_found"))
            elif r.get("title") is not None:
                live[r["id"]]["title"] = r["title"]
        else:
            if r["id"] not in live:
                rejects.append((r["seq"], "not_found"))
            else:
                del live[r["id"]]
    return {k: v["title"] for k, v in live.items()}, sorted(rejects)


def test_random_logs_match_sequential_simulation(spark):
    import random
    rnd = random.Random(11)
    ents = make_entities(spark, ["rust", "go"])
    base = [dict(id="D1", entity="rust", name="n1", title="Title"), dict(id="D2", entity="go", name="n2", title="Title")]
    docs = make_docs(spark, base)
    for trial in range(3):
        rows, ids = [], ["D1", "D2"]
        for seq in range(1, 61):
            op = rnd.choice(["save", "save", "delete", "update"])
            if op == "save":
                new_id = f"N{seq}"
                ids.append(new_id)
                rows.append(dict(seq=seq, op="save", id=new_id, entity=rnd.choice(["rust", "go", "nope"]),
                                 name=rnd.choice(["n1", "n2", "n3", "Bad"]), title=f"t{seq}"))
            else:
                target = rnd.choice(ids + ["X"])
                rows.append(dict(seq=seq, op=op, id=target, title=f"u{seq}" if op == "update" else None))
        out, rej = apply(spark, docs, ents, rows)
        want_docs, want_rej = simulate(base, {"rust", "go"}, rows)
        assert {k: v.title for k, v in out.items()} == want_docs
        assert rej == want_rej


def test_untouched_documents_are_not_shuffled(spark, tmp_path):
    make_docs(spark, [dict(id=f"d{i}", entity="e", name=f"n{i}") for i in range(50)]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    touched = spark.createDataFrame([("d1",), ("d7",), ("unknown",)], "id string")
    untouched, hit = chg.split_touched(docs, touched)
    for part in (untouched, hit):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert {r.id for r in hit.collect()} == {"d1", "d7"}
    assert {r.id for r in untouched.collect()} == {f"d{i}" for i in range(50)} - {"d1", "d7"}
