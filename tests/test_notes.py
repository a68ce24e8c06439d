import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import anchors, notes as N, store
from folioscope.schemas import BLOCKS, DRAFTS, EDITS, NOTES, REPLIES, TEXTS


def frame(spark, ddl, rows):
    names = [c.split(" ")[0] for c in __import__("folioscope.sources.store_files", fromlist=["_split"])._split(ddl)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


@pytest.fixture(scope="module")
def paper(spark):
    body = [("title", "A study"), ("h2", "Results"), ("p", "The mean was 12.5 and the mean fell."), ("h3", "Detail"), ("p", "Roi connectivity declined."), ("figure", ""), ("h2", "References"), ("p", "1. Author. Title.")]
    blocks = frame(spark, BLOCKS, [{"doc_id": 1, "ord": i, "block_id": f"b{i + 1:03d}" if k != "figure" else "fig-1", "kind": k, "html": t, "caption": "Figure 1. Maps" if k == "figure" else None, "label": "Figure 1" if k == "figure" else None} for i, (k, t) in enumerate(body)])
    texts = frame(spark, TEXTS, [{"doc_id": 1, "ord": i, "block_id": f"b{i + 1:03d}" if k != "figure" else "fig-1", "text": t or "Figure 1. Maps"} for i, (k, t) in enumerate(body)])
    return blocks, texts


def draft(pos, **more):
    return {"doc_id": 1, "draft_pos": pos, "cat": "mine", "comment": "c"} | more


def test_drafts_are_checked(spark, paper):
    blocks, texts = paper
    good = [
        draft(0, exact="mean", block="b003", occ=1),
        draft(1, exact="connectivity", suggestion="coupling", replies=[{"text": "ok", "author": "", "date": "2026-07-28"}, {"text": "two", "author": "Kim", "date": ""}]),
        draft(2, fig="fig-1", box=[0.1, 0.1, 0.5, 0.9]),
        draft(3, kind="note"),
    ]
    found = N.draft_errors(frame(spark, DRAFTS, good), blocks, texts).collect()
    assert [r for r in found if r["level"] == "error"] == []
    bad = [
        draft(0, exact="nowhere"), draft(1, exact="The", cat="odd"), draft(2, exact="A"), draft(3, exact=" "), draft(4, exact="mean", block="b003", occ=2), draft(5, exact="mean", block="b999"), draft(6, exact="mean", block="b001"),
        draft(7, fig="b001", box=[0.0, 0.0, 1.0, 1.0]), draft(8, fig="fig-1", box=[0.5, 0.5, 0.6, 0.1]), draft(9, fig="fig-1", box=[0.5]), draft(10, kind="note", replies=[{"text": "", "author": "", "date": ""}, {"text": "x", "author": "", "date": "soon"}, {"text": "y" * 4001, "author": "", "date": ""}]),
        draft(11, exact=" mean ", block="b003"),
    ]
    found = N.draft_errors(frame(spark, DRAFTS, bad), blocks, texts).collect()
    errors = {}
    for r in found:
        errors.setdefault(r["draft_pos"], []).append((r["level"], r["message"]))
    assert [errors[k][0][0] for k in range(11)] == ["error"] * 11
    assert len(errors[10]) == 3 and "blocks" in errors[2][0][1]
    assert sorted(x[0] for x in errors[11]) == ["warn", "warn"]
    assert N.writable(frame(spark, DRAFTS, bad), N.draft_errors(frame(spark, DRAFTS, bad), blocks, texts)).count() == 0


def test_seeding_in_manuscript_order(spark, paper):
    blocks, texts = paper
    rows = [draft(0, exact="connectivity", block="b005", replies=[{"text": "ok", "author": "", "date": "2026-07-28"}, {"text": "two", "author": "Kim", "date": ""}]), draft(1, exact="mean", block="b003", occ=1), draft(2, exact="mean", block="b003"), draft(3, kind="note"), draft(4, block="fig-1", kind="box")]
    base = frame(spark, DRAFTS, rows).withColumn("kind", F.coalesce("kind", F.lit("text"))).withColumn("y", F.lit(0.2))
    placed = N.numbered(N.positions(base, blocks, texts, seeds=True))
    assert [(r["id"], r["draft_pos"]) for r in placed.orderBy("seq").collect()] == [("r001", 3), ("r002", 2), ("r003", 1), ("r004", 0), ("r005", 4)]
    said = {r["id"]: r for r in N.reply_rows(placed, "2026-08-01 00:00:00").collect()}
    assert said["r004-c1"]["createdAt"] == "2026-07-28T00:00:01Z" and said["r004-c1"]["byOwner"]
    assert said["r004-c2"]["createdAt"] == "2026-08-01T00:00:02Z" and said["r004-c2"]["byOwner"] is None
    writes = N.batches(N.union_writes(placed.drop("pos"), N.reply_rows(placed, "2026-08-01 00:00:00")), ["rank", "n", "k"], size=3)
    assert [r["batch_no"] for r in writes.orderBy("rank", "n", "k").collect()] == [1, 1, 1, 2, 2, 2, 3]


def test_clean_export_and_report(spark, paper):
    blocks, texts = paper
    notes = frame(spark, NOTES, [
        {"doc_id": 1, "id": "n1", "kind": "text", "cat": "typos", "block": "b005", "exact": "declined", "occ": 0, "comment": "why", "suggestion": "fell", "author": "", "byOwner": True, "createdAt": "2026-01-01"},
        {"doc_id": 1, "id": "n2", "kind": "note", "cat": "mine", "seq": 1, "comment": "", "author": "Ann", "status": "open"},
        {"doc_id": 1, "id": "n3", "kind": "text", "cat": "mine", "block": "b003", "exact": "mean", "status": "done", "author": "", "authorId": "u1", "authorName": "Sam Sample"},
        {"doc_id": 1, "id": "n4", "kind": "box", "cat": "figures", "block": "fig-1", "x": 0.1, "y": 0.2, "w": 0.3, "h": 0.3, "status": "dismissed", "author": ""},
    ])
    replies = frame(spark, REPLIES, [
        {"doc_id": 1, "id": "c2", "note": "n1", "text": "b</script>", "author": "", "authorId": "u1", "authorName": "Sam Sample", "createdAt": "2026-02-02"},
        {"doc_id": 1, "id": "c1", "note": "n1", "text": "a", "author": "alex", "createdAt": "2026-02-01"},
        {"doc_id": 1, "id": "c3", "note": "n2", "text": "c", "author": "", "byOwner": True, "createdAt": "2026-02-01"},
        {"doc_id": 1, "id": "c4", "note": "n4", "text": "d", "author": "x", "createdAt": "2026-02-01"},
    ])
    kept, said = N.clean(notes, replies, blocks, texts, {"alex": "Alex", "@owner": "Kim Test"})
    data = json.loads(N.export_json(kept, said).first()["json"])
    assert [a["id"] for a in data["annotations"]] == ["n2", "n1"] and data["version"] == 3
    assert data["annotations"][1]["author"] == "Kim Test" and [r["id"] for r in data["replies"]] == ["c3", "c1", "c2"]
    text = N.export_markdown(kept, said).first()["markdown"]
    assert text.startswith("# Open review notes\n\n2 open notes, in manuscript order.\n\nBy category: My notes 1, Typos and wording 1.\n\n## General\n\n**1. My notes**")
    assert "## Results\n\n**2. Typos and wording** (Detail): “declined”  \nwhy  \nSuggested: fell\n_Kim Test_\n> **Alex** (2026-02-01): a  \n> **Sam Sample** (2026-02-02): b</script>  " in text
    edits = frame(spark, EDITS, [{"doc_id": 1, "block": "b003", "text": "x", "author": "", "authorId": "u1", "authorName": "Sam Sample"}])
    row = N.report(notes, replies, edits, "2026-03-01", {"alex": "Alex", "@owner": "Kim Test"}).first()
    payload = json.loads(row["payload"].replace("<\\/", "</"))
    assert "</" not in row["payload"] and [n["id"] for n in payload["notes"]] == ["n1", "n2", "n3"]
    assert [(r["id"], r["author"]) for r in payload["replies"]] == [("c1", "Alex"), ("c2", "Sam Sample"), ("c3", "Kim Test")]
    assert "authorId" not in payload["notes"][2] and payload["edits"][0]["author"] == "Sam Sample" and row["unsigned"] == 0
    assert N.report(notes, replies, edits, "d").first()["unsigned"] == 2
    assert [r["n"] for r in N.category_counts(kept).orderBy("place").collect()] == [1, 1]
    state = N.page_state(notes, texts, edits, replies).first()
    assert (state["notes"], state["open"], state["boxes"], state["orphans"], state["replies"], state["threads"]) == (4, 2, 1, 0, 4, 3)
    assert [r["id"] for r in N.search(notes, replies, "B</S").collect()] == ["n1"]
    fixed = N.apply_suggestions(notes, texts).first()
    assert fixed["text"] == "Roi connectivity fell."


def test_relabel(spark):
    notes = frame(spark, NOTES, [{"doc_id": 1, "id": "a", "author": "", "byOwner": True}, {"doc_id": 1, "id": "b", "author": "", "authorId": "u"}, {"doc_id": 1, "id": "c", "author": "cabbage"}])
    assert [tuple(r)[1:] for r in N.relabel(notes, "", "cabbage").collect()] == [("a", "update", '{"author":"cabbage"}')]
    assert [tuple(r)[1:] for r in N.relabel(notes, "cabbage", "").collect()] == [("c", "update", '{"author":"","byOwner":true}')]


def test_short_quotes_and_orphans(spark, paper):
    _, texts = paper
    quotes = spark.createDataFrame([(1, "mean"), (2, "The mean was 12.5 and the mean fell."), (3, "no such words stand in here at all")], "q bigint, quote string")
    hits = anchors.first_match(quotes, texts, "q", "quote", ["doc_id", "ord"]).orderBy("q").collect()
    assert [(r["probe_pos"], r["ord"]) for r in hits] == [(0, 2), (0, 2), (None, None)]


def test_store_merge(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 1, "z")], "id string, version bigint, data string")
    writes = spark.createDataFrame([("a", "set", "n", 1), ("b", "update", "n", 1), ("c", "delete", None, None), ("d", "set", "new", None), ("e", "update", "n", None)], "id string, op string, data string, if_version bigint")
    out = {r["id"]: tuple(r)[1:] for r in store.merge(now, writes).collect()}
    assert out == {"a": (2, "n", "written"), "b": (2, "y", "conflict"), "c": (None, None, "deleted"), "d": (1, "new", "written"), "e": (None, None, "missing")}


def test_quotes_of_every_length_find_all_texts(spark):
    import random

    from folioscope.operators import anchors

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(("alpha", "be", "c", "delta  x", "é", "over\nall")) for _ in range(rnd.randrange(12))) for _ in range(120)] + ["", None, "ab"]
    quotes = [t[a : a + n] for t in texts if t for a, n in [(rnd.randrange(len(t)), rnd.choice((1, 2, 3, 5, 9, 20, 60)))] for _ in range(2)] + ["", "nowhere", "a b", " "]
    q = spark.createDataFrame(list(enumerate(quotes)), "q bigint, quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "d bigint, text string")
    got = sorted((r["q"], r["d"]) for r in anchors.contains_join(q, t, "quote", "text").collect())
    assert got == [(i, j) for i, quote in enumerate(quotes) for j, text in enumerate(texts) if text is not None and quote and quote in text]
    assert anchors.contains_join(q.where("quote = ''"), t, "quote", "text").count() == 0
    plan = anchors.contains_join(q, t, "quote", "text")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_suggestions_over_cells_are_for_the_editor(spark):
    notes = spark.createDataFrame([(1, "n1", "text", "t", "2140", "x", 0), (1, "n2", "text", "t", "21", "y", 0), (1, "n3", "text", "b", "a b", "c", 0)], "doc_id bigint, id string, kind string, block string, exact string, suggestion string, occ int")
    texts = spark.createDataFrame([(1, "t", "Sizes2140"), (1, "b", "a b")], "doc_id bigint, block_id string, text string")
    blocks = spark.createDataFrame([(1, "t", "table", "Sizes", [["<b>21</b>", "40"]]), (1, "b", "p", None, None)], "doc_id bigint, block_id string, kind string, caption string, rows array<array<string>>")
    assert {r["id"]: r["text"] for r in N.apply_suggestions(notes, texts, blocks).collect()} == {"n2": "Sizesy40", "n3": "c"}
