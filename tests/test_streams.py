from datetime import datetime, timedelta

from folioscope.operators import store
from folioscope.streaming import live


def files(spark, path, ddl, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_replies_are_kept_once(spark, tmp_path):
    ddl = "reply_id string, text string, ts timestamp"
    from datetime import datetime

    t = datetime(2026, 1, 1)
    s = files(spark, tmp_path / "a", ddl, [("r1", "x", t), ("r2", "y", t)], [("r1", "x", t)])
    assert run(live.distinct_replies(s), "once").count() == 2


def test_latest_state(spark, tmp_path):
    ddl = "id string, version bigint, data string"
    s = files(spark, tmp_path / "b", ddl, [("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("a", 1, "late")])
    out = str(tmp_path / "state")
    q = s.writeStream.foreachBatch(live.upsert_into(out, ["id"], ["version"])).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted((r["id"], r["version"], r["data"]) for r in live.latest(spark, out).collect()) == [("a", 2, "z"), ("b", 1, "y")]


def test_one_editor_at_a_time(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2026, 1, 1)
    ddl = "block bigint, actor string, ts timestamp, seq bigint"
    at = lambda s: t + timedelta(seconds=s)
    s = files(spark, tmp_path / "d", ddl, [(1, "ann", at(0), 0), (1, "bob", at(10), 1), (1, "ann", at(30), 2), (1, "bob", at(76), 3), (2, "bob", at(5), 4)])
    rows = {r["seq"]: (r["granted"], r["holder"]) for r in run(live.arbitrated(s), "leases").collect()}
    assert rows == {0: (True, "ann"), 1: (False, "ann"), 2: (True, "ann"), 3: (True, "bob"), 4: (True, "bob")}


def test_a_lease_ends_without_a_further_request(spark, tmp_path):
    """The watermark of other blocks' requests ends it; then the block's state is gone and anybody may hold it."""
    t = datetime(2026, 1, 1)
    ddl = "block bigint, actor string, ts timestamp, seq bigint"
    at = lambda s: t + timedelta(seconds=s)
    s = files(spark, tmp_path / "f", ddl, [(1, "ann", at(0), 0), (1, "ann", at(20), 1)], [(2, "bob", at(60), 2)], [(2, "bob", at(70), 3)], [(2, "bob", at(75), 5)], [(1, "cy", at(76), 4)])
    q = live.arbitrated(s, tell_ends=True).writeStream.format("memory").queryName("ended").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = [(r["block"], r["seq"], r["actor"], r["granted"], r["holder"]) for r in spark.table("ended").collect()]
    assert (1, None, "ann", False, None) in rows and (1, 4, "cy", True, "cy") in rows
    assert sum(r[1] is None and r[0] == 1 and r[2] == "ann" for r in rows) == 1  # once, at the end of the renewed lease
    assert rows.index((1, None, "ann", False, None)) < rows.index((1, 4, "cy", True, "cy"))


def test_buckets_that_a_batch_does_not_touch_stay(spark, tmp_path):
    import os

    out, write = str(tmp_path / "live"), None
    write = live.upsert_into(out, ["id"], ["version"], buckets=16)
    ddl = "id string, version bigint, data string"
    df = lambda rows: spark.createDataFrame(rows, ddl)
    parts = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{out}/state") for f in fs if f.startswith("part")}
    state = lambda: {r["id"]: (r["version"], r["data"]) for r in live.latest(spark, out).collect()}
    want = {f"k{i}": (1, "a") for i in range(60)}
    write(df([(k, *v) for k, v in want.items()]), 0)
    first = parts()
    write(df([("k3", 2, "b"), ("k3", 1, "old"), ("new", 1, "n")]), 1)
    want |= {"k3": (2, "b"), "new": (1, "n")}
    assert state() == want
    second = parts()
    assert all(second[p] == n for p, n in first.items()) and 1 <= len(second) - len(first) <= 2
    write(df([("k3", 9, "again")]), 1)  # the batch is run again
    assert state() == want and parts() == second
    for n in range(2, 7):
        write(df([("k3", n + 1, "b")]), n)
    assert state() == want | {"k3": (7, "b")}
    assert len(parts()) <= len(second) + 1  # what is two batches old has been overwritten
    write(df([]), 7)
    assert state() == want | {"k3": (7, "b")}


def test_replies_go_with_deleted_notes_in_either_order(spark, tmp_path):
    t = datetime(2026, 1, 1)
    at = lambda m: t + timedelta(minutes=m)
    replies = files(spark, tmp_path / "g", "doc_id bigint, note string, reply_id string, ts timestamp", [(1, "n1", "early", at(0)), (1, "n2", "other", at(0))], [(1, "n1", "late", at(9))], [(1, "n1", "much later", at(200))])
    deleted = files(spark, tmp_path / "h", "doc_id bigint, id string, deleted_at timestamp", [(1, "n1", at(5)), (1, "n1", at(6)), (2, "n2", at(5))])
    assert sorted(r["reply_id"] for r in run(live.cascaded(replies, deleted), "gone").collect()) == ["early", "late"]


def test_feeds_are_stamped_and_permitted(spark, tmp_path):
    feed = files(spark, tmp_path / "i", "actor string, session string, authorId string, can_write boolean", [("u1", "s1", "u1", True), ("u1", "s2", None, True), ("u2", "s1", "u1", True), ("u1", "s1", "u1", False)])
    sessions = spark.createDataFrame([("u1", "s1", "Ann")], "actor string, session string, signature string")
    allowed = store.stamped(store.permitted(feed).drop("authorId"), sessions)
    assert sorted((r["actor"], r["session"], r["author"], r["authorId"]) for r in run(allowed, "stamped").collect()) == [("u1", "s1", "Ann", None), ("u1", "s2", "", "u1")]


def test_writes_of_one_id_are_merged_in_order(spark):
    current = spark.createDataFrame([("a", 3, "x"), ("b", 1, "y")], "id string, version bigint, data string")
    rows = [("a", 2, "set", "second", 4), ("a", 1, "set", "first", 3), ("a", 3, "set", "stale", 4), ("a", 4, "delete", None, None), ("a", 5, "update", "gone", None), ("a", 6, "set", "anew", 0), ("c", 1, "delete", None, None), (None, 1, "set", "z", None)]
    writes = spark.createDataFrame(rows, "id string, pos int, op string, data string, if_version bigint")
    got = {r["id"]: (r["version"], r["data"], r["outcomes"]) for r in store.merge_in_order(current, writes, ["pos"]).collect()}
    assert got == {"a": (1, "anew", ["written", "written", "conflict", "deleted", "missing", "written"]), "b": (1, "y", []), "c": (None, None, ["missing"])}


def test_history_is_bounded(spark, tmp_path):
    ddl = "block bigint, version bigint, data string"
    s = files(spark, tmp_path / "e", ddl, [(1, v, str(v)) for v in range(25)])
    rows = run(live.bounded_history(s), "history").orderBy("age").collect()
    assert [r["version"] for r in rows] == list(range(24, 14, -1))
