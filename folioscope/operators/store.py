"""The notes store: versioned upserts, history, leases, ownership, permissions. Batch forms of what the live page does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEASE_SECONDS, HISTORY = 45, 10


def read(table: DataFrame, where: list[tuple[str, str, object]] | None = None, limit: int | None = None) -> DataFrame:
    """``eq`` and ``in`` filters, which reach the scan, and a limit."""
    out = table
    for field, op, value in where or []:
        if op not in ("eq", "in"):
            raise ValueError(f"unknown operator {op}")
        out = out.where(F.col(field) == value if op == "eq" else F.col(field).isin(*value))
    return out if limit is None else out.limit(limit)


def merge(current: DataFrame, writes: DataFrame) -> DataFrame:
    """The state after ``writes`` (``id, op, data, if_version``), one for each id, with ``outcome`` of what was asked.

    A write whose pinned version is not the current one is a conflict and changes nothing. ``current``: ``id, version, data``.
    """
    w = writes.select("id", F.lit(True).alias("asked"), "op", F.col("data").alias("new"), "if_version")
    both = current.join(w, "id", "full_outer")
    version = F.coalesce("version", F.lit(0).cast("long"))
    conflict = F.col("if_version").isNotNull() & (F.col("if_version") != version)
    missing = F.col("op").isin("update", "delete") & F.col("version").isNull()
    outcome = F.when(F.col("asked").isNull(), "kept").when(conflict, "conflict").when(missing, "missing").when(F.col("op") == "delete", "deleted").otherwise("written")
    done = outcome == "written"
    return both.select(
        "id", F.when(outcome == "deleted", None).when(done, version + 1).otherwise(F.col("version")).alias("version"), F.when(outcome == "deleted", None).when(done, F.col("new")).otherwise(F.col("data")).alias("data"), outcome.alias("outcome")
    )


def merge_in_order(current: DataFrame, writes: DataFrame, order: list[str]) -> DataFrame:
    """The state after ``writes`` (``id, op, data, if_version``) of which one id may have several, in the order of the columns ``order``; ``outcomes``
    has one word for each write of an id, none for ids that nothing was asked of.

    A fold over an id's writes with the version as what is handed on: each write sees what the one before it has left, so a pin holds
    or fails by the version at its own turn. An id's writes are one row; a batch of writes bounds them. Writes of no id are left out."""
    turn = F.struct(*order, "op", "data", "if_version")
    asked = writes.where(F.col("id").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_list(turn)).alias("writes"))
    both = current.join(asked, "id", "full_outer")
    start = F.struct(F.col("version").cast("long").alias("version"), F.col("data").alias("data"), F.expr("cast(array() as array<string>)").alias("outcomes"))

    def step(acc, w):
        conflict = w["if_version"].isNotNull() & (w["if_version"] != F.coalesce(acc["version"], F.lit(0).cast("long")))
        missing = w["op"].isin("update", "delete") & acc["version"].isNull()
        outcome = F.when(conflict, "conflict").when(missing, "missing").when(w["op"] == "delete", "deleted").otherwise("written")

        def put(o):
            version = F.when(o == "deleted", None).when(o == "written", F.coalesce(acc["version"], F.lit(0).cast("long")) + 1).otherwise(acc["version"])
            data = F.when(o == "deleted", None).when(o == "written", w["data"]).otherwise(acc["data"])
            return F.struct(version.alias("version"), data.alias("data"), F.concat(acc["outcomes"], F.array(o)).alias("outcomes"))

        return F.transform(F.array(outcome), put)[0]

    folded = F.aggregate(F.coalesce("writes", F.array().cast(asked.schema["writes"].dataType)), start, step)
    return both.withColumn("after", folded).select("id", "after.version", "after.data", "after.outcomes")


def last_writes(feed: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last write of each key: an aggregate, so that busy keys are combined before the shuffle."""
    rest = [c for c in feed.columns if c not in key and c not in order]
    best = feed.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("w"))
    return best.select(*key, *[f"w.{c}" for c in [*order, *rest]])


def history(versions: DataFrame, key: list[str], order: list[str], n: int = HISTORY) -> DataFrame:
    """The last ``n`` versions of each key, with ``age`` from 1. The rank filter is pushed below the shuffle by Spark."""
    age = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return versions.withColumn("age", age).where(F.col("age") <= n)


def original(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first version of each key, which "use original" goes back to."""
    rest = [c for c in versions.columns if c not in key and c not in order]
    first = versions.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("w"))
    return first.select(*key, *[f"w.{c}" for c in [*order, *rest]])


def lease_spans(beats: DataFrame, key: list[str], ts: str, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Leases as spans of beats no further apart than ``seconds``: ``lease_no, started, ended, beats``."""
    own = Window.partitionBy(*key).orderBy(ts)
    before = F.lag(ts).over(own)
    fresh = before.isNull() | (F.col(ts) > before + F.make_dt_interval(secs=F.lit(seconds)))
    rows = beats.withColumn("__f", fresh.cast("int")).withColumn("lease_no", F.sum("__f").over(own))
    return rows.groupBy(*key, "lease_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("beats"))


def first_owner(claims: DataFrame, key: str, owner: str, ts: str) -> DataFrame:
    """The owner who claimed first; later claims change nothing."""
    return claims.groupBy(key).agg(F.min(F.struct(ts, owner)).alias("c")).select(key, f"c.{owner}", f"c.{ts}")


def cascade(replies: DataFrame, deleted_notes: DataFrame) -> DataFrame:
    """Replies that go with deleted notes."""
    return replies.join(deleted_notes.select("doc_id", F.col("id").alias("note")), ["doc_id", "note"], "left_semi")


def stamped(writes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Writes with the session's signature, or an empty one and the account's id."""
    out = writes.join(sessions.select("actor", "session", "signature"), ["actor", "session"], "left")
    return out.withColumn("author", F.coalesce("signature", F.lit(""))).withColumn("authorId", F.when(F.coalesce("signature", F.lit("")) == "", F.col("actor"))).drop("signature")


def permitted(feed: DataFrame) -> DataFrame:
    """Writes by those who may write: their own replies, and seeded ones, which have no account."""
    return feed.where(F.col("can_write") & (F.col("authorId").isNull() | (F.col("authorId") == F.col("actor"))))


def display_names(notes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``authorName`` from the viewer's profiles."""
    return notes.join(profiles.select(F.col("id").alias("authorId"), F.col("name").alias("authorName")), "authorId", "left")
