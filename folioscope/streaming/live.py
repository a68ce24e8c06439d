"""The live store as streams: materialised state, replies that never overwrite each other, leases, bounded history, cascades.

Event time is the write's own time. State is bounded: by the watermark where rows are told apart or joined, by a timer for leases, and by
a fixed length for histories.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.store import HISTORY, LEASE_SECONDS, last_writes


def distinct_replies(replies: DataFrame, ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Each reply once, however often it is sent within the delay."""
    return replies.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["reply_id"])


def lease_sessions(beats: DataFrame, key: str = "block", ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Spans in which a block was held, from beats no more than a lease apart."""
    held = beats.withWatermark(ts, delay).groupBy(key, F.session_window(ts, f"{LEASE_SECONDS} seconds").alias("w")).agg(F.count("*").alias("beats"))
    return held.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "beats")


LEASES = "block BIGINT, seq BIGINT, actor STRING, granted BOOLEAN, holder STRING"


class _Arbiter(StatefulProcessor):
    """One holder a block. A request by another is refused until the holder's lease has run out; when it has, the block's state goes."""

    def __init__(self, tell_ends: bool):
        self.tell_ends = tell_ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holder = handle.getValueState("holder", "actor STRING, until_us BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        actor, until = self.holder.get() if self.holder.exists() else (None, -1)
        first = until
        out = []
        for r in asked.itertuples():
            now = int(r.ts.value // 1000)
            granted = actor in (None, r.actor) or now > until
            if granted:
                actor, until = r.actor, max(until, now + LEASE_SECONDS * 1_000_000) if actor == r.actor else now + LEASE_SECONDS * 1_000_000
            out.append((key[0], r.seq, r.actor, granted, actor))
        if until != first:
            if first >= 0:
                self.handle.deleteTimer(_timer(first))
            self.handle.registerTimer(_timer(until))
            self.holder.update((actor, until))
        yield pd.DataFrame(out, columns=["block", "seq", "actor", "granted", "holder"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (actor, _) = self.holder.get()
        self.holder.clear()
        if self.tell_ends:
            yield pd.DataFrame([(key[0], None, actor, False, None)], columns=["block", "seq", "actor", "granted", "holder"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def _timer(until_us: int) -> int:
    """The first millisecond in which a lease is over."""
    return until_us // 1000 + 1


def arbitrated(requests: DataFrame, delay: str = "0 seconds", tell_ends: bool = False) -> DataFrame:
    """``requests``: ``block, actor, ts, seq``. Adds whether each request for a block was granted, and who holds it then.

    When the watermark, ``delay`` behind the latest request for any block, has passed the end of a lease, the block's state is dropped and, if
    asked for, a row without ``seq`` and ``holder`` says whose lease has ended. Requests that come later than the watermark are not answered."""
    asked = requests.withWatermark("ts", delay).groupBy("block")
    return asked.transformWithStateInPandas(statefulProcessor=_Arbiter(tell_ends), outputStructType=LEASES, outputMode="Append", timeMode="EventTime")


class _History(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "version BIGINT, data STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {v: d for v, d in self.kept.get()}
        for frame in rows:
            kept |= dict(zip(frame["version"].tolist(), frame["data"].tolist(), strict=True))
        last = sorted(kept.items())[-HISTORY:]
        self.kept.put(last)
        yield pd.DataFrame([(key[0], v, d, len(last) - n) for n, (v, d) in enumerate(last)], columns=["block", "version", "data", "age"])

    def close(self) -> None:
        pass


def bounded_history(versions: DataFrame) -> DataFrame:
    """After each batch, the last versions (``block, version, data``) of the blocks that it touched, with their ``age`` from 1."""
    return versions.groupBy("block").transformWithStateInPandas(statefulProcessor=_History(), outputStructType="block BIGINT, version BIGINT, data STRING, age INT", outputMode="Append", timeMode="None")


def cascaded(replies: DataFrame, deleted: DataFrame, horizon: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Replies (``doc_id, note, ts`` and more) to notes that the feed ``deleted`` (``doc_id, id, deleted_at``) deletes, each once, whichever of both
    comes first: a reply that is late for its note goes too.

    Both are kept until the watermarks have passed the ``horizon``; replies older than that are the store's, from which ``store.cascade`` takes
    them."""
    gone = deleted.select(F.col("doc_id").alias("__doc"), F.col("id").alias("__note"), F.col("deleted_at").alias("__at")).withWatermark("__at", delay)
    own = replies.withWatermark("ts", delay)
    span = F.expr(f"INTERVAL {horizon}")
    near = (F.col("ts") >= F.col("__at") - span) & (F.col("ts") <= F.col("__at") + span)
    return own.join(gone, (F.col("doc_id") == F.col("__doc")) & (F.col("note") == F.col("__note")) & near, "left_semi")


#: Parts that a live state's keys are dealt to, each of which is rewritten only when one of its keys is written.
BUCKETS = 256


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The last finished batch, and in which of its two places each bucket's rows are."""
    found = (-1, {})
    for turn in (0, 1):
        try:
            rows = spark.read.schema("number BIGINT, bucket INT, slot INT").parquet(f"{path}/manifest/turn={turn}").collect()  # no more than ``BUCKETS`` rows and one
        except Exception as e:  # not written yet, or just being rewritten: the other one is whole
            if "PATH_NOT_FOUND" not in str(e) and "FILE_NOT_EXIST" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            continue
        if rows and rows[0]["number"] > found[0]:
            found = rows[0]["number"], {r["bucket"]: r["slot"] for r in rows if r["bucket"] is not None}
    return found


def _held(spark: SparkSession, path: str, slots: dict[int, int]) -> DataFrame:
    own = [sorted(b for b, s in slots.items() if s == slot) for slot in (0, 1)]
    return spark.read.parquet(f"{path}/state").where(((F.col("slot") == 0) & F.col("bucket").isin(own[0])) | ((F.col("slot") == 1) & F.col("bucket").isin(own[1])))


def upsert_into(path: str, key: list[str], order: list[str], buckets: int = BUCKETS):
    """A ``foreachBatch`` function that keeps the latest write of each key under ``path``.

    Keys are dealt to buckets, and a batch rewrites those that it touches. Every bucket has two places; a batch writes to the one that the last
    manifest does not name, and then its own manifest beside the last, so a reader never sees half of a batch, what is two batches
    old is overwritten, and a batch that is run again changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last, slots = _manifest(spark, path)
        if last >= number:
            return
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # no more than ``buckets``
        if touched:
            old = {b: slots[b] for b in touched if b in slots}
            rows = batch.unionByName(_held(spark, path, old).drop("slot").select(*batch.columns)) if old else batch
            slots = slots | {b: 1 - slots.get(b, 1) for b in touched}
            to = F.col("bucket").isin([b for b in touched if slots[b] == 1]).cast("int")
            best = last_writes(rows, [*key, "bucket"], order).withColumn("slot", to)
            best.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(f"{path}/state")
        batch.unpersist()
        manifest = [(number, b, s) for b, s in sorted(slots.items())] or [(number, None, None)]
        spark.createDataFrame(manifest, "number BIGINT, bucket INT, slot INT").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/turn={number % 2}")

    return run


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The state that the last finished batch left."""
    return _held(spark, path, _manifest(spark, path)[1]).drop("bucket", "slot")
