"""Removal of repeated passages by prefix-free parsing.

A window of ``LENGTH`` bytes is removed wherever the same bytes also start anywhere else.

1. Parsing: a rolling hash runs over each text, and the place where it is least within a window is that window's
   trigger. Triggers depend on content alone, so equal windows have equal triggers at equal places. Window starts with one
   trigger form a run; a run and the bytes that its windows cover are a phrase. Every window has a trigger, so phrases are
   of bounded length, and no phrase's windows go beyond it.
2. Parse: phrases are counted over the corpus by their contents' hashes. All windows of a phrase that occurs twice are repeated.
3. Dictionary: only where different phrases share the ``GRAM`` bytes at a trigger can windows of a phrase that occurs once
   be repeated. Such phrases are brought together by those bytes, and their suffixes, one from each window start, are
   put in order of their first ``LENGTH`` bytes by a radix sort of eight bytes at a time, which goes on with ties only. Windows
   that are equal to a neighbour in that order, byte by byte, are repeated. Groups too large for a task's memory are
   exploded to windows and counted by Spark, by hashes of 128 bits.
4. Removed stretches go back to their documents.

Since a window never leaves its phrase, its place in the corpus order is settled by its phrase's suffix as far as ``LENGTH``
bytes; the order of the parse's suffixes, which only tells apart what agrees for longer, is not needed and not built.

Null text counts as empty; a text shorter than ``LENGTH`` loses nothing. Repeated rows count as other places, so equal
texts of ``LENGTH`` bytes or more go in full, on all sides. Where ids repeat or are null, rows are numbered, so each is judged by
itself. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, ids_are_unique, keep_only, map_batches, materialised, numbered

LENGTH, GRAM = 200, 48
#: Window starts parsed at a time, and phrases of one group that a task compares in memory.
SEGMENT, GROUP = 1 << 17, 20_000
#: Bytes of phrases that are compared at a time; a group of one trigger is never cut.
TOGETHER = 1 << 20
_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A mixed polynomial hash of the ``n`` bytes from each position on, by doubling."""
    power, size, total, used, factor = _STEP, 1, None, 0, np.uint64(1)
    h = _TABLE[data]
    while True:
        if n & 1:
            total = h if total is None else total[: len(h) - used] + factor * h[used:]
            used, factor = used + size, factor * power
        n >>= 1
        if not n:
            break
        h = h[:-size] + power * h[size:]
        size, power = 2 * size, power * power
    total = total ^ (total >> np.uint64(31))
    return total * np.uint64(0xBF58476D1CE4E5B9)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the ``n`` values from each position on."""
    size = 1
    while 2 * size <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = n - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """First and last window start of each run, and its trigger."""
    starts = len(raw) - length + 1
    with np.errstate(over="ignore"):
        for base in range(0, starts, SEGMENT):
            data = np.frombuffer(raw, np.uint8, min(SEGMENT, starts - base) + length - 1, base)
            h = _rolling(data, gram)
            packed = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
            trigger = (_least(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            cut = np.flatnonzero(trigger[1:] != trigger[:-1]) + 1
            first = np.concatenate(([0], cut))
            last = np.concatenate((cut, [len(trigger)])) - 1
            yield from zip((first + base).tolist(), (last + base).tolist(), (trigger[first] + base).tolist(), strict=True)


def phrases(df: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``gram, phrase`` (hashes), ``doc_id`` and ``place`` (first start, trigger's and last start's distance) of every run."""

    def work(batch: pa.RecordBatch) -> dict:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode()
            for a, z, t in runs(raw, length, gram):
                out[0].append(xxhash.xxh3_64_intdigest(raw[t : t + gram]))
                out[1].append(xxhash.xxh3_64_intdigest(raw[a : z + length], t - a))
                out[2].append(doc)
                out[3].append(a << 16 | (t - a) << 8 | (z - a))
        hashes = [np.array(x, np.uint64).view(np.int64) for x in out[:2]]
        return {"gram": hashes[0], "phrase": hashes[1], "doc_id": np.array(out[2], np.int64), "place": np.array(out[3], np.int64)}

    return map_batches(df, "gram bigint, phrase bigint, doc_id bigint, place bigint", work)


def _packed(df: DataFrame) -> DataFrame:
    """Texts compressed, for the way through a shuffle."""

    def work(batch: pa.RecordBatch) -> dict:
        press = zstandard.ZstdCompressor(level=3)
        return {"doc_id": batch.column("doc_id"), "z": [press.compress(t.encode()) for t in batch.column("text").to_pylist()]}

    return map_batches(df, "doc_id bigint, z binary", work)


def repeated_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes of ``data`` that begin ``at`` agree for ``length`` bytes with another one of the same ``group``.

    The suffixes are sorted by group and then eight bytes at a time; those that are alone drop out. ``group`` is sorted."""
    words = np.zeros(max(0, len(data) - 7), np.uint64)
    for j in range(8):
        words = words << np.uint64(8) | data[j : len(data) - 7 + j]
    alive, rank = np.arange(len(at)), group
    for depth in [*range(0, length - 8, 8), length - 8]:
        key = words[at[alive] + depth]
        order = np.lexsort((key, rank))
        alive, key, rank = alive[order], key[order], rank[order]
        same = (key[1:] == key[:-1]) & (rank[1:] == rank[:-1])
        tied = np.append(same, False) | np.append(False, same)
        rank = np.cumsum(np.append(True, ~same))[tied]
        alive = alive[tied]
        if not len(alive):
            break
    out = np.zeros(len(at), bool)
    out[alive] = True
    return out


def _compare(frame: pa.Table, length: int) -> dict[str, list]:
    """The repeated stretches of the phrases that occur once, among the phrases of one trigger content; ``frame`` is sorted by it."""
    contents = frame.column("content").to_pylist()
    places, times, docs, grams = (frame.column(c).to_numpy() for c in ("place", "times", "doc_id", "gram"))
    data = np.frombuffer(b"".join(contents), np.uint8)
    long = np.array([len(c) for c in contents])
    sizes = long - length + 1
    edges = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(contents)), sizes)
    inner = np.arange(edges[-1]) - edges[owner]
    begin = np.concatenate(([0], np.cumsum(long)))[:-1]
    group = np.cumsum(np.append(False, grams[1:] != grams[:-1]))
    hit = np.flatnonzero(repeated_suffixes(data, begin[owner] + inner, group[owner], length) & (times[owner] == 1))
    whose, start = owner[hit], inner[hit] + (places[owner[hit]] >> 16)
    new = np.append(True, (whose[1:] != whose[:-1]) | (start[1:] - start[:-1] > length)) if len(hit) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
    return {"doc_id": docs[whose[first]], "begin": start[first], "end": start[last] + length}


def _compared(contents: DataFrame, length: int) -> DataFrame:
    """``doc_id, begin, end``: groups by ``gram``, each together in a task and sorted, are compared many at a time."""
    columns = ("doc_id", "begin", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(__name__)
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size < TOGETHER or held[0].column("gram")[0] == held[-1].column("gram")[-1]:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            grams = table.column("gram").to_numpy()
            cut = int(np.searchsorted(grams, grams[-1]))
            yield done(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks())

    def done(table: pa.Table) -> pa.RecordBatch:
        out = _compare(table, length)
        return pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in columns], names=list(columns))

    return contents.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "doc_id bigint, begin bigint, end bigint")


def _exploded(contents: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: a row for each window, counted by content."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("gram", "ahead", "window", "doc_id", "start", "times")}
        for r in batch.to_pylist():
            raw = r["content"]
            for i in range(len(raw) - length + 1):
                for c, v in zip(out, (r["gram"], (r["place"] >> 8 & 255) - i, xxhash.xxh3_128_digest(raw[i : i + length]), r["doc_id"], (r["place"] >> 16) + i, r["times"]), strict=True):
                    out[c].append(v)
        return out

    rows = map_batches(contents, "gram bigint, ahead int, window binary, doc_id bigint, start bigint, times bigint", work)
    key = ["gram", "ahead", "window"]
    again = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*key)
    return rows.where(F.col("times") == 1).join(again, key).select("doc_id", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))


def repeated_stretches(df: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, begin, end`` of stretches to remove, which may overlap. ``df`` has ``doc_id`` and ``text``."""
    found = phrases(df, length, gram)
    kinds = found.groupBy("gram", "phrase").agg(F.count("*").alias("times"), F.first("doc_id").alias("doc_id"), F.first("place").alias("place"))
    kinds = materialised(kinds.where(F.lit(True)))
    twice = kinds.where(F.col("times") > 1).select("gram", "phrase")
    whole = found.join(twice, ["gram", "phrase"]).select(
        "doc_id", F.shiftright("place", 16).alias("begin"), (F.shiftright("place", 16) + F.col("place").bitwiseAND(255) + length).alias("end")
    )
    shared = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1)
    asked = kinds.join(shared, "gram")
    # A document's runs are fewer than its bytes, so this list is bounded by its text.
    by_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "kinds", "place", "times")).alias("asked"))
    texts = by_doc.join(_packed(df), "doc_id")

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("gram", "kinds", "place", "times", "doc_id", "content")}
        for r in batch.to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(r["z"])
            for x in r["asked"]:
                a = x["place"] >> 16
                for c, v in zip(out, (x["gram"], x["kinds"], x["place"], x["times"], r["doc_id"], raw[a : a + (x["place"] & 255) + length]), strict=True):
                    out[c].append(v)
        return out

    contents = materialised(map_batches(texts, "gram bigint, kinds bigint, place bigint, times bigint, doc_id bigint, content binary", cut))
    parts = whole.unionByName(_compared(contents.where(F.col("kinds") <= group), length))
    large = contents.where(F.col("kinds") > group)
    return parts if large.isEmpty() else parts.unionByName(_exploded(large, length))


def remove_repeats(df: DataFrame, keep_text: bool = True, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (bytes)."""
    docs = id_and_text(df, id_col, text_col)
    if ids_are_unique(docs):
        return _removed(docs, keep_text, length)
    told = numbered(docs)
    found = _removed(told.select(F.col("row").alias("doc_id"), "text"), keep_text, length).withColumnRenamed("doc_id", "row")
    return found.join(told.select("row", "doc_id"), "row").select("doc_id", *[c for c in found.columns if c != "row"])


def _removed(docs: DataFrame, keep_text: bool, length: int) -> DataFrame:
    lists = repeated_stretches(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("parts"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for z, parts in zip(batch.column("z").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(z)
            merged: list[list[int]] = []
            for p in sorted(parts or [], key=lambda p: p["begin"]):
                if merged and p["begin"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], p["end"])
                else:
                    merged.append([p["begin"], p["end"]])
            at, kept = 0, []
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            for c, v in zip(out, (len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                out[c].append(v)
        return {"doc_id": batch.column("doc_id"), **out}

    return map_batches(_packed(docs).join(lists, "doc_id", "left"), schema, work)
