"""Similarity join on word n-grams: which texts have sets of shingles with a Jaccard similarity of a threshold or more.

1. A text's set is that of its ``words``-word shingles, as 64-bit hashes; texts with equal sets are one class, and only the
   class's smallest id goes on.
2. Shingles are ordered rarest first. A shingle is no more frequent than its rarest word, and words are counted over all
   documents in a table of fixed size; any order gives the same links, a good one few candidates.
3. Similar sets share a shingle among the first ``n - ceil(t n) + 1`` of that order (prefix filter). Rows of these
   prefixes meet by shingle; pairs of too different length, or whose shared shingle stands too late in either set for enough
   to follow (length and positional filter), are left out.
   The suffix filter bounds how far two whole sets differ from below, by the bits in which marks of them differ.
4. Pairs are made distinct, then verified once each: both sets are split at a middle shingle, which bounds the overlap of
   the halves; what passes is intersected.
5. To find components not all pairs of a group need verifying: members are first held against their group's hub. Members
   that components do not join yet are held against each other, whatever the group's size.

Null text, text without words: empty set, linked with nothing. Fewer words than a shingle has: the whole sequence is the one
shingle. Repeated rows are links. Where ids repeat or are null, rows are numbered: each gives a row of its own, and a component's id is
the smallest that is not null. Columns other than the id and the text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, id_filter, ids_are_unique, join_spread, keep_only, list_array, map_batches, materialised, numbered, remembers, set_batches, without_ids
from .components import components

#: Words of a shingle, and least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Entries of the table of word counts.
COUNTERS = 1 << 19
#: Rounds in which a group's members meet its hub before all of them meet.
HUB_ROUNDS = 1
#: 64-bit words of marks of a set: the more, the fewer of the shingles in which two sets differ flip one bit and are not seen.
MARKS = 16
MARK_COLUMNS = [f"m{i}" for i in range(MARKS)]
_MEMO: dict[bytes, int] = {}
remembers(__name__, _MEMO.clear)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words, A-Z in lower case, in order."""
    parts = text.encode().translate(_LOWER).split()
    memo = _MEMO
    if len(memo) > 200_000:
        memo.clear()
    found = list(map(memo.get, parts))
    if None in found:
        for w in set(parts):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        found = list(map(memo.get, parts))
    return np.array(found, np.uint64)


def _windows(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the shingles as they stand in the text; fewer words than a shingle has are one."""
    if not len(h):
        return h
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(_windows(word_hashes(text), words))


def need(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any similar one."""
    return -(-percent * n // 100)


def frequencies(df: DataFrame) -> np.ndarray:
    """How many words of all documents fall on each counter; each task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(__name__)
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(total, (word_hashes(text) % COUNTERS).astype(np.int64), 1)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on], pa.int64())], names=["counter", "n"])

    set_batches(df.sparkSession)
    counted = df.mapInArrow(run, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    rows = counted.toArrow()  # at most COUNTERS rows
    out[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return out


def signed_sets(df: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``doc_id, n``, ``sig`` (16 bytes that stand for the set; null: empty), ``prefix``, its rarest shingles in order, and
    marks, bits that each shingle of the set flips one of; the prefix of a set too small to resemble another is empty."""
    shared = df.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers

    def work(batch: pa.RecordBatch) -> dict:
        sizes, sigs, prefixes = [], [], []
        marks = np.empty((batch.num_rows, MARKS), np.int64)
        for row, text in enumerate(batch.column("text").to_pylist()):
            h = word_hashes(text)
            s, first = np.unique(_windows(h, words), return_index=True)
            n = len(s)
            odd = np.bincount((s >> np.uint64(20) & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS) & 1
            marks[row] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            sizes.append(n)
            sigs.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
            k = n - need(n, percent) + 1 if n and 100 * n >= percent * (n + 1) else 0
            if k:
                # A shingle is no more frequent than its rarest word; the other words break ties, then the hash.
                count = shared.value[(h % COUNTERS).astype(np.int64)]
                each = np.stack([count[i + first] for i in range(min(words, len(h)))])
                s = s[np.lexsort((s, np.log2(each).sum(axis=0), each.min(axis=0)))[:k]]
            prefixes.append(s[:k].view(np.int64))
        found = {"doc_id": batch.column("doc_id"), "n": sizes, "sig": sigs, "prefix": list_array(prefixes, pa.int64())}
        return found | {f"m{i}": marks[:, i] for i in range(MARKS)}

    return map_batches(df, "doc_id bigint, n int, sig binary, prefix array<bigint>" + "".join(f", m{i} bigint" for i in range(MARKS)), work)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, z``: the compressed texts of the documents of ``ids``, a third of the size of their sets.

    The other texts are not shuffled for that: the scan leaves out most of those that were not asked for.
    """

    def work(batch: pa.RecordBatch) -> dict:
        press = zstandard.ZstdCompressor(level=3)
        return {"doc_id": batch.column("doc_id"), "z": [press.compress(t.encode()) for t in batch.column("text").to_pylist()]}

    asked = docs.where(id_filter(ids, "doc_id")(F.col("doc_id")))
    return map_batches(asked, "doc_id bigint, z binary", work).join(ids, "doc_id")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Suffix filter at a middle element, then the exact comparison."""
    least = -(-percent * (len(x) + len(y)) // (100 + percent))
    middle = y[len(y) // 2]
    i, j = int(np.searchsorted(x, middle)), len(y) // 2
    if min(i, j) + min(len(x) - i, len(y) - j) < least:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b`` and ``linked`` for each pair of ids."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("z").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("z").alias("y"))

    def work(batch: pa.RecordBatch) -> dict:
        held: dict[int, np.ndarray] = {}

        def set_of(doc: int, z: bytes) -> np.ndarray:
            if doc not in held:
                if len(held) > 200:
                    held.clear()
                held[doc] = shingles(zstandard.ZstdDecompressor().decompress(z).decode(), words)
            return held[doc]

        columns = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
        ok = [similar(set_of(a, x), set_of(b, y), percent) for a, b, x, y in zip(*columns, strict=True)]
        return {"a": batch.column("a"), "b": batch.column("b"), "linked": ok}

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), "a bigint, b bigint, linked boolean", work)


def _short(n, percent: int):
    """Last place in a set at which it must share a token with the prefix of a similar set that is no smaller."""
    return n - F.ceil(2 * percent * n / (100 + percent) - 1e-9)


def passes(a: str, b: str, percent: int, marked: bool):
    """Length, prefix, positional and, for rows with marks, suffix filter between two prefix rows with the same token.

    Of two similar sets the smaller shares a token with the larger one's prefix already within its own first
    ``n - ceil(2 t n / (1 + t)) + 1``, for their overlap is at least that share of the smaller set."""
    n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    i, j = F.col(f"{a}.pos"), F.col(f"{b}.pos")
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    a_smaller = (n < m) | ((n == m) & (F.col(f"{a}.doc_id") < F.col(f"{b}.doc_id")))
    early = F.when(a_smaller, i <= _short(n, percent)).otherwise(j <= _short(m, percent))
    passes = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & early & ((100 + percent) * most >= percent * (n + m))
    if not marked:
        return passes
    # Suffix filter: sets that differ in d shingles have marks that differ in at most d bits.
    differ = reduce(add, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in MARK_COLUMNS])
    return passes & ((100 + percent) * (n + m - differ) >= 2 * percent * (n + m))


def resolved(rows: DataFrame, narrowed: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]], docs: DataFrame, words: int, percent: int, passed: Callable[[str, str, int, bool], Column]) -> DataFrame:
    """``doc_id, comp`` of all documents that links join. ``rows`` is written and has ``token, doc_id, n``: documents with one token may be linked.

    A token's hub is its least document or, where ``rows`` has a ``degree``, one that meets the most others. ``passed`` says of two rows,
    ``a`` and ``b``, whether they still may be linked. For the last round ``narrowed`` says what ``passed`` is then asked of, given the rows of
    tokens whose documents are not in one component: these with further columns, or rows of other tokens that linked documents share as
    well; and which of the distinct pairs (``a, b``) that meet there are to be verified."""
    labels = links = checked = None
    turn = 0
    while True:
        now = rows if labels is None else rows.join(labels, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        now = now if labels is not None else now.withColumn("comp", F.col("doc_id"))
        hub = F.max_by("doc_id", "degree") if "degree" in rows.columns else F.min("doc_id")
        groups = now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), hub.alias("hub"))
        groups = groups.where(F.col("low") != F.col("high")).select("token", "hub")
        if "degree" in rows.columns:
            groups = materialised(groups)  # of members that meet as many the hub has to be the same wherever it is asked for
        open_rows = now.drop("degree").join(groups, "token")
        if turn < HUB_ROUNDS:
            hubs = open_rows.where(F.col("doc_id") == F.col("hub")).drop("hub")
            met = open_rows.where(F.col("doc_id") != F.col("hub")).alias("m").join(hubs.alias("h"), "token")
        else:
            open_rows, agreed = narrowed(open_rows.drop("hub"))
            met = open_rows.alias("m").join(open_rows.alias("h"), "token").where(F.col("m.doc_id") < F.col("h.doc_id"))
        met = met.where((F.col("m.comp") != F.col("h.comp")) & passed("m", "h", percent, turn >= HUB_ROUNDS))
        low, high = F.least("m.doc_id", "h.doc_id"), F.greatest("m.doc_id", "h.doc_id")
        pairs = met.select(low.alias("a"), high.alias("b")).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")
        if turn >= HUB_ROUNDS:
            pairs = agreed(pairs)
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialised(pairs)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.lit(1).alias("one")).select("doc_id")
        held = materialised(verified(pairs, materialised(_texts(docs, ids)), words, percent))
        checked = held if checked is None else checked.unionByName(held)
        new = materialised(held.where(F.col("linked")).select("a", "b"))
        links = new if links is None else links.unionByName(new)
        labels = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
        turn += 1
        if turn > HUB_ROUNDS:
            return labels


def class_components(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of ``members`` (``doc_id, n, sig``), from the component of each class's ``rep``."""
    comps = classes.join(labels, F.col("rep") == F.col("doc_id"), "left").select("sig", F.coalesce("comp", "rep").alias("component_id"))
    full = members.where(F.col("sig").isNotNull()).join(comps, "sig").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = members.where(F.col("sig").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def component_of_each(df: DataFrame, linked: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row, by ``linked``, which asks for ids that are unique.

    Where they are not, the rows are numbered and written; a component's id is then the least of its rows' ids that is not null."""
    docs = id_and_text(df, id_col, text_col)
    if ids_are_unique(docs):
        return linked(docs)
    told = numbered(docs)
    found = linked(told.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    found = materialised(found.join(told.select("row", "doc_id"), "row"))
    least = materialised(found.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    return join_spread(found, least, ["component_id"], "size").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def keep_first_of_each(df: DataFrame, linked: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """``df`` with one row of each component, that of the smallest id (null ids last); of several with that id one stays."""
    docs = id_and_text(df, id_col, text_col)
    if ids_are_unique(docs):
        gone = linked(docs).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id"))
        return without_ids(df, gone, id_col)
    # All of a row's columns as one, so that their names cannot clash.
    told = numbered(df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), F.struct(*[df[c] for c in df.columns]).alias("whole")))
    found = linked(told.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row").join(told.select("row", "doc_id"), "row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row"))
    return told.join(first.select("row"), "row", "left_semi").select("whole.*")


def _linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    signed = materialised(signed_sets(docs, words, percent, frequencies(docs)))
    members = signed.select("doc_id", "n", "sig")
    classes = materialised(members.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("rep")))
    reps = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = reps.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))
    early = F.max((F.col("pos") <= _short(F.col("n"), percent)).cast("int")) == 1
    shared = rows.groupBy("token").agg(F.count("*").alias("k"), early.alias("early")).where((F.col("k") > 1) & F.col("early")).select("token")
    rows = materialised(rows.join(shared, "token"))
    marks = signed.select("doc_id", *MARK_COLUMNS)
    return class_components(members, classes, resolved(rows, lambda open_rows: (open_rows.join(marks, "doc_id"), lambda pairs: pairs), docs, words, percent, passes))


def link_components(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: ``doc_id, n_shingles, component_id``, the smallest id reachable by links."""
    return component_of_each(df, lambda docs: _linked(docs, words, percent), id_col, text_col)


def keep_one(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row, that of the smallest id, of each component."""
    return keep_first_of_each(df, lambda docs: _linked(docs, words, percent), id_col, text_col)
