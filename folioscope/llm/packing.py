"""Packing tokenised documents into sequences by cutting-stock column generation.

1. Each document is tokenised; whole sequences are cut off its front, and its remainder is one piece.
2. The histogram of piece lengths (in steps of ``STEP`` tokens, so of at most ``capacity / STEP`` entries however
   many documents there are) goes to the driver.
3. A linear program over patterns (multisets of lengths that fit into one sequence) covers that histogram. New
   patterns are priced by a knapsack dynamic program until none improves it.
4. The patterns' rounded counts, and a first-fit-decreasing pass for what rounding leaves over, say how many
   sequences follow each pattern. Pieces are ranked within their length, and ranks are dealt to the slots.

Null and empty texts are documents of the closing id alone. Repeated ids are told apart by nothing but their rows:
ids are expected to be unique. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KnownLists, id_and_text, map_batches, materialised, remembers
from .linear import solve, times

CAPACITY, STEP, END_ID = 2048, 8, 1
#: Bytes of a worker's memo of tokenised parts of words, some 200,000 of them.
MEMO_BYTES = 8 << 20
#: Parts of words that are tokenised in one call, and a mark between them: one digit is always one token.
TOGETHER, MARK = 2000, "0"
#: Punctuation that is split off a word's end.
CLOSING = ".,;:!?\"'()[]{}*&%$#@+-/=_~^"


class WordTokens:
    """Ids of texts.

    The tokeniser's rules never join characters across ASCII white space, which they drop, nor letters with punctuation
    after them; so each word between white space is tokenised once in a batch, and words that differ in nothing but
    closing punctuation share their letters, which are remembered from batch to batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        (self.mark,) = self.tok.encode(MARK, add_special_tokens=False).ids
        self.memo = KnownLists(MEMO_BYTES)

    def _encode(self, parts: list[str]) -> pa.Array:
        """Letters go many to a call, between marks that no such part holds."""
        letters = [i for i, p in enumerate(parts) if p.isalpha()]
        others = [i for i, p in enumerate(parts) if not p.isalpha()]
        made = []
        for at in range(0, len(letters), TOGETHER):
            some = letters[at : at + TOGETHER]
            (coded,) = self.tok.encode_batch_fast([f" {MARK} ".join(parts[i] for i in some)], add_special_tokens=False)
            ids = np.array(coded.ids, np.int32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:
                raise ValueError("letters were taken for a mark")
            ends = np.concatenate(([0], cuts - np.arange(len(cuts)), [len(ids) - len(cuts)]))
            made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.delete(ids, cuts))))
        coded = self.tok.encode_batch_fast([parts[i] for i in others], add_special_tokens=False)
        made.append(pa.array([e.ids for e in coded], pa.list_(pa.int32())))
        places = np.empty(len(parts), np.int64)
        places[letters + others] = np.arange(len(parts))
        return pa.concat_arrays(made).take(pa.array(places))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        cores, ends = [], []
        for word in coded.dictionary.to_pylist():
            core = word.rstrip(CLOSING)
            if core.isalpha():
                cores.append(core.lower() if core.isascii() else core)
                ends.append(word[len(core) :])
            else:
                cores.append(word)
                ends.append("")
        parts = pa.array(cores + ends, pa.string()).dictionary_encode()
        del cores, ends
        lists = self.memo.of(parts.dictionary, self._encode)
        order = parts.indices.to_numpy().reshape(2, -1).T[coded.indices.to_numpy()]
        ids = lists.take(pa.array(order.ravel())).flatten().to_numpy()
        n = pc.list_value_length(lists).to_numpy()[order].sum(axis=1)
        cuts = np.concatenate(([0], np.cumsum(n)))[words.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def _tokeniser(path: str) -> WordTokens:
    return WordTokens(path)


remembers(__name__, _tokeniser.cache_clear)


def cut_pieces(df: DataFrame, tokeniser_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens``."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        coded = _tokeniser(tokeniser_path).ids(batch.column("text"))
        last = np.array([END_ID], "<u4").tobytes()
        for doc, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
            raw = ids.astype("<u4").tobytes() + last
            n = len(raw) // 4
            for start in range(0, n, capacity):
                part = raw[4 * start : 4 * (start + capacity)]
                for c, v in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                    out[c].append(v)
        return out

    return map_batches(id_and_text(df, id_col, text_col), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint", work)


def _knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes 1..n (``values[i]`` for size i + 1) within ``capacity``, by dynamic programming."""
    n = len(values)
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = min(c, n)
        offers = values[:k] + best[c - 1 :: -1][:k]
        i = int(np.argmax(offers))
        best[c] = best[c - 1]
        if offers[i] > best[c] + 1e-12:
            best[c], pick[c] = offers[i], i
    pattern, c = np.zeros(n, np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= pick[c] + 1
    return float(best[capacity]), pattern


def _greedy_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: fill a bin largest first, repeat that pattern until a size runs out, and go on without that size.

    A size does not occur in the columns after the one that used it up, so the basis is triangular and can be inverted.
    """
    m = len(sizes)
    basis, amount, left = np.zeros((m, m)), np.zeros(m), demand.copy()
    open_sizes = list(range(m - 1, -1, -1))
    while open_sizes:
        room, pattern = capacity, np.zeros(m)
        for j in open_sizes:
            if n := min(room // sizes[j], int(np.ceil(left[j]))):
                pattern[j] = n
                room -= n * sizes[j]
        on = np.flatnonzero(pattern)
        times = (left[on] / pattern[on]).min()
        left[on] -= times * pattern[on]
        gone = [j for j in open_sizes if left[j] <= 1e-9]
        basis[:, gone[0]], amount[gone[0]] = pattern, times
        for j in gone[1:]:
            basis[j, j] = capacity // sizes[j]
        open_sizes = [j for j in open_sizes if left[j] > 1e-9]
    return basis, amount


def solve_patterns(counts: np.ndarray, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is used, covering ``counts[i]`` items of size i + 1 in bins of size ``len(counts)``.

    The linear program is solved by the revised simplex method; ``rounds`` bounds its pivots. Any basis it stops at is
    feasible, so the cover is whole in any case.
    """
    capacity = len(counts)
    sizes = np.flatnonzero(counts) + 1
    if not len(sizes):
        return []
    demand, m = counts[sizes - 1].astype(float), len(sizes)
    basis, amount = _greedy_basis(sizes, demand, capacity)
    inverse = solve(basis, np.eye(m))
    full = np.zeros(capacity)
    for turn in range(rounds):
        prices = inverse.sum(axis=0)
        full[:] = 0
        full[sizes - 1] = np.maximum(prices, 0)
        value, pattern = _knapsack(full, capacity)
        if value <= 1 + 1e-7:
            break
        column = pattern[sizes - 1].astype(float)
        direction = times(inverse, column)
        up = direction > 1e-9
        if not up.any():
            break
        ratios = np.where(up, amount / np.where(up, direction, 1), np.inf)
        leave = int(np.argmin(ratios))
        amount -= ratios[leave] * direction
        amount[leave] = ratios[leave]
        basis[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        if turn % 200 == 199:
            inverse = solve(basis, np.eye(m))
            amount = np.maximum(times(inverse, demand), 0)
    used: list[tuple[np.ndarray, int]] = []
    left = counts.astype(np.int64).copy()
    for j in np.argsort(-amount):
        pattern = np.zeros(capacity, np.int64)
        pattern[sizes - 1] = np.rint(basis[:, j]).astype(np.int64)
        on = pattern > 0
        if (n := int(min(np.floor(amount[j] + 1e-6), (left[on] // pattern[on]).min()))) > 0:
            used.append((pattern, n))
            left -= n * pattern
    rest: list[list] = []  # room, pattern
    for size in range(capacity, 0, -1):
        for _ in range(int(left[size - 1])):
            target = next((b for b in rest if b[0] >= size), None)
            if target is None:
                rest.append(target := [capacity, np.zeros(capacity, np.int64)])
            target[0] -= size
            target[1][size - 1] += 1
    return used + [(b[1], 1) for b in rest]


def deal(patterns: list[tuple[np.ndarray, int]], capacity: int) -> dict[int, tuple[list[int], ...]]:
    """For each size: starts of rank ranges, and for each range its first sequence and its slots a sequence."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {s: ([], [], []) for s in range(1, capacity + 1)}
    given, sequence = [0] * (capacity + 1), 0
    for pattern, n in patterns:
        for size in np.flatnonzero(pattern) + 1:
            starts, firsts, slots = out[int(size)]
            starts.append(given[size])
            firsts.append(sequence)
            slots.append(int(pattern[size - 1]))
            given[size] += n * int(pattern[size - 1])
        sequence += n
    return {s: x for s, x in out.items() if x[0]}


def pack(df: DataFrame, tokeniser_path: str, capacity: int = CAPACITY, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there. ``capacity`` must be a multiple of ``step``."""
    if capacity % step:
        raise ValueError("capacity must be a multiple of step")
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1024)).cast("int")
    pieces = materialised(cut_pieces(df, tokeniser_path, capacity, id_col, text_col))
    size = F.ceil(F.col("length") / step).cast("int")
    pieces = pieces.select("*", size.alias("size"), salt.alias("salt"))
    # At most capacity / step sizes, so the histogram on the driver and the ranks' offsets are bounded by parameters.
    cells = pieces.groupBy("size", "salt").agg(F.count("*").alias("n"))
    cells = materialised(cells)
    counts = np.zeros(capacity // step, np.int64)
    for row in cells.groupBy("size").agg(F.sum("n").alias("n")).collect():
        counts[row["size"] - 1] = row["n"]
    slots = deal(solve_patterns(counts), capacity // step)
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select(F.col("size").alias("s"), F.col("salt").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "start")) - 1
    ranked = pieces.withColumn("within", within)
    ranked = ranked.join(base, (ranked["size"] == base["s"]) & (ranked["salt"] == base["t"])).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("base") + F.col("within")).alias("rank")
    )

    def place(batch: pa.RecordBatch) -> dict:
        sizes, ranks = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
        sequence = np.empty(len(sizes), np.int64)
        for s in np.unique(sizes):
            on = np.flatnonzero(sizes == s)
            starts, firsts, per = (np.array(x) for x in slots[int(s)])
            k = np.searchsorted(starts, ranks[on], "right") - 1
            sequence[on] = firsts[k] + (ranks[on] - starts[k]) // per[k]
        return {c: batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": sequence}

    placed = map_batches(ranked, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint", place)
    # A sequence holds at most capacity pieces, so this window is bounded.
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
