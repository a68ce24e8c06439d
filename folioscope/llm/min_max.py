"""Near copies by min-max hashing.

1. A text's set is that of its ``words``-word shingles, as in ``ngram_join``; texts with equal sets are one class, and only its
   smallest id goes on.
2. Every shingle is hashed once under each of ``PERMUTATIONS`` permutations, and both the least and the greatest hash are kept. Either
   agrees between two sets with the probability of their Jaccard similarity, so a signature has twice as many values as hashes were
   taken, and since the two ends of one permutation seldom agree by the same chance, its estimate has no bias and less variance than
   as many least hashes.
3. Signatures are cut into bands of ``ROWS`` values. Texts that share a band meet; those of similarity 0.85 share none of 32 in less than
   one case in ten thousand millions. The pairs that meet are confirmed on full sets.
4. As in ``ngram_join``, a band's texts first meet its hub. That is the one that shares bands with most others, so the text that a family
   of copies was made from rather than one of the copies, which may be alike to it and not to each other.
5. Texts of a band that are then not in one component meet where they also share a shingle among the rarest of their sets, with the filters
   of ``ngram_join``, all of which similar sets pass. Copies that were changed in different places share no such shingle, so they do not
   meet in pairs, however many there are. They meet by the shingles alone, so not once more for each band that they share.

Null text and text without words: empty set, linked with nothing. Fewer words than a shingle has: the whole sequence is the one shingle.
Repeated rows are links. Where ids repeat or are null, rows are numbered: each gives a row of its own, and a component's id is the
smallest that is not null. Columns other than the id and the text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_filter, list_array, map_batches, materialised
from .ngram_join import MARK_COLUMNS, class_components, component_of_each, frequencies, keep_first_of_each, passes, resolved, shingles, signed_sets

#: Words of a shingle, and least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Permutations, of which each gives two values, and values of a band.
PERMUTATIONS, ROWS = 64, 4
#: Shingles hashed at a time.
CHUNK = 2048


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """Numbers to mix in, and odd factors; a product with an odd factor is a permutation of the 64-bit numbers."""
    mixed, factors = np.random.default_rng(11).integers(0, 2**64, (2, PERMUTATIONS), dtype=np.uint64)
    return mixed, factors | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least and greatest hash of a set that is not empty under each permutation, in turns."""
    mixed, factors = _permutations()
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    out[:] = np.uint64(2**64 - 1), np.uint64(0)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), CHUNK):
            h = (shingles[at : at + CHUNK, None] ^ mixed) * factors
            np.minimum(out[:, 0], h.min(axis=0), out=out[:, 0])
            np.maximum(out[:, 1], h.max(axis=0), out=out[:, 1])
    return out.ravel()


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets as their signatures have it."""
    return float((a == b).mean())


def bands(values: np.ndarray) -> np.ndarray:
    """A hash of each band and its number."""
    parts = values.reshape(-1, ROWS)
    with np.errstate(over="ignore"):
        out = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(ROWS):
            out = (out ^ parts[:, k]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out


def banded_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n``, ``sig`` (16 bytes that stand for the set; null: empty) and ``bands``, none of a set too small to resemble another."""

    def work(batch: pa.RecordBatch) -> dict:
        sizes, sigs, keys = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text, words)
            n = len(s)
            sizes.append(n)
            sigs.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
            keys.append(bands(signature(s)).view(np.int64) if n and 100 * n >= percent * (n + 1) else np.zeros(0, np.int64))
        return {"doc_id": batch.column("doc_id"), "n": sizes, "sig": sigs, "bands": list_array(keys, pa.int64())}

    return map_batches(docs, "doc_id bigint, n int, sig binary, bands array<bigint>", work)


def _passes(a: str, b: str, percent: int, last: bool) -> Column:
    """Lengths that allow the similarity and, in the last round, all filters of rows of rare shingles."""
    if last:
        return passes(a, b, percent, True)
    n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _by_rare_shingles(rows: DataFrame, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """For the documents of ``rows``, whose tokens are bands, a row for each shingle among the rarest of the set that a document of another
    component has there too, however many bands the two share; and which of the pairs that meet so share a band. What is rare is counted
    over the documents of ``rows``: any order of all shingles gives the same links."""
    held = materialised(rows.groupBy("doc_id").agg(F.first("comp").alias("comp"), F.collect_set("token").alias("bands")))
    ids = held.select("doc_id")
    texts = materialised(docs.where(id_filter(ids, "doc_id")(F.col("doc_id"))).join(ids, "doc_id", "left_semi"))
    signed = materialised(signed_sets(texts, words, percent, frequencies(texts)))
    rare = signed.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token")).join(held.select("doc_id", "comp"), "doc_id")
    shared = rare.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where(F.col("low") != F.col("high"))
    finer = rare.join(shared.select("token"), "token").join(signed.select("doc_id", *MARK_COLUMNS), "doc_id")

    def share_a_band(pairs: DataFrame) -> DataFrame:
        left, right = (held.select(F.col("doc_id").alias(c), F.col("bands").alias(f"bands_{c}")) for c in ("a", "b"))
        return pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b")

    return materialised(finer), share_a_band


def _linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    signed = materialised(banded_sets(docs, words, percent))
    members = signed.select("doc_id", "n", "sig")
    classes = materialised(members.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("rep")))
    reps = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = reps.select("doc_id", "n", F.explode("bands").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > 1)
    rows = materialised(rows.join(shared, "token"))
    degree = rows.groupBy("doc_id").agg(F.sum("k").alias("degree"))
    rows = materialised(rows.drop("k").join(degree, "doc_id"))
    labels = resolved(rows, lambda open_rows: _by_rare_shingles(open_rows, docs, words, percent), docs, words, percent, _passes)
    return class_components(members, classes, labels)


def near_copies(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: ``doc_id, n_shingles, component_id``, the smallest id reachable by links. ``percent`` is 80 or more, for which
    the bands are made."""
    if percent < 80:
        raise ValueError("bands of four values find similarities of 0.8 and more")
    return component_of_each(df, lambda docs: _linked(docs, words, percent), id_col, text_col)


def keep_one(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row, that of the smallest id, of each component."""
    return keep_first_of_each(df, lambda docs: _linked(docs, words, percent), id_col, text_col)
