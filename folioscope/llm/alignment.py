"""Alignment of two tokenisers over one text.

1. A text is encoded by a byte-level BPE tokeniser (A, of a space and the text) and by a piece model (B, which adds that space). Both break
   before a space that stands between other characters than white space, so texts are encoded by the parts between such spaces, each of which
   a worker remembers.
2. Token ends are marked in packed bitsets, one bit a byte, of all texts of a batch behind one another. The AND of both has the shared cuts;
   the rank of a cut, counted by population counts of words ahead and of its own word, is the number of tokens before it on either side,
   so two cuts that follow one another select the ranges of tokens of one group.
3. All pairs of tokens of a group are links. A text's distinct id pairs, with their links, are written with it.
4. A pair's count is the number of texts that have it linked. The ``KNOWN`` most frequent pairs are told to all tasks, which look their
   own up; pairs beyond these are joined.

A text whose tokens do not spell the space and the text has no tokens, nor has null or empty text: zeros, and no groups. Repeated rows are
rows of their own and count each; ids are only passed through and may be null or repeat. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_codec
from .common import id_and_text, list_array, map_batches, materialised, remembers

#: Pairs of which every task is told the counts; the others are joined.
KNOWN = 1 << 20
#: Entries of a worker's memo of encoded parts; it is emptied when full.
MEMO = 300_000
#: Bytes of texts that are aligned together.
TOGETHER = 1 << 20
#: Links from which on a group's pairs are counted by its distinct ids instead of being listed.
LARGE = 1 << 14
#: A space between two characters that are no white space.
_BREAK = re.compile(r"(?<=\S) (?=\S)")


def byte_values() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenisers, with the bytes of every token and the ids of each part met so far."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        values = byte_values()
        with open(byte_path) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(values[c] for c in token)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if kind == piece_codec.BYTE else p.replace(piece_codec.SPACE, " ").encode() for p, _, kind in piece_codec.PieceModel(piece_path).pieces]
        self.width_a, self.width_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # Each id as text with what may follow it: within a side, after A, after B.
        self.text = np.array([f"{i}{end}" for table, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for end in ends for i in range(len(table))], object)
        self.memo: dict[str, tuple[bytes, bytes] | bool | None] = {}

    def coded(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of a space and each part in both, as little-endian 32-bit integers; None where they do not spell it."""
        of_a, of_b, out = self.bytes_a, self.bytes_b, []
        left = self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)
        right = self.b.encode(parts, num_threads=1)
        for p, x, y in zip(parts, left, right, strict=True):
            x = x.ids
            raw = b" " + p.encode()
            same = b"".join([of_a[i] for i in x]) == raw == b"".join([of_b[i] for i in y])
            out.append((array("i", x).tobytes(), array("i", y).tobytes()) if same else None)
        return out

    def _learn(self, parts: set[str]) -> None:
        """What a space and each part are in both. False: not to be encoded alone, None: not spelled by its tokens."""
        fit = []
        for p in parts:
            if p and not p[0].isspace() and not p[-1].isspace() and piece_codec.SPACE not in p:
                fit.append(p)
            else:
                self.memo[p] = False
        self.memo.update(zip(fit, self.coded(fit), strict=True))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of each text in A and B; both empty where they do not spell it."""
        split = [t.split(" ") for t in texts]
        get, out = self.memo.get, []
        if len(self.memo) > MEMO:
            self.memo.clear()
        self._learn({p for parts in split for p in parts if p not in self.memo})
        for text, parts in zip(texts, split, strict=True):
            found = list(map(get, parts))
            if False in found:
                found = self._mended(_BREAK.split(text)) if text and piece_codec.SPACE not in text else [None]
            out.append((b"", b"") if None in found else (b"".join([x[0] for x in found]), b"".join([x[1] for x in found])))
        return out

    def _mended(self, parts: list[str]) -> list:
        """Parts with white space of their own; these are not remembered."""
        return [self.memo.get(p) or self.coded([p])[0] for p in parts]


@lru_cache(maxsize=1)
def load(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


remembers(__name__, load.cache_clear)


class EndBits:
    """Token ends as a packed bitset: bit ``n`` is set where a token ends behind byte ``n``."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.ahead = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @staticmethod
    def of(ends: np.ndarray, size: int) -> EndBits:
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[ends - 1] = True
        return EndBits(np.packbits(flags, bitorder="little").view("<u8"))

    def shared(self, other: EndBits) -> EndBits:
        return EndBits(self.words & other.words)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set up to each place, itself included."""
        word = places >> 6
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (places & 63)).astype(np.uint64)
        return self.ahead[word] + np.bitwise_count(self.words[word] & upto)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at ``begin``, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def groups(ids_a: np.ndarray, ids_b: np.ndarray, width_a: np.ndarray, width_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shared cuts of two sequences of tokens that spell the same bytes, and how many tokens of each stand before each cut."""
    ends_a, ends_b = np.cumsum(width_a[ids_a]), np.cumsum(width_b[ids_b])
    size = int(ends_a[-1]) if len(ends_a) else 0
    a, b = EndBits.of(ends_a, size), EndBits.of(ends_b, size)
    cuts = a.shared(b).select()
    return cuts, a.rank(cuts), b.rank(cuts)


def align_documents(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and ``pairs, links``, the distinct linked pairs, as
    A's id times ``2**32`` and B's id, and the links of each."""

    def work(batch: pa.RecordBatch) -> dict:
        pair, texts = load(byte_path, piece_path), batch.column("text").to_pylist()
        out: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links")}
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (held < TOGETHER or end == at):
                held += len(texts[end])
                end += 1
            for c, v in zip(out, _aligned(pair, texts[at:end]), strict=True):
                out[c] += list(v)
            at = end
        return {"doc_id": batch.column("doc_id"), **out, "pairs": list_array(out["pairs"], pa.int64()), "links": list_array(out["links"], pa.int64())}

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, links array<bigint>"
    return map_batches(id_and_text(df, id_col, text_col), schema, work)


def _aligned(pair: Pair, texts: list[str]) -> tuple:
    coded = pair.encode(texts)
    n_a, n_b = (np.array([len(c[k]) // 4 for c in coded], np.int64) for k in (0, 1))
    ids_a, ids_b = (np.frombuffer(b"".join([c[k] for c in coded]), "<i4").astype(np.int64) for k in (0, 1))
    cuts, upto_a, upto_b = groups(ids_a, ids_b, pair.width_a, pair.width_b)
    first_a, first_b = (np.concatenate(([0], x[:-1])) if len(x) else x for x in (upto_a, upto_b))
    size_a, size_b = upto_a - first_a, upto_b - first_b
    # Which text a group belongs to: texts end at shared cuts.
    doc_a = np.repeat(np.arange(len(texts)), n_a)
    doc = doc_a[first_a]
    n_groups = np.bincount(doc, minlength=len(texts))
    n_links = np.bincount(doc, size_a * size_b, len(texts)).astype(np.int64) if len(doc) else np.zeros(len(texts), np.int64)
    # A group's ids in a row: those of A with a bar behind the last, those of B with a semicolon.
    all_a, all_b = len(pair.bytes_a), len(pair.bytes_b)
    show_a, show_b = ids_a.copy(), ids_b + 2 * all_a
    show_a[upto_a - 1] += all_a
    show_b[upto_b - 1] += all_b
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.repeat(first_b, size_a)] = show_a
    order[np.arange(len(ids_b)) + np.repeat(upto_a, size_b)] = show_b
    ends = np.cumsum(n_a + n_b)
    digests = []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        digests.append(hashlib.sha256("".join(pair.text[order[a:b]].tolist())[:-1].encode()).hexdigest() if b > a else "")
    # Links: every token of A with the range of B's tokens of its group.
    large = size_a * size_b > LARGE
    group_a = np.repeat(np.arange(len(cuts)), size_a)
    many = np.where(large, 0, size_b)[group_a]
    key = np.repeat(ids_a, many) << 32 | ids_b[_ranges(first_b[group_a], many)]
    bounds = np.searchsorted(np.repeat(doc_a, many), np.arange(len(texts) + 1))
    found = [np.unique(key[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for g in np.flatnonzero(large).tolist():
        own, times = found[doc[g]]
        (x, i), (y, j) = (np.unique(ids[a:b], return_counts=True) for ids, a, b in ((ids_a, first_a[g], upto_a[g]), (ids_b, first_b[g], upto_b[g])))
        kinds, which = np.unique(np.concatenate((own, np.add.outer(x << 32, y).ravel())), return_inverse=True)
        found[doc[g]] = kinds, np.bincount(which, np.concatenate((times, np.outer(i, j).ravel())), len(kinds)).astype(np.int64)
    return n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), digests, [f[0] for f in found], [f[1] for f in found]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many rows each pair is linked, and whether that is the most of its A id."""
    counts = materialised(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    own = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(own).agg(F.max("n").alias("most"))
    return materialised(counts.select("pair", "n", own).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _most_frequent(counts: DataFrame, known: int) -> tuple[pa.Table, bool]:
    """The pairs that are counted often enough for no more than ``known`` to be so, and whether these are all."""
    step = F.floor(8 * F.log2("n"))
    held = sorted(((r["step"], r["pairs"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect()), reverse=True)  # at most 512 rows
    room = [at for (at, _), total in zip(held, np.cumsum([n for _, n in held]), strict=True) if total <= known]
    least = room[-1] if room else np.inf
    return counts.where(step >= F.lit(float(least))).toArrow(), len(room) == len(held)


def align(df: DataFrame, byte_path: str, piece_path: str, known: int = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    aligned = materialised(align_documents(df, byte_path, piece_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(aligned)
    often, whole = _most_frequent(counts, known)
    pairs = often.column("pair").to_numpy()
    order = np.argsort(pairs)
    # One more entry that no pair equals, so that every look-up has a place.
    keys, n, best = (np.append(often.column(c).to_numpy()[order], end) for c, end in (("pair", 2**62), ("n", 0), ("best", False)))
    shared = df.sparkSession.sparkContext.broadcast((keys, n.astype(np.int64), best.astype(np.int64)))  # at most ``known`` rows

    def work(batch: pa.RecordBatch) -> dict:
        keys, counted, is_best = shared.value
        flat, many = (batch.column(c).flatten().to_numpy() for c in ("pairs", "links"))
        bounds = np.concatenate(([0], np.cumsum(batch.column("pairs").value_lengths().to_numpy())))
        at = np.searchsorted(keys, flat)
        there = keys[at] == flat
        summed = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[bounds])
        out = {c: batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        out |= {"n_best": summed(is_best[at] * many * there), "count_sum": summed(counted[at] * many * there)}
        cut = np.concatenate(([0], np.cumsum(summed(~there))))
        for name, values in (("pairs", flat[~there]), ("links", many[~there])):
            out[name] = list_array([values[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64())
        return out

    columns = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    summed = map_batches(aligned, f"row bigint, {columns}, pairs array<bigint>, links array<bigint>", work)
    names = [c.split()[0] for c in columns.split(", ")]
    if whole:
        return summed.select(*names)
    summed = materialised(summed)
    rare = summed.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", "p.pairs", "p.links").join(counts, F.col("pairs") == F.col("pair"))
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("__best"), F.sum(F.col("n") * F.col("links")).alias("__sum"))
    both = summed.join(more, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))}).select(*names)
