"""Collocations by vertical positional inverted lists.

1. Each block of texts of one language is inverted: every word has the list of the places where it stands. Pieces of a text are a place
   apart, so nothing adjoins across them. The lists are written once; all later steps read them and no text.
2. The lists of frequent phrases of k - 1 words are extended: their places are merge-joined with the postings of the words at the
   place behind them, if the phrase that begins one place later is frequent too. The length of a joined list is the exact frequency
   in its block, and the sum over blocks that of the corpus, since no occurrence leaves its block.
3. Which words and phrases are frequent is known to the blocks by tables of bits of a fixed size. A bit that another phrase has set
   only lets a list through that the sum then drops; so the fuller a table is, the less it saves, and nothing is lost.
4. Candidates are joined with the frequencies of their parts, scored in decimals and ranked.

Null text has no words; null languages are one language, ``und``. Repeated rows count as often as they are there; ids are not read and may
be null or repeat. Columns other than the text and the language are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, bit_table, keep_only, map_batches, materialised

#: Least occurrences of a candidate, words of the longest, share in hundredths of a phrase's occurrences inside a longer one that
#: drops it, and phrases returned of each language.
LEAST, LONGEST, INSIDE, FIRST = 10, 3, 50, 2000
#: Bytes of text of one language that are inverted together, and of all languages that a task holds.
BLOCK, HELD = 2 << 20, 16 << 20
#: Words that a task counts phrases of, where there are more of them than cores: the more, the fewer rows it has to send.
TASK_WORDS = 8_000_000
#: A block is a row of over a megabyte, so the writer has to look at the size of its pages after every row.
WRITTEN = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: A language's candidates are ranked in so many parts before the best of each part are ranked together.
PARTS = 64
_SEED = 42
#: Line ends and the signs that end a piece become one sign, tabulators spaces, A-Z a-z.
_TABLE = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands between pieces; no word can be this sign, since it ends pieces.
_END = b"."


def tokens(text: str) -> list[bytes]:
    """A text's words in order, with a mark behind each piece."""
    return (text.encode().translate(_TABLE).replace(b"\n", b" . ") + b" .").split()


def inverted(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of ``texts``, how often each stands there, and their places, word after word."""
    code: defaultdict[bytes, int] = defaultdict(count().__next__)
    code[_END]
    each = [np.fromiter(map(code.__getitem__, tokens(t)), np.int32) for t in texts]
    codes = np.concatenate(each) if each else np.zeros(0, np.int32)
    places = np.argsort(codes, kind="stable").astype(np.int32)
    lengths = np.bincount(codes, minlength=1)
    return list(code)[1:], lengths[1:], places[lengths[0] :]


def postings(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, n, words, lengths, places``: a row a block, ``n`` its words, ``lengths`` those of the words' lists in ``places``."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("lengths", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])

    def block(lang: str, texts: list[str]) -> pa.RecordBatch:
        words, lengths, places = inverted(texts)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.array(words, pa.binary()).cast(pa.string()), pa.array(lengths, pa.int32()), pa.array(places, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(places)], pa.int64()), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(__name__)
        held: defaultdict[str, list[str]] = defaultdict(list)
        sizes: defaultdict[str, int] = defaultdict(int)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[lang].append(text)
                sizes[lang] += len(text)
                if sizes[lang] >= BLOCK or sum(sizes.values()) >= HELD:
                    most = max(sizes, key=sizes.get)
                    del sizes[most]
                    yield block(most, held.pop(most))
        for lang, texts in held.items():
            yield block(lang, texts)

    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return rows.mapInArrow(run, "lang string, n bigint, words array<string>, lengths array<int>, places array<int>")


class Lists:
    """The lists of a block's phrases, ordered by place: ``at`` the places and ``phrase`` whose they are. A phrase is a row of ``words``."""

    def __init__(self, at: np.ndarray, phrase: np.ndarray, words: np.ndarray):
        self.at, self.phrase, self.words = at, phrase, words

    def only(self, frequent: np.ndarray) -> Lists:
        on = frequent[self.phrase]
        return Lists(self.at[on], self.phrase[on], self.words)

    def lengths(self) -> np.ndarray:
        return np.bincount(self.phrase, minlength=len(self.words))

    def extended(self, words: Lists) -> Lists:
        """The lists of the phrases that are longer by one of ``words``, and of which both the front and the rest are in these lists."""
        behind = np.searchsorted(self.at, self.at + 1)
        met = np.flatnonzero(behind < len(self.at))
        met = met[self.at[behind[met]] == self.at[met] + 1]
        # The merge-join with the postings of the words behind the phrase.
        end = self.at[met] + self.words.shape[1]
        last = np.searchsorted(words.at, end)
        on = np.flatnonzero(last < len(words.at))
        on = on[words.at[last[on]] == end[on]]
        key = self.phrase[met[on]].astype(np.int64) * len(words.words) + words.phrase[last[on]]
        kinds, which = np.unique(key, return_inverse=True)
        front, word = np.divmod(kinds, max(1, len(words.words)))
        return Lists(self.at[met[on]], which, np.column_stack((self.words[front], word)) if len(kinds) else np.zeros((0, self.words.shape[1] + 1), np.int64))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(bits), (hashes >> np.uint64(32)) % np.uint64(bits)


def _set(table: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Which of the keys have their bits in ``table``."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(k, _SEED) for k in keys), np.uint64, len(keys))
    out = np.ones(len(keys), bool)
    for p in _places(hashes, 64 * len(table)):
        out &= (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)).astype(np.int64) & 1).astype(bool)
    return out


def _bits(frequent: DataFrame, bits: int) -> np.ndarray:
    """The table of bits of ``lang, phrase``; the hash is that of ``_set``."""
    h = F.xxhash64(F.concat("lang", F.lit("\n"), "phrase"))
    both = F.array(F.pmod(h.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits)))
    return bit_table(frequent.select(F.explode(both).alias("p")), bits)


def _phrase_counts(blocks: DataFrame, tables: list[np.ndarray], least: int) -> DataFrame:
    """``lang, phrase, f`` of the phrases of one word more than ``tables`` has entries, that occur ``least`` times."""
    shared = blocks.sparkSession.sparkContext.broadcast(tables)  # bits of a fixed number

    def work(batch: pa.RecordBatch) -> dict | None:
        out: tuple[list, list, list] = ([], [], [])
        for lang, words, lengths, places in zip(batch.column("lang").to_pylist(), *(batch.column(c) for c in ("words", "lengths", "places")), strict=True):
            words, lengths, places = words.values, lengths.values.to_numpy(), places.values.to_numpy()
            order = np.argsort(places, kind="stable")
            lists = base = Lists(places[order], np.repeat(np.arange(len(words)), lengths)[order], np.arange(len(words))[:, None])
            front = f"{lang}\n".encode()
            for table in shared.value:
                spelled = _spelled(words, lists.words)
                lists = lists.only(_set(table, [front + p for p in spelled.cast(pa.binary()).to_pylist()]))
                base = lists if lists.words.shape[1] == 1 else base
                lists = lists.extended(base)
            if len(lists.words):
                out[0].append(pa.repeat(lang, len(lists.words)))
                out[1].append(_spelled(words, lists.words))
                out[2].append(lists.lengths())
        if not out[0]:
            return None
        return {"lang": pa.concat_arrays(out[0]), "phrase": pa.concat_arrays(out[1]), "f": np.concatenate(out[2])}

    counted = map_batches(blocks.select("lang", "words", "lengths", "places"), "lang string, phrase string, f bigint", work)
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _spelled(words: pa.Array, phrases: np.ndarray) -> pa.Array:
    parts = [words.take(pa.array(phrases[:, k])) for k in range(phrases.shape[1])]
    return pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]


def frequent_phrases(df: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", bits: int = FILTER_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n``, the words of each language, and for each number of words ``lang, phrase, f`` of the phrases that occur ``least`` times."""
    blocks = materialised(postings(df, text_col, lang_col), **WRITTEN)
    words = blocks.agg(F.sum("n")).first()[0] or 0
    blocks = blocks.coalesce(max(blocks.sparkSession.sparkContext.defaultParallelism, -(-words // TASK_WORDS)))
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "lengths")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase"))
    levels = [materialised(each.agg(F.sum("w.lengths").alias("f")).where(F.col("f") >= least))]
    tables: list[np.ndarray] = []
    for _ in range(longest - 1):
        tables.append(_bits(levels[-1], bits))
        levels.append(materialised(_phrase_counts(blocks, tables, least)))
    return totals, levels


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def scored(levels: list[DataFrame]) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of each candidate at its lowest-scoring cut, of equals the first.

    Both parts of a frequent phrase are frequent, so no candidate loses a part in the joins."""
    parts = reduce(DataFrame.unionByName, levels)
    left, right = parts.select("lang", F.col("phrase").alias("front"), F.col("f").alias("l")), parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    every = []
    for size, level in enumerate(levels[1:], 2):
        split = F.split("phrase", " ", -1)
        cut = F.explode(F.sequence(F.lit(1), F.lit(size - 1))).alias("k")
        rows = level.select("lang", "phrase", F.col("f").alias("a"), F.lit(size).alias("words"), split.alias("w"), cut)
        every.append(rows.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("front"), F.array_join(F.slice("w", F.col("k") + 1, size), " ").alias("rest")))
    cuts = reduce(DataFrame.unionByName, every).join(left, ["lang", "front"]).join(right, ["lang", "rest"])
    # Decimals of 38 digits hold the products of a corpus of up to 10^15 words; a score is at most a million.
    cuts = cuts.withColumn("top", _exact(_exact(F.col("a")) * _exact(F.col("a"))) * F.lit(1000000).cast("decimal(7,0)")).withColumn("under", _exact(_exact(F.col("l")) * _exact(F.col("r"))))
    cuts = cuts.withColumn("score", F.expr("top div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))


def outermost(candidates: DataFrame, levels: list[DataFrame], inside: int = INSIDE) -> DataFrame:
    """``candidates`` without those whose words stand in a longer one that is ``inside`` hundredths or more as frequent."""
    within = lambda size, part: F.transform(F.sequence(F.lit(1), F.lit(size - part + 1)), lambda i: F.array_join(F.slice(F.split("phrase", " ", -1), i, part), " "))
    held = []
    for size, level in enumerate(levels[2:], 3):
        held += [level.select("lang", F.explode(within(size, part)).alias("phrase"), "f") for part in range(2, size)]
    if not held:
        return candidates
    most = reduce(DataFrame.unionByName, held).groupBy("lang", "phrase").agg(F.max("f").alias("__longer"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("__longer").isNull() | (100 * F.col("__longer") < inside * F.col("a"))).drop("__longer")


def ranked(candidates: DataFrame, first: int = FIRST) -> DataFrame:
    """The ``first`` of each language with their ``rank``. A language's candidates are ranked in parts, and then the best of all parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("__part")
    rows = candidates.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order)))
    rows = rows.where(F.col("rank") <= first).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return rows.where(F.col("rank") <= first).drop("__part")


def collocations(df: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, first: int = FIRST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, words, a, l, r, n, score``: each language's best phrases of two to ``longest`` words.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its parts at the cut that scores lowest, ``n`` how many words the language has,
    ``score`` floor(10^6 a^2 / (l r))."""
    totals, levels = frequent_phrases(df, least, longest, text_col, lang_col)
    top = ranked(outermost(scored(levels), levels, inside), first)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")
