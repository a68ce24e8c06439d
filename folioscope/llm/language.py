"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest phrases that
occur in that language's text; the language that needs the fewest phrases for each character wins. The transitions by a
language's most frequent letters are a dense table of integers, those by all its other letters a sorted list, so that
many blocks of text walk an automaton in step with a few numpy operations a character, whatever the script. A letter that the
language's text does not have begins a phrase, which goes on with what follows it.

Letters are lower-cased, every run of other characters is one separator. Texts are parsed in blocks of ``BLOCK``
characters (a phrase ends at a block's end); every block counts. Null text, and text without a letter, is ``und`` with
score 0. Languages tie in alphabetical order. Rows without label or text teach nothing; with nothing learned, all is ``und``.
Repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Characters of labelled text taken for each language, and the characters of the pieces that it is taken in.
SAMPLE_CHARS, SAMPLE_PIECE = 40_000, 400
#: Ranges of hashes, of each of which the piece with the smallest hash is taken.
SALTS = 256
#: Letters, the separator among them, whose transitions are a dense table; the others' are a list.
BLOCK, WIDTH = 1024, 63
UNKNOWN = "und"


def symbols(text: str) -> np.ndarray:
    """Code points of the letters, lower-cased; 0 for each run of other characters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    codes = np.where(_letters()[codes], codes, 0)
    if len(codes):
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
    return codes


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Automaton:
    """Suffix automaton of a sequence of code points."""

    def __init__(self, sequence: np.ndarray):
        link, length = [-1], [0]
        rows: list[dict[int, int]] = [{}]
        last = 0
        for c in sequence.tolist():
            cur = len(rows)
            rows.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in rows[p]:
                rows[p][c] = cur
                p = link[p]
            if p != -1:
                q = rows[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(rows)
                    rows.append(dict(rows[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and rows[p].get(c) == q:
                        rows[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        letters, times = np.unique(sequence, return_counts=True)
        letters = letters[np.argsort(-times, kind="stable")]
        self.letters = np.sort(letters)
        # The classes of the letters: the most frequent are columns of the table; column 0 belongs to letters that do not occur.
        order = {int(c): k + 1 for k, c in enumerate(letters)}
        self.classes = np.array([order[int(c)] for c in self.letters], np.int64)
        self.table = np.full((len(rows), min(len(letters), WIDTH) + 1), -1, np.int32)
        self.many = len(letters) + 1
        keys, to = [], []
        for s, row in enumerate(rows):
            for c, t in row.items():
                if order[c] <= WIDTH:
                    self.table[s, order[c]] = t
                else:
                    keys.append(s * self.many + order[c])
                    to.append(t)
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.array(keys, np.int64)[by], np.array(to, np.int64)[by]

    def classed(self, codes: np.ndarray) -> np.ndarray:
        """The classes of code points; 0 for those that the sequence does not have."""
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, self.classes[at], 0)

    def _next(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        width = self.table.shape[1]
        if not len(self.keys):
            return self.table.ravel()[state * width + c].astype(np.int64)
        out = self.table.ravel()[state * width + np.where(c < width, c, 0)].astype(np.int64)
        rare = np.flatnonzero(c >= width)
        if len(rare):
            key = state[rare] * self.many + c[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.to[at], -1)
        return out

    def phrases(self, columns: list[np.ndarray], rows: int) -> np.ndarray:
        """Phrases of each block. ``columns[k]`` holds the classes of the k-th letters of the blocks that are longer than k, longest first."""
        root = self._next(np.zeros(self.many, np.int64), np.arange(self.many))
        state, count = np.zeros(rows, np.int64), np.ones(rows, np.int64)
        for column in columns:
            n = len(column)
            to = self._next(state[:n], column)
            failed = to < 0
            count[:n] += failed
            # the phrase ends before this letter and a new one begins with it
            state[:n] = np.where(failed, np.maximum(root[column], 0), to)
        return count


def build(samples: dict[str, list[str]]) -> dict[str, Automaton]:
    """An automaton of each language's sample texts."""
    coded = {k: np.concatenate([np.append(symbols(t), 0) for t in v])[:SAMPLE_CHARS] for k, v in samples.items() if v}
    return {k: Automaton(coded[k]) for k in sorted(coded) if (coded[k] != 0).any()}


def predict(model: dict[str, Automaton], texts: list[str | None]) -> tuple[list[str], list[float]]:
    names = list(model)
    coded = [symbols(t) if t else np.empty(0, np.uint32) for t in texts]
    known = [bool(names) and bool((c != 0).any()) for c in coded]
    blocks, owner = [], []
    for i, c in enumerate(coded):
        if known[i]:
            for at in range(0, len(c), BLOCK):
                blocks.append(c[at : at + BLOCK])
                owner.append(i)
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not blocks:
        return langs, scores
    sizes = np.array([len(b) for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    owner_of = np.array(owner)[order]
    total = np.bincount(owner_of, sizes[order], len(texts))
    alive = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max()) + 1), "right").tolist()
    seen, place = np.unique(np.concatenate([blocks[j] for j in order]), return_inverse=True)
    edges = np.concatenate(([0], np.cumsum(sizes[order])))[:-1]
    # place[edges[:n] + k] are the k-th letters of the n blocks that are longer than k
    rates = []
    for name in names:
        letters = model[name].classed(seen)[place]
        columns = [letters[edges[:n] + k] for k, n in enumerate(alive)]
        rates.append(np.bincount(owner_of, model[name].phrases(columns, len(blocks)), len(texts)))
    rates = np.stack(rates) / np.maximum(total, 1)
    best = np.argmin(rates, axis=0)
    for i in np.flatnonzero(known):
        r = np.sort(rates[:, i])
        langs[i] = names[best[i]]
        scores[i] = float(min(1.0, max(0.0, 1 - r[0] / r[1]))) if len(r) > 1 else 1.0
    return langs, scores


def samples(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, list[str]]:
    """A bounded sample of each language's text, the same at each run.

    All labelled texts are cut into pieces of ``SAMPLE_PIECE`` characters, each with a hash of its document's id and its place. Of each
    of ``SALTS`` ranges of hashes the piece with the smallest is taken: ``SALTS * SAMPLE_PIECE`` characters a language at most,
    from one document if there is only one. Hashes alone are compared; texts are read again for the pieces that were taken.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("id"), F.col(text_col).alias("text"))
    last = ((F.length("text") - 1) / SAMPLE_PIECE).cast("int")
    pieces = rows.select("lang", "id", F.explode(F.sequence(F.lit(0), last)).alias("k")).withColumn("h", F.xxhash64("id", "k"))
    salt = F.pmod(F.col("h"), F.lit(SALTS)).alias("salt")
    least = pieces.groupBy("lang", salt).agg(F.min("h").alias("h"), F.min_by("id", "h").alias("id"), F.min_by("k", "h").alias("k"))
    chosen = rows.join(F.broadcast(least.drop("salt")), ["lang", "id"])  # at most SALTS rows a language
    found: dict[str, list] = {}
    for r in chosen.select("lang", "h", F.substring("text", 1 + F.col("k") * SAMPLE_PIECE, F.lit(SAMPLE_PIECE)).alias("piece")).distinct().collect():
        found.setdefault(r["lang"], []).append((r["h"], r["piece"]))
    return {k: [p for _, p in sorted(v)] for k, v in found.items()}


def identify(df: DataFrame, model: dict[str, Automaton], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row. The score is 0 where the two best languages tie."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most 2 x SAMPLE_CHARS states a language

    def work(batch: pa.RecordBatch) -> dict:
        langs, scores = predict(shared.value, batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

    rows = df.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")
    return map_batches(rows, "doc_id bigint, lang_pred string, score double", work)
