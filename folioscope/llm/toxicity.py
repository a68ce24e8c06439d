"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each category's logistic model sees the words of a text and the earlier
categories' probabilities; in training these are out-of-fold predictions, so a later model sees earlier ones as it will meet
them. The first ``KINDS`` categories are learned: labelled toxic documents fall into kinds by the features that
they hold (spherical k-means), such as the languages of their insults. The last is the label itself. A text is toxic where the
last category's probability reaches the threshold that did best on out-of-fold predictions.

Fitting takes at most ``SAMPLE`` labelled documents, those whose hash of id is smallest. Features are all words
whose log-likelihood ratio says, at the level of ``LEAST_RATIO``, that they come with toxicity; their number is not bounded
otherwise. Prediction covers all rows and whole texts.

Labels beyond one a document count as toxic if any is; labels of no document, and null labels, teach nothing; null text counts
as empty. Of repeated rows each gives a row. Without both classes among the labels all probabilities are the share of toxic
labels, or 0. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, materialised
from .linear import Sparse

SAMPLE, FOLDS, MIN_DOCS, KINDS = 5000, 5, 3, 3
#: Twice the log-likelihood ratio from which a feature counts: one in a thousand by chance.
LEAST_RATIO = 10.83
#: Where out-of-fold predictions do not say otherwise.
THRESHOLD = 0.5
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class Chain:
    vocabulary: dict[str, int]
    names: list[str]
    weights: list[np.ndarray]
    prior: float
    threshold: float = THRESHOLD

    def rows(self, texts: list[str]) -> Sparse:
        """The vocabulary's features in each text."""
        known = self.vocabulary
        return Sparse([sorted(known[w] for w in words_of(t) if w in known) for t in texts], len(known))

    def probabilities(self, x: Sparse) -> np.ndarray:
        out = np.zeros((len(x), len(self.names)))
        if not self.weights:
            return out + self.prior
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(x.times(w, out[:, :k]))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Sparse, dense: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, each step solved by conjugate gradients. ``dense`` are columns beside ``x``; the last
    weight is the intercept, which is not penalised."""
    n = x.width + dense.shape[1] + 1
    w = np.zeros(n)
    ridge = np.full(n, penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x.times(w, dense))
        gradient = x.back(p - y, dense) + ridge * w
        curve = np.maximum(p * (1 - p), 1e-9)
        scale = 1 / (x.back_squares(curve, dense) + ridge)
        step, r = np.zeros(n), gradient.copy()
        z = scale * r
        d, rz = z.copy(), (r * z).sum()
        for _ in range(60):
            if rz < 1e-14:
                break
            q = x.back(curve * x.times(d, dense), dense) + ridge * d
            a = rz / (d * q).sum()
            step += a * d
            r -= a * q
            z = scale * r
            rz, old = (r * z).sum(), rz
            d = z + rz / old * d
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit_chain(x: Sparse, targets: np.ndarray, names: list[str], vocabulary: dict[str, int], folds: np.ndarray) -> Chain:
    """``targets`` has a column for each category; ``folds`` gives each row's fold."""
    weights: list[np.ndarray] = []
    out_of_fold = np.zeros((len(x), len(names)))
    for k in range(len(names)):
        earlier = out_of_fold[:, :k]
        for fold in np.unique(folds):
            rest = folds != fold
            if rest.any():
                w = fit_linear(x.take(rest), earlier[rest], targets[rest, k])
                out_of_fold[~rest, k] = _sigmoid(x.take(~rest).times(w, earlier[~rest]))
        weights.append(fit_linear(x, earlier, targets[:, k]))
    return Chain(vocabulary, names, weights, float(targets[:, -1].mean()), best_threshold(out_of_fold[:, -1], targets[:, -1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the stretch of thresholds with the best F1 score; between 0.1 and 0.9."""
    grid = np.arange(10, 91) / 100
    hits = np.array([((p >= t) & (y > 0.5)).sum() for t in grid])
    score = 2 * hits / np.maximum(np.array([(p >= t).sum() for t in grid]) + (y > 0.5).sum(), 1)
    best = grid[score >= score.max() - 1e-12]
    return float(best[len(best) // 2]) if score.max() > 0 else THRESHOLD


def kinds_of(x: Sparse, y: np.ndarray, kinds: int = KINDS, turns: int = 20) -> np.ndarray:
    """A column for each kind of toxic row: 1 for the rows of that kind. Rows without a feature have none.

    Spherical k-means; the first centre is the mean, the next are the rows that are farthest from all centres before."""
    out = np.zeros((len(y), kinds))
    on = np.flatnonzero((y > 0.5) & (x.sizes > 0))
    if not len(on):
        return out
    rows = x.take(on)
    unit = rows.dense() / np.sqrt(rows.sizes)[:, None]
    centres = [unit.mean(axis=0)]
    for _ in range(kinds):
        near = np.max([(unit * c).sum(axis=1) / max(float(np.sqrt((c * c).sum())), 1e-9) for c in centres], axis=0)
        centres.append(unit[int(np.argmin(near))])
    centres = np.array(centres[1:])
    kind = None
    for _ in range(turns):
        now = np.argmax(np.array([(unit * c).sum(axis=1) / max(float(np.sqrt((c * c).sum())), 1e-9) for c in centres]), axis=0)
        if kind is not None and (now == kind).all():
            break
        kind = now
        centres = np.array([unit[kind == k].sum(axis=0) if (kind == k).any() else centres[k] for k in range(kinds)])
    out[on, kind] = 1
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Chain:
    """A chain fitted to the labelled documents of ``docs``. Counts and features are made by Spark; the driver gets the features of
    at most ``sample`` rows."""
    names = [*(f"kind_{k + 1}" for k in range(KINDS)), label_col]
    own = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    total = own.count()
    if total > sample:  # a cut by hash leaves about as many rows; the sort below then is over few rows
        own = own.where(F.col("h") < int(-(2**63) + 2**64 * min(1.0, 1.2 * sample / total)))
    own = own.orderBy("h").limit(sample)
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(own.select("doc_id", "y")), "doc_id")  # at most sample rows
    # Of rows with one id, all of which a label is about, the fullest text counts.
    texts = texts.groupBy("doc_id").agg(F.max("y").alias("y"), F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))

    def split(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "features": [sorted(words_of(t)) for t in batch.column("text").to_pylist()]}

    held = materialised(map_batches(texts, "doc_id bigint, y int, features array<string>", split))
    sums = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = sums["n"], sums["p"]
    if not 0 < p < n:
        return Chain({}, names, [], p / n if n else 0.0)
    each = held.select("doc_id", "y", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.count("*").alias("docs"), F.sum("y").alias("hits")).where(F.col("docs") >= MIN_DOCS)
    expected = F.col("docs") * F.lit(p / n)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    ratio = 2 * (part(F.col("hits"), expected) + part(F.col("docs") - F.col("hits"), F.col("docs") - expected))
    counts = materialised(counts.where((F.col("hits") > expected) & (ratio >= LEAST_RATIO)).select("feature"))
    vocabulary = {r["feature"]: i for i, r in enumerate(counts.orderBy("feature").collect())}  # of at most sample texts
    on = each.join(F.broadcast(counts), "feature").groupBy("doc_id").agg(F.collect_list("feature").alias("on"))
    rows = held.select("doc_id", "y").join(on, "doc_id", "left").orderBy("doc_id").collect()
    x = Sparse([sorted(vocabulary[f] for f in r["on"] or ()) for r in rows], len(vocabulary))
    y = np.array([float(r["y"] > 0) for r in rows])
    folds = np.array([hash((r["doc_id"], 7)) % FOLDS for r in rows])
    return fit_chain(x, np.column_stack([kinds_of(x, y), y]), names, vocabulary, folds)


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` each, ``n_terms`` (vocabulary features in the text) and ``toxic`` of every row."""
    names, least = chain.names, chain.threshold if threshold is None else threshold

    def work(batch: pa.RecordBatch) -> dict:
        x = chain.rows(batch.column("text").to_pylist())
        p = chain.probabilities(x)
        return {"doc_id": batch.column("doc_id"), **{f"p_{n}": p[:, k] for k, n in enumerate(names)}, "n_terms": x.sizes, "toxic": p[:, -1] >= least}

    schema = ", ".join(["doc_id bigint", *(f"p_{n} double" for n in names), "n_terms bigint", "toxic boolean"])
    return map_batches(id_and_text(df, id_col, text_col), schema, work)


def reject(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """``df`` without the rows that the chain calls toxic."""
    least = chain.threshold if threshold is None else threshold

    @F.pandas_udf("boolean")
    def bad(texts):
        import pandas as pd

        return pd.Series(chain.probabilities(chain.rows([t or "" for t in texts]))[:, -1] >= least)

    return df.where(~bad(F.col(text_col)))
