"""Stages that turn ``documents`` into packed training sequences.

Each stage takes the rows that the stage before it kept and returns them in the same columns; the last returns the pieces of
packed sequences. A stage's own statistics cover all rows that it is given.

Null text counts as empty everywhere and stays null until it is packed, as a document of the closing id alone; null and empty texts
are no near copies of anything, and one of them stays as an exact copy. Of ties the smallest id stays; of repeated rows one does. An
empty table passes through every stage, and further columns pass through all but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import exact, ngram_join, packing, privacy, toxicity
from folioscope.llm.common import materialised, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain rejects. It is fitted to the labelled documents among ``docs``."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return ngram_join.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms taken out of the texts; ``n_chars`` follows the text."""
    from pyspark.sql import functions as F

    clean = privacy.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("privacy", sanitise), ("packing", pack)]
#: Trained models and tokenisation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the documents of ``sf_dir``. Each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
