"""Anchoring quotes to the blocks that hold them.

The join on containment has no equality for quotes that name no document, so candidates are found first by what a block must have
to hold a quote: the quote's inner words, up to three of them, or, where it has no inner word, its first characters. Keys
are joined with the hash of a text only; texts come in for the pairs that are left, and only these are compared. An empty quote is
held by nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

#: Lengths of the prefixes that are tried after the whole quote; fixed values.
PREFIXES = (120, 60, 30)
#: Most inner words, and most first characters, of a quote that make its key.
INNER, FRONT = 3, 3


def probes(quote: Column) -> Column:
    """The quote, the quote with single spaces, and that one's prefixes, of three characters or more."""
    tidy = squeeze(quote)
    found = F.array(quote, tidy, *[F.left(tidy, F.lit(n)) for n in PREFIXES])
    return F.filter(found, lambda p: F.length(p) >= 3)


def _words(s: Column) -> Column:
    return F.split(s, r"\s+")


def _pieces(parts: Column, n: int, glue: str) -> Column:
    """Hashes of the distinct runs of ``n`` elements."""
    starts = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.lit(f"{n}{glue}"), F.array_join(F.slice(parts, i, n), glue))))


def _fronts(letters: Column, n: int) -> Column:
    """Hashes of the distinct runs of ``n`` characters."""
    run = lambda i: F.xxhash64(F.lit(str(n)), F.concat(*[F.get(letters, i + k) for k in range(n)]))
    starts = F.when(F.size(letters) >= n, F.sequence(F.lit(0), F.size(letters) - n)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.array_distinct(F.transform(starts, run))


def contains_join(quotes: DataFrame, texts: DataFrame, quote: str, text: str) -> DataFrame:
    """Pairs of a row of ``quotes`` and a row of ``texts`` whose text holds the quote. Column names must differ."""
    words = _words(F.col(quote))
    inner = F.least(F.size(words) - 2, F.lit(INNER))
    front = F.least(F.length(quote), F.lit(FRONT))
    by_words = F.xxhash64(F.concat(inner.cast("string"), F.lit(" ")), F.array_join(F.slice(words, 2, F.greatest(inner, F.lit(0))), " "))
    by_front = F.xxhash64(front.cast("string"), F.left(F.col(quote), front))
    asked = quotes.where(F.length(quote) > 0).withColumns({"__n": F.when(inner >= 1, inner).otherwise(-front), "__k": F.when(inner >= 1, by_words).otherwise(by_front)})
    kinds = sorted(r["__n"] for r in asked.select("__n").distinct().collect())  # at most INNER + FRONT of them
    of = [_pieces(F.col("__w"), n, " ") if n > 0 else _fronts(F.col("__c"), -n) for n in kinds]
    keyed = texts.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), F.col(text))})
    if not kinds:
        return keyed.join(asked, keyed["__a"] == asked["__k"]).drop("__a", "__b", "__n", "__k")  # no rows
    # The keys of the quotes, not the texts, decide what is joined; equal texts are one here.
    split = keyed.withColumns({"__w": _words(F.col(text)), "__c": F.split(F.col(text), "")})
    found = split.select("__a", "__b", F.explode(F.concat(*of)).alias("__k")).join(asked.select("__k").distinct(), "__k").distinct()
    return found.join(asked, "__k").drop("__k", "__n").join(keyed, ["__a", "__b"]).where(F.contains(F.col(text), F.col(quote))).drop("__a", "__b")


def first_match(quotes: DataFrame, texts: DataFrame, key: str, quote: str, order: list[str], text: str = "text") -> DataFrame:
    """Each quote with its first block by ``order``, for the first of its probes that occurs at all; unmatched quotes stay.

    Returns ``key``, ``probe_pos``, ``probe`` and the columns of ``order``.
    """
    asked = quotes.select(key, F.posexplode(probes(F.col(quote))).alias("probe_pos", "probe"))
    hits = contains_join(asked, texts, "probe", text)
    best = hits.groupBy(key).agg(F.min(F.struct("probe_pos", *order, "probe")).alias("hit"))
    return quotes.select(key).join(best, key, "left").select(key, "hit.probe_pos", "hit.probe", *[f"hit.{c}" for c in order])


def resolve(hits: DataFrame, quotes: DataFrame, key: str, block: str, order: str) -> DataFrame:
    """How many blocks hold each quote, the first six of them, and ``missing``, ``found`` or ``ambiguous``."""
    found = hits.groupBy(key).agg(F.count("*").alias("n_hits"), F.sort_array(F.collect_list(F.struct(order, block))).alias("__hits"))
    out = quotes.select(key).join(found, key, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
    verdict = F.when(F.col("n_hits") == 0, "missing").when(F.col("n_hits") == 1, "found").otherwise("ambiguous")
    return out.select(key, "n_hits", F.transform(F.slice("__hits", 1, 6), lambda h: h[block]).alias("first_hits"), verdict.alias("verdict"))


def orphans(notes: DataFrame, texts: DataFrame, edits: DataFrame) -> DataFrame:
    """Text notes whose quote is no longer in their block: ``orphan``, or ``edited quote`` where the block has an edit."""
    own = notes.where(F.col("kind") == "text").select("doc_id", "id", "block", "exact")
    now = own.join(texts.select("doc_id", F.col("block_id").alias("block"), "text"), ["doc_id", "block"], "left")
    lost = now.where(F.col("text").isNull() | ~F.contains("text", "exact"))
    edited = edits.groupBy("doc_id", "block").agg(F.lit(True).alias("edited"))
    return lost.join(edited, ["doc_id", "block"], "left").select("doc_id", "id", "block", F.when(F.col("edited"), "edited quote").otherwise("orphan").alias("state"))


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
