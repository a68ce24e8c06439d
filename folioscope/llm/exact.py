"""Exact deduplication by deterministic block naming, in DataFrame functions only.

A text, with each run of white space as one space, is cut into blocks of ``BLOCK`` bytes. Distinct blocks are sorted, by a
hash and then by content, and each is replaced by its rank in that order, its name. Then adjacent names are paired, distinct
pairs are sorted and ranked in turn, and so on until one name is left of each text. Two texts have the same name and number
of blocks if and only if they are equal: names are ranks of contents, not hashes, so nothing can collide; and they are the
same however many partitions there are.

Contents are sent once. Where a hash stands for one content only, which is counted, its rank is that of the hash; where one
hash has two contents, the texts are cut again with contents, and these are ranked.

Null text counts as empty; all empty texts are equal. Of equal texts the row with the smallest id stays. Rows are told apart
even if their ids are equal or null: each row gives a row, equal texts are one group whatever their ids, and of several rows
with the smallest id one stays, which of them is not defined. Columns other than the id and the text are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, join_spread, materialised, without_ids

BLOCK = 16 << 10
#: Ranges of hashes within which ranks are counted on their own.
RANGES = 1024


def normalised(text: Column) -> Column:
    """Null as empty, and each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``name``, their rank by ``order``, whose first column is a 64-bit hash. Rows must differ in ``order``.

    Ranges of the hash are of like size; a range's offset is a sum over ``RANGES`` rows."""
    bits = RANGES.bit_length() - 1
    ranged = rows.withColumn("__range", F.shiftright(F.col(order[0]), 64 - bits))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__within", within).join(F.broadcast(offsets), "__range").withColumn("name", F.col("__ahead") + F.col("__within") - 1).drop("__range", "__ahead", "__within")


def _cut(df: DataFrame, id_col: str, text_col: str, block: int, hashed: Callable[[Column], Column], contents: bool) -> DataFrame:
    """``row, doc_id, text_sha256`` and ``cells``, for each block its hash and, if asked for, its content."""
    text = id_and_text(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", normalised(F.col("text")).alias("text"))
    raw = text.select("row", "doc_id", F.unhex(F.sha2("text", 256)).alias("text_sha256"), F.encode("text", "UTF-8").alias("raw"))
    last = F.greatest(F.lit(0), F.floor((F.length("raw") - 1) / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("raw"), i * block + 1, F.lit(block)))
    if contents:
        cells = F.transform(cut, lambda b: F.struct(hashed(b).alias("h"), b.alias("block")))
    else:
        cells = F.transform(cut, lambda b: F.struct(hashed(b).alias("h")))
    return raw.select("row", "doc_id", "text_sha256", cells.alias("cells"))


def _named_cells(df: DataFrame, id_col: str, text_col: str, block: int, hashed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The cut texts, and the name and number of each distinct block by the columns that single it out."""
    texts = materialised(_cut(df, id_col, text_col, block, hashed, contents=False))
    blocks = _cut(df, id_col, text_col, block, hashed, contents=True).select(F.explode("cells").alias("c")).select("c.h", "c.block")
    distinct = blocks.groupBy("h", "block").agg(F.count("*").alias("n"))
    counted = materialised(distinct.groupBy("h").agg(F.count("*").alias("contents"), F.sum("n").alias("n")))
    if counted.where(F.col("contents") > 1).isEmpty():
        return texts, materialised(_ranked(counted.select("h", "n"), ["h"])), ["h"]
    texts = materialised(_cut(df, id_col, text_col, block, hashed, contents=True))
    blocks = texts.select(F.explode("cells").alias("c")).select("c.h", "c.block")
    return texts, materialised(_ranked(blocks.groupBy("h", "block").agg(F.count("*").alias("n")), ["h", "block"])), ["h", "block"]


def name_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``row, doc_id, text_sha256`` (of the normalised text, bytes), ``blocks`` and ``name`` of every row; equal texts, and no
    others, agree in the last two."""
    texts, names, key = _named_cells(df, id_col, text_col, block, hashed)
    one = F.lit(1).cast("long").alias("blocks")
    single = texts.where(F.size("cells") == 1).select("row", "doc_id", "text_sha256", *[F.col("cells")[0][k].alias(k) for k in key])
    done = join_spread(single, names, key, "n").select("row", "doc_id", "text_sha256", one, "name")
    longer = texts.where(F.size("cells") > 1)
    cells = longer.select("row", F.size("cells").cast("long").alias("blocks"), F.posexplode("cells").alias("pos", "c")).select("row", "blocks", "pos", *[F.col("c")[k].alias(k) for k in key])
    level = materialised(join_spread(cells, names, key, "n").select("row", "blocks", "pos", "name"))
    tops = None
    while not level.isEmpty():
        pairs = level.groupBy("row", "blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = materialised(pairs)
        distinct = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).select(F.xxhash64("a", "b").alias("h"), "a", "b", "n")
        ranked = materialised(_ranked(distinct, ["h", "a", "b"]).drop("h"))
        level = materialised(join_spread(pairs, ranked, ["a", "b"], "n").select("row", "blocks", "pos", "name"))
        # A text of n blocks has ceil(n / 2^k) names at level k, so the last place tells whether it is done.
        ahead = level.where(F.col("pos") == 1).select("row")
        ended = level.join(ahead, "row", "left_anti").select("row", "blocks", "name")
        tops = ended if tops is None else tops.unionByName(ended)
        level = level.join(ahead, "row", "left_semi")
    if tops is None:
        return done
    return done.unionByName(tops.join(longer.select("row", "doc_id", "text_sha256"), "row").select("row", "doc_id", "text_sha256", "blocks", "name"))


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    named = materialised(name_texts(df, id_col, text_col, hashed=hashed))
    # Null ids come last, and rows with one id in the order of their row numbers.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = materialised(named.groupBy("blocks", "name").agg(first, F.count("*").alias("group_size")))
    found = join_spread(named, groups, ["blocks", "name"], "group_size")
    return found.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text an earlier id has; of rows with one id and one text one stays."""
    found = materialised(duplicates(df, id_col, text_col))
    own = df[id_col].cast("long")
    # Ids that stand for several rows, or none, do not say which row goes; these rows, if any, are told apart by their texts.
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept"))
    doubtful = ids.where((F.col("n") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("__id"))
    gone = ids.where((F.col("n") == 1) & ~F.col("kept")).select(F.col("doc_id").alias("__id"))
    doubtful = materialised(doubtful)
    if doubtful.isEmpty():
        return without_ids(df, gone, id_col)
    away = gone.unionByName(doubtful)
    plain = df.join(away, own.eqNullSafe(away["__id"]), "left_anti")
    stays = found.where("kept").join(doubtful, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("doc_id", "text_sha256")
    told = df.select(F.struct(*[df[c] for c in df.columns]).alias("whole"), own.alias("own"), F.sha2(normalised(df[text_col]), 256).alias("sha"))
    told = told.join(doubtful, F.col("own").eqNullSafe(F.col("__id")), "left_semi")
    told = told.join(stays, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    return plain.unionByName(told.groupBy("own", "sha").agg(F.first("whole").alias("whole")).select("whole.*"))
