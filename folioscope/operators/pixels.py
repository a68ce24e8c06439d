"""Figures as pixels: dark lines, panel edges, and boxes in fractions of a figure. ``pixels``: ``fig_id, y, x, g``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DARK, CONTENT = 128, 240


def dark_lines(pixels: DataFrame, axis: str, share: float, below: int = DARK) -> DataFrame:
    """Rows (``axis`` = ``y``) or columns (``x``) of which at least ``share`` is dark: ``fig_id, i, n``, with the axis' size."""
    other = "x" if axis == "y" else "y"
    dims = pixels.groupBy("fig_id").agg((F.max(other) + 1).alias("across"), (F.max(axis) + 1).alias("n"))
    sums = pixels.groupBy("fig_id", F.col(axis).alias("i")).agg(F.count_if(F.col("g") < below).alias("dark"))
    return sums.join(dims, "fig_id").where(F.col("dark") >= share * F.col("across")).select("fig_id", "i", "n")


def islands(df: DataFrame, key: list[str], index: str, gap: int = 2) -> DataFrame:
    """Adds ``island``: indices more than ``gap`` apart begin a new one."""
    own = Window.partitionBy(*key).orderBy(index)
    before = F.lag(index).over(own)
    fresh = F.coalesce((F.col(index) - before > gap).cast("int"), F.lit(0))
    return df.withColumn("__f", fresh).withColumn("island", F.sum("__f").over(own)).drop("__f")


def line_positions(lines: DataFrame) -> DataFrame:
    """The middle of each group of dark lines as a fraction of the figure."""
    groups = islands(lines, ["fig_id"], "i").groupBy("fig_id", "island").agg(F.avg("i").alias("mid"), F.first("n").alias("n"))
    return groups.select("fig_id", "island", (F.col("mid") / F.col("n")).alias("at"))


def content_box(pixels: DataFrame, below: int = CONTENT) -> DataFrame:
    """The box of what is not background."""
    on = pixels.where(F.col("g") < below)
    return on.groupBy("fig_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def box_to_pixels(boxes: DataFrame, figures: DataFrame) -> DataFrame:
    """Fractions to whole pixels of the figure's size."""
    out = boxes.join(figures.select("doc_id", F.col("fig_id").alias("block"), F.col("w").alias("__w"), F.col("h").alias("__h")), ["doc_id", "block"])
    to = lambda c, s: F.floor(F.col(c) * F.col(s)).cast("int")
    return out.select("doc_id", "id", "block", to("x", "__w").alias("px"), to("y", "__h").alias("py"), to("w", "__w").alias("pw"), to("h", "__h").alias("ph"))
