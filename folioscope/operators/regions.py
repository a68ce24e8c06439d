"""Figures, tables and displayed equations of laid out pages, as joins on pages and folds over a page's few captions.

1. Every caption gets the box that it would take if it stood alone: what is drawn in the room above it or below it comes from a spatial
   join on cells of a grid, the ruled table nearest to it from a join within an interval of distances.
2. A page's captions claim their boxes in reading order; one that stands in a box claimed before is no caption. A figure without
   room above its caption claims a neighbouring page with little text that nobody has claimed.
3. What is left of equations is grouped by gaps. A group grows along its column to all short lines that it reaches in steps of little
   more than a line; since these are intervals on a line, one pass downwards and one upwards reach all of them.

The folds are over the captions, lines or equations of one page, and over a document's captions without room; a page bounds all but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import written

#: Side of a grid cell in points, and cells along an edge; what lies beyond the last cell is in it.
CELL, CELLS = 72.0, 32
#: Fixed values. A page with fewer words may be a figure as a whole. The least heights of a figure and of a table without rules. How far
#: from its caption a ruled table may stand, as a share of the page's height. A display's lines are apart by less than ``LINES_APART`` times
#: the body size, and it grows over gaps of ``GROWS`` times that.
PAGE_WORDS, FIGURE_HEIGHT, TABLE_HEIGHT, TABLE_REACH, LINES_APART, GROWS, LONG_LINE = 60, 20, 12, 0.4, 1.6, 1.2, 140

PAGE = ["doc_id", "page"]
BOX = ("x0", "top", "x1", "bottom")
GRAPHICS = "doc_id BIGINT, page INT, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE"
TABLES = GRAPHICS + ", rows ARRAY<ARRAY<STRING>>"


def _bound(value: Column, name: Callable[[Column], Column]) -> Column:
    """``name`` of ``value``, which is then evaluated once."""
    return F.transform(F.array(value), name)[0]


def _cell(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(c / CELL))).cast("int")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose boxes have a point in common, each pair once; the columns of ``right`` are prefixed ``r_``.

    Boxes are dealt to the cells of a grid that they touch and meet by key and cell. A pair that meets in several cells is taken from
    the one that holds the upper left corner of what both share."""

    def dealt(rows: DataFrame, prefix: str) -> DataFrame:
        x0, top, x1, bottom = (F.col(f"{prefix}{c}") for c in BOX)
        across, down = F.sequence(_cell(x0), _cell(x1)), F.sequence(_cell(top), _cell(bottom))
        return rows.where((x0 <= x1) & (top <= bottom)).withColumn("__x", F.explode(across)).withColumn("__y", F.explode(down))

    other = right.select([F.col(c) if c in keys else F.col(c).alias(f"r_{c}") for c in right.columns])
    met = dealt(left, "").join(dealt(other, "r_"), [*keys, "__x", "__y"])
    x, y = F.greatest("x0", "r_x0"), F.greatest("top", "r_top")
    meets = (x <= F.least("x1", "r_x1")) & (y <= F.least("bottom", "r_bottom")) & (F.col("__x") == _cell(x)) & (F.col("__y") == _cell(y))
    return met.where(meets).drop("__x", "__y")


def on_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines of some ``pages`` (``doc_id, page``). A document is told its pages, so that lines in buckets by document are not shuffled."""
    own = pages.groupBy("doc_id").agg(F.collect_set("page").alias("__pages"))
    return lines.join(own.hint("shuffle_hash"), "doc_id").where(F.array_contains("__pages", F.col("page"))).drop("__pages")


def page_lines(lines: DataFrame, with_any: str) -> DataFrame:
    """``ls``, the lines of each page in reading order, of pages with any line of the kind."""
    lines = on_pages(lines, lines.where(with_any))
    names = ["place", *BOX, "size", "col", "span0", "span1", "body_like", "section_name", "equation", "prose"]
    more = [F.col("text").rlike(T.CAPTION).alias("captioned"), F.length("text").alias("length"), F.regexp_extract("text", r"\((\d+[a-z]?)\)\s*$", 1).alias("number")]
    return lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*names, *more))).alias("ls"), F.first("body").alias("body"), F.first("w").alias("w"), F.first("h").alias("h"))


def nearest_tables(captions: DataFrame, tables: DataFrame) -> DataFrame:
    """``doc_id, page, place`` of captions (with ``a, b``, the ends of their column) and ``near``, the nearest table within reach, with its ``d``."""
    t = tables.select(*PAGE, *[F.col(c).alias(f"t_{c}") for c in BOX], "rows")
    d = F.when(F.col("t_top") >= F.col("bottom") - 2, F.col("t_top") - F.col("bottom")).otherwise(F.col("top") - F.col("t_bottom"))
    met = captions.join(t, PAGE).withColumn("d", d).where((F.col("t_x1") > F.col("a")) & (F.col("t_x0") < F.col("b")) & (F.col("d") >= -2) & (F.col("d") < TABLE_REACH * F.col("h")))
    order = F.struct("d", "t_top", "t_x0", "t_x1", "t_bottom")
    return met.groupBy(*PAGE, "place").agg(F.min_by(F.struct("d", *[F.col(f"t_{c}").alias(c) for c in BOX], "rows"), order).alias("near"))


def caption_boxes(lines: DataFrame, graphics: DataFrame, tables: DataFrame, tasks: int | None = None) -> DataFrame:
    """The captions of each page with ``kind`` and ``box``, what each would take if it stood alone; null without room."""
    caps = lines.where("caption").select(*PAGE, "place", "is_table", "col", F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), "top", "bottom", F.col("span0").alias("a"), F.col("span1").alias("b"))
    caps = written(caps.join(page_lines(lines, "caption"), PAGE), tasks)
    a, b, body, h = (F.col(c) for c in ("a", "b", "body", "h"))
    over = lambda x: (x["x1"] > a) & (x["x0"] < b)
    # Above a figure's caption the last line of running text, or across the page, or large, ends the room.
    text_like = lambda x: x["body_like"] | ((x["col"] == "full") & (x["x1"] - x["x0"] > 0.3 * F.col("w"))) | (x["size"] >= 1.1 * body)
    stops = F.filter("ls", lambda x: (x["bottom"] <= F.col("top") - 1) & over(x) & ~x["captioned"] & text_like(x))
    ceiling = F.coalesce(F.array_max(F.transform(stops, lambda x: x["bottom"])), 0.04 * h)
    # Below a table's caption, which may go on over lines, the next line of running text does.
    state = F.struct(F.col("bottom").alias("end"), F.lit(True).alias("on"))

    def follow(acc: Column, x: Column) -> Column:
        on = acc["on"] & (x["col"] == F.col("col")) & (x["top"] - acc["end"] < 0.6 * body) & x["body_like"] & (x["top"] > F.col("top"))
        return F.struct(F.when(on, x["bottom"]).otherwise(acc["end"]).alias("end"), on.alias("on"))

    end = F.aggregate(F.filter("ls", lambda x: x["place"] > F.col("place")), state, follow)["end"]
    caps = caps.withColumn("end", F.when(F.col("is_table"), end))
    ends = F.filter("ls", lambda x: (x["top"] > F.col("end") + 2) & (x["span0"] <= a + 1) & (x["span1"] >= b - 1) & (x["body_like"] | (x["size"] >= 1.1 * body) | x["section_name"]) & ~x["captioned"])
    floor = F.coalesce(F.array_min(F.transform(ends, lambda x: x["top"])), 0.95 * h)
    caps = caps.withColumns({"y0": F.when(F.col("is_table"), F.col("end")).otherwise(ceiling), "y1": F.when(F.col("is_table"), floor).otherwise(F.col("top"))})
    caps = written(caps.withColumn("lower", F.when(F.col("is_table"), F.col("y1") + 2).otherwise(F.col("top") + 2)), tasks)

    room = caps.select(*PAGE, "place", "is_table", F.col("a").alias("x0"), (F.col("y0") - 2).alias("top"), F.col("b").alias("x1"), F.col("lower").alias("bottom"))
    area = (F.col("r_x1") - F.col("r_x0")) * (F.col("r_bottom") - F.col("r_top"))
    within = (F.col("r_top") >= F.col("top")) & (F.col("r_bottom") <= F.col("bottom")) & (F.col("r_x1") > F.col("x0")) & (F.col("r_x0") < F.col("x1")) & (F.col("is_table") | (area > 4))
    drawn = overlapping(room, graphics.select(*PAGE, *BOX), PAGE).where(within).groupBy(*PAGE, "place").agg(F.struct(F.min("r_x0").alias("x0"), F.min("r_top").alias("top"), F.max("r_x1").alias("x1"), F.max("r_bottom").alias("bottom")).alias("g"))
    caps = caps.join(drawn, [*PAGE, "place"], "left").join(nearest_tables(caps.where("is_table"), tables), [*PAGE, "place"], "left")

    g, y0, y1 = F.col("g"), F.col("y0"), F.col("y1")
    least = lambda xs, c: F.array_min(F.transform(xs, lambda x: x[c]))
    most = lambda xs, c: F.array_max(F.transform(xs, lambda x: x[c]))
    as_box = lambda x0, top, x1, bottom: F.struct(x0.alias("x0"), top.alias("top"), x1.alias("x1"), bottom.alias("bottom"))
    # Labels of a drawing are those next to it.
    near = lambda x: g.isNull() | ((x["bottom"] >= g["top"] - 2 * body) & (x["top"] <= g["bottom"] + 2 * body))
    labels = F.filter("ls", lambda x: (x["top"] >= y0) & (x["bottom"] <= F.col("top")) & over(x) & near(x))

    def figure(xs: Column) -> Column:
        lows = [F.least(least(xs, c), g[c]) for c in ("x0", "top")]
        highs = [F.greatest(most(xs, c), g[c]) for c in ("x1", "bottom")]
        box = as_box(F.greatest(a, lows[0] - 4), F.greatest(y0, lows[1] - 4), F.least(b, highs[0] + 4), F.least(F.col("top") - 1, highs[1] + 4))
        box = F.when(g.isNull() & (F.size(xs) == 0), as_box(a, y0 + 2, b, F.col("top") - 1)).otherwise(box)
        return F.when(box["bottom"] - box["top"] >= FIGURE_HEIGHT, box)

    inner = F.filter("ls", lambda x: (x["top"] > y0 + 1) & (x["bottom"] < y1) & over(x))

    def table(xs: Column) -> Column:
        top, bottom = y0 + 2, most(xs, "bottom") + 4
        box = as_box(F.greatest(a, least(xs, "x0") - 4), F.when(g.isNull(), top).otherwise(F.least(top, F.greatest(y0 + 1, g["top"] - 2))), F.least(b, most(xs, "x1") + 4), F.greatest(bottom, g["bottom"] + 2))
        box = F.when(F.size(xs) == 0, as_box(a, y0 + 2, b, y1 - 2)).otherwise(box)
        return F.when(box["bottom"] - box["top"] >= TABLE_HEIGHT, box)

    ruled = as_box(*[F.col("near")[c] for c in BOX])
    box = F.when(F.col("is_table"), F.when(F.col("near").isNotNull(), ruled).otherwise(_bound(inner, table))).otherwise(_bound(labels, figure))
    kind = F.when(F.col("is_table"), "table").otherwise("figure")
    return caps.select(*PAGE, "place", kind.alias("kind"), box.alias("box"), F.col("near")["rows"].alias("rows"), as_box(F.col("cx0"), F.col("top"), F.col("cx1"), F.col("bottom")).alias("line"))


def _inside(line: Column, box: Column) -> Column:
    return (line["top"] >= box["top"] - 1) & (line["bottom"] <= box["bottom"] + 1) & (line["x0"] >= box["x0"] - 2) & (line["x1"] <= box["x1"] + 2)


def claimed_boxes(boxes: DataFrame) -> DataFrame:
    """Without the captions that stand in a box which one before them on the page has claimed, and without tables that have no box."""
    own = F.struct("place", "kind", "box", "rows", "line")
    pages = boxes.where((F.col("kind") == "figure") | F.col("box").isNotNull()).groupBy(*PAGE).agg(F.array_sort(F.collect_list(own), lambda x, y: x["place"] - y["place"]).alias("caps"))
    claim = lambda acc, c: F.when(F.exists(acc, lambda k: k["box"].isNotNull() & _inside(c["line"], k["box"])), acc).otherwise(F.concat(acc, F.array(c)))
    return pages.withColumn("caps", F.aggregate("caps", F.slice("caps", 1, 0), claim)).select(*PAGE, F.inline("caps"))


def claimed_pages(captions: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page, place, q``: the neighbouring page ``q`` that each figure's caption without room gets. ``pages`` has ``n_words``.

    Captions claim in order, the page before first; a page has one claimant, and the captions of a page that one before it has claimed are
    its own no more."""
    free = pages.where(F.col("n_words") < PAGE_WORDS).groupBy("doc_id").agg(F.collect_set("page").alias("free"))
    asked = captions.where(F.col("box").isNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "place"))).alias("asked")).join(free, "doc_id")
    none = F.expr("cast(array() as array<struct<page:int,place:int,q:int>>)")

    def claim(got: Column, c: Column) -> Column:
        is_free = lambda q: F.array_contains("free", q) & ~F.exists(got, lambda x: x["q"] == q)
        q = F.when(is_free(c["page"] - 1), c["page"] - 1).when(is_free(c["page"] + 1), c["page"] + 1)
        mine = F.struct(c["page"].alias("page"), c["place"].alias("place"), q.cast("int").alias("q"))
        return F.when(F.exists(got, lambda x: x["q"] == c["page"]) | q.isNull(), got).otherwise(F.concat(got, F.array(mine)))

    return asked.select("doc_id", F.inline(F.aggregate("asked", none, claim)))


def equation_groups(lines: DataFrame, taken: DataFrame) -> DataFrame:
    """The displays of each page: equation lines that nothing has ``taken`` and that follow each other closely in a column."""
    cand = lines.where("equation").join(taken, [*PAGE, "place"], "left_anti").select(*PAGE, "place", "col", "top", "bottom", "span0", "span1", "body")
    order = Window.partitionBy(*PAGE).orderBy("place")
    cand = cand.withColumn("stretch", F.count_if(F.coalesce(F.lag("col").over(order) != F.col("col"), F.lit(False))).over(order))
    low = F.max("bottom").over(Window.partitionBy(*PAGE, "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    cand = cand.withColumn("apart", F.coalesce(F.col("top") - low >= LINES_APART * F.col("body"), F.lit(False)))
    cand = cand.withColumn("n", F.count_if("apart").over(Window.partitionBy(*PAGE, "stretch").orderBy("place")))
    first = lambda c: F.min_by(c, "place").alias(c)
    return cand.groupBy(*PAGE, "stretch", "n").agg(F.min("place").alias("place"), first("col"), first("span0"), first("span1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def grown_equations(lines: DataFrame, groups: DataFrame, taken: DataFrame) -> DataFrame:
    """``doc_id, page, place, box, number, consumed`` of each display with the lines it has grown by; those of one page in order, none
    taking what one before it has."""
    page = groups.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("place", "col", "span0", "span1", "top", "bottom"))).alias("groups")).join(page_lines(lines, "equation"), PAGE)
    gone = taken.groupBy(*PAGE).agg(F.collect_list("place").alias("gone"))
    page = page.join(gone, PAGE, "left").withColumn("gone", F.coalesce("gone", F.expr("cast(array() as array<int>)")))
    body = F.col("body")
    joins = lambda x: ~x["body_like"] & (x["length"] <= LONG_LINE) & ~x["prose"] & ~x["section_name"] & (x["size"] < 1.1 * body) & ~x["captioned"]
    page = page.withColumn("open", F.filter("ls", joins)).withColumn("other", F.filter("ls", lambda x: ~x["body_like"]))
    downwards = F.array_sort("open", lambda x, y: F.when(x["top"] < y["top"], -1).when(x["top"] > y["top"], 1).otherwise(x["place"] - y["place"]))
    upwards = F.array_sort("open", lambda x, y: F.when(x["bottom"] > y["bottom"], -1).when(x["bottom"] < y["bottom"], 1).otherwise(x["place"] - y["place"]))
    page = page.withColumns({"down": downwards, "up": upwards})
    out = "array<struct<place:int,box:struct<x0:double,top:double,x1:double,bottom:double>,number:string,consumed:array<int>>>"
    start = F.struct(F.col("gone").alias("gone"), F.expr(f"cast(array() as {out})").alias("out"))

    def grow(acc: Column, g: Column) -> Column:
        def reach(span: Column, x: Column) -> Column:
            near = (x["col"] == g["col"]) & ~F.array_contains(acc["gone"], x["place"]) & (x["top"] <= span["bottom"] + GROWS * body) & (x["bottom"] >= span["top"] - GROWS * body)
            wider = F.struct(F.least(span["top"], x["top"]).alias("top"), F.greatest(span["bottom"], x["bottom"]).alias("bottom"))
            return F.when(near, wider).otherwise(span)

        span = F.struct(g["top"].alias("top"), g["bottom"].alias("bottom"))
        for order in ("down", "up"):
            span = F.aggregate(order, span, reach)

        def done(s: Column) -> Column:
            top, bottom = s["top"] - 2, s["bottom"] + 2
            band = F.filter("other", lambda x: ~F.array_contains(acc["gone"], x["place"]) & (x["top"] >= top - 1) & (x["bottom"] <= bottom + 1) & (x["x1"] > g["span0"]) & (x["x0"] < g["span1"]))

            def put(own: Column) -> Column:
                places = F.transform(own, lambda x: x["place"])
                box = F.struct((F.array_min(F.transform(own, lambda x: x["x0"])) - 3).alias("x0"), top.alias("top"), (F.array_max(F.transform(own, lambda x: x["x1"])) + 3).alias("x1"), bottom.alias("bottom"))
                number = F.get(F.filter(F.transform(own, lambda x: x["number"]), lambda n: n != ""), F.lit(0))
                one = F.struct(F.array_min(places).alias("place"), box.alias("box"), number.alias("number"), places.alias("consumed"))
                return F.when(F.size(own) == 0, acc).otherwise(F.struct(F.concat(acc["gone"], places).alias("gone"), F.concat(acc["out"], F.array(one)).alias("out")))

            return _bound(band, put)

        return _bound(span, done)

    return page.select(*PAGE, F.inline(F.aggregate("groups", start, grow)["out"]))


def regions(lines: DataFrame, graphics: DataFrame | None = None, tables: DataFrame | None = None, pages: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``lines`` as ``described`` returns them. A row a region; ``page:N`` is a whole page for a caption on page N.

    ``pages`` (``doc_id, page, w, h, n_words``) also has the pages without lines, which a figure may fill; without it only pages with lines
    are known. Given ``tasks``, intermediate tables are in so many buckets, as ``lines`` should be."""
    spark = lines.sparkSession
    graphics = graphics if graphics is not None else spark.createDataFrame([], GRAPHICS)
    tables = tables if tables is not None else spark.createDataFrame([], TABLES)
    if pages is None:
        pages = lines.groupBy(*PAGE).agg(F.first("w").alias("w"), F.first("h").alias("h"), F.sum(F.size("words")).alias("n_words"))
    places = lines.select(*PAGE, "place", *BOX)
    captions = written(claimed_boxes(caption_boxes(lines, graphics, tables, tasks)), tasks)
    claims = written(claimed_pages(captions, pages), tasks)
    lost = claims.where(F.col("q") > F.col("page")).select("doc_id", F.col("q").alias("page"))
    held = captions.where(F.col("box").isNotNull()).join(lost, PAGE, "left_anti")
    inside = (F.col("l.top") >= F.col("r.box.top") - 1) & (F.col("l.bottom") <= F.col("r.box.bottom") + 1) & (F.col("l.x0") >= F.col("r.box.x0") - 2) & (F.col("l.x1") <= F.col("r.box.x1") + 2)
    apart = (F.col("r.kind") == "figure") | (F.col("l.place") != F.col("r.place"))
    took = held.alias("r").join(places.alias("l"), PAGE).where(inside & apart).select(*PAGE, F.col("r.place").alias("place"), F.col("l.place").alias("line"))
    consumed = took.groupBy(*PAGE, "place").agg(F.sort_array(F.collect_set("line")).alias("consumed"))
    empty = F.expr("cast(array() as array<int>)")
    boxed = held.join(consumed, [*PAGE, "place"], "left").select(*PAGE, "place", "kind", "box", "rows", F.lit(None).cast("string").alias("number"), F.coalesce("consumed", empty).alias("consumed"))

    whole = claims.select("doc_id", F.col("q").alias("page"), "place", F.concat(F.lit("page:"), F.col("page")).alias("kind"))
    every = on_pages(places, whole).groupBy(*PAGE).agg(F.sort_array(F.collect_set("place")).alias("consumed"))
    sheet = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), F.col("w").alias("x1"), F.col("h").alias("bottom"))
    whole = whole.join(pages.select(*PAGE, "w", "h"), PAGE).join(every, PAGE, "left").select(*PAGE, "place", "kind", sheet.alias("box"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("string").alias("number"), F.coalesce("consumed", empty).alias("consumed"))

    first = written(boxed.unionByName(whole), tasks)
    taken = first.select(*PAGE, F.explode("consumed").alias("place")).distinct()
    display = grown_equations(lines, equation_groups(lines, taken), taken).select(*PAGE, "place", F.lit("equation").alias("kind"), "box", F.lit(None).cast("array<array<string>>").alias("rows"), "number", "consumed")
    found = first.unionByName(display)
    return found.select(*PAGE, "place", "kind", F.col("box.x0").alias("x0"), F.col("box.top").alias("y0"), F.col("box.x1").alias("x1"), F.col("box.bottom").alias("y1"), "rows", "number", "consumed")
