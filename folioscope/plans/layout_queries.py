"""HTML to blocks, words to lines, pixels, edits: operators of the manuscript's two ends, over stand-ins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import edits as E
from ..operators import layout as L
from ..operators import pixels as P
from ..operators import regions as R
from ..operators.tables import dealt, tasks_for, written
from . import standins as S
from .registry import query


@query("e29_html_blocks")
def e29(spark, d):
    pages = S.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return B.finished(B.parse_blocks(pages)).select("doc_id", "ord", "block_id", "kind", "html", "caption", "label")


@query("k1_outline")
def k1(spark, d):
    pages = S.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return B.outline(B.finished(B.parse_blocks(pages)))


@query("e24_sanitised_html")
def e24(spark, d):
    return S.table(spark, d, "pages").select("page_id", B.sanitised("html").alias("html"))


def _turns(spark, d):
    """Consecutive turns of a conversation as a text and what it was edited to."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.lag("text").over(own).alias("before"), F.col("text").alias("after")).where(F.col("before").isNotNull())


@query("e8_edit_hunks")
def e8(spark, d):
    pairs = _turns(spark, d)
    key = F.concat(F.lit("b"), F.col("turn").cast("string"))
    edits = pairs.select(F.col("conv_id").alias("doc_id"), key.alias("block"), F.col("after").alias("text"), F.lit(None).cast("string").alias("html"), F.col("before").alias("baseText"))
    texts = pairs.select(F.col("conv_id").alias("doc_id"), key.alias("block_id"), F.col("before").alias("text"))
    blocks = texts.select("doc_id", "block_id", F.lit("p").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("string").alias("caption"))
    return E.find_hunks(edits, blocks, texts).select("doc_id", "block", "hunk_no", "old", "new")


@query("e32_tracked_changes")
def e32(spark, d):
    pairs = _turns(spark, d).withColumn("pair", F.col("conv_id") * 1000 + F.col("turn"))
    return E.tracked_changes(pairs, "pair", "before", "after")


@query("e33_hunk_context", """WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)
       SELECT conv_id, turn, trim(array_to_string(w[greatest(1, len(w) - 7):], '') || '[x]' || array_to_string(w[1:8], '')) AS context FROM t""")
def e33(spark, d):
    w = F.split("text", " ")
    return S.table(spark, d, "conversations").select("conv_id", "turn", E.shown_context(w, F.lit("x"), w).alias("context"))


@query("w26_overlapping_hunks", """SELECT l_orderkey, s, e, coalesce(lag(e) OVER (PARTITION BY l_orderkey ORDER BY s, e) > s, FALSE) AS clash
       FROM (SELECT l_orderkey, l_partkey AS s, l_partkey + CAST(l_quantity * 10 AS BIGINT) AS e FROM lineitem)""")
def w26(spark, d):
    rows = S.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("s"), (F.col("l_partkey") + (F.col("l_quantity") * 10).cast("long")).alias("e"))
    return rows.withColumn("clash", E.begins_too_soon(F.col("s"), F.col("e"), ["l_orderkey"], ["s", "e"]))


@query("j11_changed_cells", """WITH a AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) AS c FROM benchmark),
       n AS (SELECT item_id, len(c) AS size, unnest(c) AS was, generate_subscripts(c, 1) AS n FROM a)
       SELECT item_id, 'row 1, column ' || n AS cell, was AS old, was || 'x' AS new, NULL AS note FROM n WHERE n % 3 = 1 AND (item_id % 5 <> 0)
       UNION ALL SELECT item_id, NULL, '', '', 'the shape of the table has changed' FROM a WHERE item_id % 5 = 0""")
def j11(spark, d):
    """Texts as tables of one row; every third cell is edited, and a fifth of the tables lose their last cell."""
    cells = F.transform(F.split("text", " "), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    rows = S.table(spark, d, "benchmark").select("item_id", cells.alias("cells"))
    edited = F.transform("cells", lambda c, k: F.concat(F.lit("<td>"), c, F.when(k % 3 == 0, "x").otherwise(""), F.lit("</td>")))
    edited = F.when(F.col("item_id") % 5 == 0, F.slice(edited, 1, F.size("cells") - 1)).otherwise(edited)
    tables = rows.select(F.col("item_id").alias("doc_id"), F.lit("t").alias("block"), F.array("cells").alias("rows"), F.lit("").alias("caption"), F.concat(F.lit("<table><tr>"), F.array_join(edited, ""), F.lit("</tr></table>")).alias("html"))
    return E.table_hunks(tables).select(F.col("doc_id").alias("item_id"), "cell", "old", "new", F.when(F.col("note").isNotNull(), "the shape of the table has changed").alias("note"))


def _words(spark, d):
    """Order lines as words of a page: an order is the page."""
    return S.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("l_linenumber").alias("word_no"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("x1"), (F.col("l_suppkey") % 40 + 16).cast("double").alias("size")
    )


@query("a4_body_sizes", """WITH s AS (SELECT l_orderkey AS doc_id, round_even((l_suppkey % 40 + 16) / 3.0 * 2, 0) / 2 AS size, sum(length('w' || CAST(l_partkey AS VARCHAR))) AS n, min(l_linenumber) AS first_no FROM lineitem GROUP BY 1, 2),
       o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_no, size DESC) AS k FROM s)
       SELECT doc_id, size AS body FROM o WHERE k = 1""")
def a4(spark, d):
    return L.body_sizes(_words(spark, d).withColumn("size", F.col("size") / 3.0))


def _lines(spark, d):
    """Orders as pages of one baseline, read by the library."""
    words = S.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("l_linenumber").alias("word_no"), F.concat(F.lit("w"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("text"),
        (F.col("l_quantity") * 8).alias("x0"), (F.col("l_quantity") * 8 + 2 + F.col("l_discount") * 100).alias("x1"), (90 - F.col("l_tax") * 50).alias("top"), F.lit(100.0).alias("bottom"), (F.col("l_suppkey") % 4 + 9).cast("double").alias("size"), F.lit("Times").alias("fontname"), F.lit(False).alias("cid"),
    )
    gutter = words.where("false").select("doc_id", F.lit(0.0).alias("left_edge"), F.lit(0.0).alias("right_edge"))
    return L.lines_of(words, gutter)


#: Gaps wider than 2.2 of the largest size, and than 10 points, cut a baseline.
LINES = """w AS (SELECT l_orderkey AS doc_id, l_linenumber AS word_no, 'w' || l_partkey || '-' || l_suppkey AS text, l_quantity * 8 AS x0, l_quantity * 8 + 2 + l_discount * 100 AS x1, 90 - l_tax * 50 AS top, CAST(l_suppkey % 4 + 9 AS DOUBLE) AS size FROM lineitem),
    g AS (SELECT *, x0 - lag(x1) OVER o AS gap, max(size) OVER (PARTITION BY doc_id) AS ref, row_number() OVER o AS n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY x0, word_no, x1, top, size, text)),
    c AS (SELECT *, sum(CASE WHEN gap > greatest(2.2 * ref, 10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM g),
    r AS (SELECT *, max(size) OVER (PARTITION BY doc_id, run) AS large FROM c)"""


@query("a6_median_sizes", f"WITH {LINES} SELECT doc_id, CAST(run AS INTEGER) AS line_no, median(size) FILTER (WHERE size >= 0.8 * large) AS size FROM r GROUP BY doc_id, run")
def a6(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", "size")


@query("a7_bounding_boxes", f"WITH {LINES} SELECT doc_id, CAST(run AS INTEGER) AS line_no, min(x0) AS x0, max(x1) AS x1, min(top) FILTER (WHERE size >= 0.8 * large) AS top, 100.0 AS bottom FROM r GROUP BY doc_id, run")
def a7(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", "x0", "x1", "top", "bottom")


@query("w11_line_gaps", f"WITH {LINES} SELECT doc_id, CAST(run AS INTEGER) AS line_no, string_agg(text, ' ' ORDER BY n) AS text FROM r GROUP BY doc_id, run")
def w11(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", "text")


@query("w12_bands", """WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_discount) AS line_no, l_quantity AS top,
            CASE WHEN l_tax > 0.06 THEN 'full' WHEN l_discount > 0.04 THEN 'right' ELSE 'left' END AS side FROM lineitem),
       b AS (SELECT *, (SELECT count(*) FROM l f WHERE f.doc_id = l.doc_id AND f.side = 'full' AND f.top <= l.top + 0.1) AS band, avg(CASE WHEN side = 'right' THEN 1.0 ELSE 0 END) OVER (PARTITION BY doc_id) > 0.15 AS two_col FROM l)
       SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(band AS INTEGER) AS band, CASE WHEN two_col THEN side ELSE 'full' END AS col, two_col,
              CAST(row_number() OVER (PARTITION BY doc_id ORDER BY band, CASE WHEN side = 'right' THEN 1 ELSE 0 END, top, CASE WHEN side = 'right' THEN 350.0 ELSE 50.0 END, line_no) - 1 AS INTEGER) AS place FROM b""")
def w12(spark, d):
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    side = F.when(F.col("l_tax") > 0.06, "full").when(F.col("l_discount") > 0.04, "right").otherwise("left")
    lines = dealt(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), *order)).withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    lines = lines.select("doc_id", F.lit(0).alias("page"), "line_no", side.alias("side"), F.col("l_quantity").alias("top"), F.lit(612.0).alias("w"))
    lines = lines.withColumns({"x0": F.when(F.col("side") == "right", 350.0).otherwise(50.0), "x1": F.when(F.col("side") == "left", 280.0).otherwise(560.0)})
    return L.reading_order(lines).select("doc_id", "line_no", "band", "col", "two_col", "place")


@query("f14_running_heads", """WITH l AS (SELECT conv_id, turn, text, regexp_replace(lower(trim(text, E' \\n\\t\\r')), '[0-9]+', '#', 'g') AS k FROM conversations),
       n AS (SELECT conv_id, k, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT conv_id, count(*) AS pages FROM conversations GROUP BY 1)
       SELECT l.conv_id, l.turn, l.text FROM l JOIN n USING (conv_id, k) JOIN p USING (conv_id)
       WHERE NOT regexp_full_match(lower(trim(text, E' \\n\\t\\r')), '(page\\s*)?[0-9]{1,4}(\\s*(of|/)\\s*[0-9]{1,4})?') AND NOT (n >= greatest(2, 0.3 * pages)) AND NOT regexp_full_match(k, '(page\\s*)?#(\\s*(of|/)\\s*#)?')""")
def f14(spark, d):
    """Turns as lines at the top of the pages of a conversation."""
    turns = S.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    lines = turns.withColumns({"top": F.lit(20.0), "bottom": F.lit(30.0)})
    pages = turns.select("doc_id", "page", F.lit(612.0).alias("w"), F.lit(792.0).alias("h"))
    return L.without_running_heads(lines, pages).select(F.col("doc_id").alias("conv_id"), F.col("page").alias("turn"), "text")


def _pixels(spark, d):
    """Events as pixels: a user's figure."""
    return S.table(spark, d, "events").select(F.col("user_id").cast("string").alias("fig_id"), (F.col("event_id") % 37).cast("int").alias("y"), (F.col("event_id") % 41).cast("int").alias("x"), F.least(F.col("value").cast("int") % 256, F.lit(255)).alias("g"))


@query("a14_dark_lines", """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS fig_id, event_id % 37 AS y, event_id % 41 AS x, least(CAST(trunc(value) AS BIGINT) % 256, 255) AS g FROM events),
       t AS (SELECT fig_id, max(x) + 1 AS across, max(y) + 1 AS n FROM p GROUP BY 1), s AS (SELECT fig_id, y, count(CASE WHEN g < 128 THEN 1 END) AS dark FROM p GROUP BY 1, 2)
       SELECT s.fig_id, s.y AS i, t.n FROM s JOIN t USING (fig_id) WHERE dark >= 0.03 * across""")
def a14(spark, d):
    return P.dark_lines(_pixels(spark, d), "y", 0.03).select("fig_id", F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"))


@query("a15_content_boxes", """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS fig_id, event_id % 37 AS y, event_id % 41 AS x, least(CAST(trunc(value) AS BIGINT) % 256, 255) AS g FROM events)
       SELECT fig_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p WHERE g < 30 GROUP BY 1""")
def a15(spark, d):
    out = P.content_box(_pixels(spark, d), 30)
    return out.select("fig_id", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("w9_islands", """WITH o AS (SELECT DISTINCT o_custkey AS k, o_orderkey AS i FROM orders), f AS (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) > 50 THEN 1 ELSE 0 END AS fresh FROM o),
       g AS (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS island FROM f)
       SELECT k, CAST(island AS BIGINT) AS island, min(i) AS lo, max(i) AS hi, count(*) AS n FROM g GROUP BY ALL""")
def w9(spark, d):
    rows = S.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i")).distinct()
    return P.islands(rows, ["k"], "i", 50).groupBy("k", "island").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("n"))


@query("k9_boxes_in_pixels", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_discount * (100 + l_orderkey % 50)) AS BIGINT) AS px, CAST(floor(l_tax * 80) AS BIGINT) AS py FROM lineitem""")
def k9(spark, d):
    rows = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity", "l_extendedprice").alias("id"), F.col("l_orderkey").alias("doc_id"), F.lit("f").alias("block"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h"))
    figures = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("f").alias("fig_id"), (100 + F.col("o_orderkey") % 50).alias("w"), F.lit(80).alias("h"))
    return P.box_to_pixels(rows, figures).select("id.l_orderkey", "id.l_linenumber", "id.l_partkey", "id.l_suppkey", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"))


@query("j13_nearest_table", """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS place, o_totalprice / 600 AS top, o_orderpriority LIKE '1%' AS asks, CASE WHEN o_orderkey % 2 = 0 THEN 306.0 ELSE 612.0 END AS b, CAST(o_orderkey % 7 * 80 AS DOUBLE) AS x0 FROM orders),
       m AS (SELECT c.doc_id, c.place, CASE WHEN t.top >= c.top + 8 THEN t.top - (c.top + 10) ELSE c.top - (t.top + 40) END AS d, t.x0, t.top, c.b FROM o c JOIN o t USING (doc_id) WHERE c.asks AND NOT t.asks)
       SELECT doc_id, place, d, x0, top FROM m WHERE x0 + 60 > 0 AND x0 < b AND d >= -2 AND d < 0.4 * 792 QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY d, top, x0) = 1""")
def j13(spark, d):
    """Orders of a customer as captions and tables of a page."""
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("page"), F.col("o_orderkey").alias("place"), (F.col("o_totalprice") / 600).alias("top"), F.col("o_orderpriority").startswith("1").alias("asks"), (F.col("o_orderkey") % 7 * 80).cast("double").alias("x0"))
    caps = o.where("asks").select("doc_id", "page", "place", "top", (F.col("top") + 10).alias("bottom"), F.lit(0.0).alias("a"), F.when(F.col("place") % 2 == 0, 306.0).otherwise(612.0).alias("b"), F.lit(792.0).alias("h"))
    tables = o.where("not asks").select("doc_id", "page", "x0", "top", (F.col("x0") + 60).alias("x1"), (F.col("top") + 40).alias("bottom"), F.lit(None).cast("array<array<string>>").alias("rows"))
    return R.nearest_tables(caps, tables).select("doc_id", "place", "near.d", "near.x0", "near.top")


@query("j13_nearest_event", """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderkey % 10 = 0), e AS (SELECT o_custkey, o_orderkey AS k, o_orderdate AS t FROM orders WHERE o_orderkey % 10 <> 0)
       SELECT o.o_orderkey, arg_min(e.k, abs(epoch(o.o_orderdate) - epoch(e.t)) * 10000000 + e.k) AS nearest FROM o JOIN e USING (o_custkey) GROUP BY 1""")
def j13(spark, d):
    o = S.table(spark, d, "orders").withColumn("s", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    a = o.where("o_orderkey % 10 = 0").select("o_orderkey", "o_custkey", "s")
    b = o.where("o_orderkey % 10 <> 0").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("s").alias("t"))
    return a.join(b, "o_custkey").groupBy("o_orderkey").agg(F.min_by("k", F.struct(F.abs(F.col("s") - F.col("t")), F.col("k"))).alias("nearest"))


@query("j12_boxes_that_overlap", """WITH b AS (SELECT l_orderkey AS doc_id, concat_ws('/', l_linenumber, l_partkey, l_suppkey, l_quantity) AS id, l_quantity * 10 AS x0, l_quantity * 10 + l_discount * 800 AS x1, l_suppkey % 700 AS top, l_suppkey % 700 + l_tax * 1000 AS bottom FROM lineitem)
       SELECT x.doc_id, x.id, y.id AS other FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.id < y.id AND greatest(x.x0, y.x0) <= least(x.x1, y.x1) AND greatest(x.top, y.top) <= least(x.bottom, y.bottom)""")
def j12(spark, d):
    boxes = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("id"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + F.col("l_discount") * 800).alias("x1"), (F.col("l_suppkey") % 700).cast("double").alias("top"), (F.col("l_suppkey") % 700 + F.col("l_tax") * 1000).alias("bottom"))
    return R.overlapping(boxes, boxes, ["doc_id"]).where(F.col("id") < F.col("r_id")).select("doc_id", "id", F.col("r_id").alias("other"))


@query("s7_text_layer", """SELECT doc_id, CAST(sum(length(w)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1 HAVING sum(length(w)) < 500""")
def s7(spark, d):
    words = S.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("text"))
    return L.without_text_layer(words)


@query("l1_words_to_paragraphs")
def l1(spark, d):
    """Documents set in lines of twelve words on a page, and read back from their words' places."""
    texts = S.table(spark, d, "documents").where(F.length(F.trim("text")) > 0)
    cut = F.split(F.trim("text"), r"\s+")
    last = ((F.size(cut) - 1) / 600).cast("int")
    pages = written(texts.select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("page"), F.lit(612.0).alias("w"), F.lit(792.0).alias("h")))
    tasks = tasks_for(pages, L.PAGES_A_TASK)
    words = texts.select("doc_id", "text").repartition(tasks, "doc_id").select("doc_id", F.posexplode(cut).alias("n", "text"))
    line = F.floor(F.col("n") / 12)
    at = (F.col("n") % 12) * 45.0 + 40
    placed = words.select("doc_id", F.floor(line / 50).cast("int").alias("page"), F.col("n").alias("word_no"), "text", at.alias("x0"), (at + 40).alias("x1"), ((line % 50) * 14.0 + 60).alias("top"), ((line % 50) * 14.0 + 70).alias("bottom"), F.lit(10.0).alias("size"), F.lit("Times").alias("fontname"), F.lit(False).alias("cid"))
    return L.blocks_of(placed, pages, tasks=tasks).select("doc_id", "para_no", "kind", "html")
