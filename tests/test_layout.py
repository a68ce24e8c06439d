"""Regions and paragraphs of laid out pages against versions that go through a page in order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import layout as L
from folioscope.operators import regions as R

BOXES = "doc_id bigint, page int, id int, x0 double, top double, x1 double, bottom double"


def test_boxes_that_overlap_meet_once(spark):
    rnd = random.Random(1)
    rows = []
    for n in range(400):
        x, y = rnd.choice((rnd.uniform(-50, 700), 72.0, 144.0)), rnd.choice((rnd.uniform(-9, 900), 72.0))
        rows.append((n % 3, n % 2, n, x, y, x + rnd.choice((0, 5, 72, 300, 9e9, -1)), y + rnd.choice((0, 5, 72, 300, 5000))))
    a = spark.createDataFrame(rows, BOXES)
    got = sorted((r["id"], r["r_id"]) for r in R.overlapping(a, a, ["doc_id", "page"]).collect())
    fine = [r for r in rows if r[3] <= r[5]]
    want = [(p[2], q[2]) for p in fine for q in fine if p[:2] == q[:2] and max(p[3], q[3]) <= min(p[5], q[5]) and max(p[4], q[4]) <= min(p[6], q[6])]
    assert got == sorted(want)


def test_pages_are_claimed_in_order(spark):
    rnd = random.Random(2)
    captions, pages, want = [], [], set()
    for doc in range(200):
        n = rnd.randrange(1, 9)
        free = {p for p in range(n) if rnd.random() < 0.6}
        pages += [(doc, p, 10 if p in free else 100, 612.0, 792.0) for p in range(n)]
        asked = sorted({(rnd.randrange(n), rnd.randrange(3)) for _ in range(rnd.randrange(7))})
        captions += [(doc, p, k, None) for p, k in asked]
        owner = {}
        for p, k in asked:
            if p in owner:  # claimed by the page before: it is a figure now and has no captions
                continue
            for q in (p - 1, p + 1):
                if q in free and q not in owner:
                    owner[q] = (p, k)
                    break
        want |= {(doc, p, k, q) for q, (p, k) in owner.items()}
    caps = spark.createDataFrame(captions, "doc_id bigint, page int, place int, box struct<x0:double>")
    got = R.claimed_pages(caps, spark.createDataFrame(pages, "doc_id bigint, page int, n_words int, w double, h double"))
    assert {tuple(r) for r in got.select("doc_id", "page", "place", "q").collect()} == want
    assert R.claimed_pages(caps.where("false"), spark.createDataFrame(pages, "doc_id bigint, page int, n_words int, w double, h double")).count() == 0


LINES = (
    "doc_id bigint, page int, place int, x0 double, x1 double, top double, bottom double, size double, text string, words array<string>, w double, h double, col string, span0 double, span1 double, "
    "body double, body_like boolean, caption boolean, is_table boolean, section_name boolean, equation boolean, prose boolean"
)


def a_line(page, place, top, *, doc=1, x0=60.0, x1=200.0, height=10.0, text="x", col="full", like=False, caption=False, table=False, equation=False, prose=False, words=5):
    span = {"full": (0.0, 612.0), "left": (0.0, 306.0), "right": (306.0, 612.0)}[col]
    return (doc, page, place, x0, x1, float(top), top + height, 10.0, text, ["w"] * words, 612.0, 792.0, col, *span, 10.0, like, caption, table, False, equation, prose)


def found(spark, lines, **more):
    return {(r["page"], r["place"], r["kind"]): r for r in R.regions(spark.createDataFrame(lines, LINES), **more).collect()}


def test_figures_and_tables_of_a_page(spark):
    lines = [
        a_line(0, 0, 40, like=True, x1=560.0, text="running text"), a_line(0, 1, 90, text="axis label"), a_line(0, 2, 150, text="far label", x0=500.0, x1=590.0),
        a_line(0, 3, 300, text="Figure 1. A drawing", caption=True), a_line(0, 4, 320, text="a word"),
        a_line(0, 5, 400, text="Table 1. Ruled", caption=True, table=True), a_line(0, 6, 500, text="cell", x0=80.0), a_line(1, 7, 700, text="Table 2. Without rules", caption=True, table=True),
        a_line(1, 8, 716, text="a cell", x0=80.0, x1=300.0), a_line(1, 9, 728, text="more", x0=90.0, x1=320.0), a_line(1, 10, 745, like=True, x1=560.0),
    ]
    graphics = spark.createDataFrame([(1, 0, 100.0, 80.0, 300.0, 250.0), (1, 0, 20.0, 100.0, 20.5, 101.0), (1, 0, 0.0, 600.0, 600.0, 640.0)], R.GRAPHICS)
    tables = spark.createDataFrame([(1, 0, 70.0, 420.0, 300.0, 600.0, [["a", "b"]]), (1, 0, 70.0, 10.0, 300.0, 30.0, [["far"]])], R.TABLES)
    got = found(spark, lines, graphics=graphics, tables=tables)
    figure = got[0, 3, "figure"]
    # the drawing and the labels next to it, four points around, below the running text
    assert tuple(figure[c] for c in ("x0", "y0", "x1", "y1")) == (56.0, 76.0, 594.0, 254.0) and figure["consumed"] == [1, 2]
    assert got[0, 5, "table"]["rows"] == [["a", "b"]] and got[0, 5, "table"]["consumed"] == [6]
    second = got[1, 7, "table"]
    assert tuple(second[c] for c in ("x0", "y0", "x1", "y1")) == (76.0, 712.0, 324.0, 742.0) and second["rows"] is None and second["consumed"] == [8, 9]
    assert set(got) == {(0, 3, "figure"), (0, 5, "table"), (1, 7, "table")}


def test_a_caption_in_a_claimed_box_is_none(spark):
    lines = [a_line(0, 0, 100, text="Table 1. Ruled", caption=True, table=True), a_line(0, 1, 200, text="Figure 9. Inside", caption=True), a_line(0, 2, 400, like=True)]
    tables = spark.createDataFrame([(1, 0, 50.0, 115.0, 300.0, 300.0, [["x"]])], R.TABLES)
    got = found(spark, lines, tables=tables)
    assert set(got) == {(0, 0, "table")} and got[0, 0, "table"]["consumed"] == [1]


def test_a_page_without_lines_is_a_figure(spark):
    lines = [a_line(1, 0, 45, text="Figure 1. On the page before", caption=True)] + [a_line(1, k, 60 + 12 * k, like=True) for k in range(1, 12)]
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0, 0), (1, 1, 612.0, 792.0, 300)], "doc_id bigint, page int, w double, h double, n_words int")
    got = found(spark, lines, pages=pages)
    whole = got[0, 0, "page:1"]
    assert (whole["x1"], whole["y1"], whole["consumed"]) == (600.0, 800.0, [])
    assert not found(spark, lines)  # without the pages nothing says that there is one


def test_equations_grow_along_chains(spark):
    """Against growing a line at a time until nothing more joins."""
    rnd = random.Random(7)
    lines, want = [], {}
    for doc in range(25):
        page, top = [], 40.0
        for place in range(rnd.randrange(3, 40)):
            top += rnd.choice((4, 11, 12, 20, 22, 23, 26, 30))
            col = "left" if place < 20 else "right"
            top = 40.0 if place == 20 else top
            eq = rnd.random() < 0.25
            like, prose = not eq and rnd.random() < 0.15, not eq and rnd.random() < 0.15
            page.append(a_line(0, place, top, doc=doc, height=float(rnd.choice((6, 10, 30))), x0=320.0 if col == "right" else 20.0, x1=500.0 if col == "right" else 200.0, text=rnd.choice(("a = b", "(12)", f"c ({place}a)", "z" * 141)), col=col, like=like, equation=eq, prose=prose))
        lines += page
        top_of, bottom_of, col_of = (lambda k, c=c: page[k][c] for c in (5, 6, 12))
        groups, gone = [], set()
        for k, x in enumerate(page):
            if x[20]:
                if groups and col_of(groups[-1][-1]) == x[12] and x[5] - max(map(bottom_of, groups[-1])) < 16:
                    groups[-1].append(k)
                else:
                    groups.append([k])
        for g in groups:
            own = set(g)
            while True:
                low, high = min(map(top_of, own)), max(map(bottom_of, own))
                new = [k for k, x in enumerate(page) if k not in own and k not in gone and x[12] == col_of(g[0]) and not x[16] and len(x[8]) <= 140 and not x[21] and x[5] <= high + 12 and x[6] >= low - 12]
                if not new:
                    break
                own |= set(new)
            band = [k for k, x in enumerate(page) if k not in gone and x[5] >= low - 3 and x[6] <= high + 3 and x[4] > page[g[0]][13] and x[3] < page[g[0]][14] and not x[16]]
            if band:
                gone |= set(band)
                number = next((m[1] for k in band if (m := re.search(r"\((\d+[a-z]?)\)\s*$", page[k][8]))), None)
                want[doc, min(band)] = (number, band, low - 2, high + 2)
    got = {(r["doc_id"], r["place"]): (r["number"], r["consumed"], r["y0"], r["y1"]) for r in R.regions(spark.createDataFrame(lines, LINES)).collect()}
    assert got == want and len(want) > 40


def sequential(marks):
    """Which lines begin something, one after the other."""
    out, caption, entries = [], False, False
    for m in marks:
        on = lambda bit, m=m: bool(m & bit)
        if on(L.FRESH) or on(L.CAPTION):
            new = True
        elif on(L.LISTED) and entries:
            new = on(L.NUMBERED)
        else:
            new = on(L.ALWAYS) or (caption and on(L.CAPTIONED)) or (not caption and (on(L.PROSE) or (on(L.SECOND) and not out[-1])))
        if new:
            caption = on(L.CAPTION)
            entries = entries or (on(L.LISTED) and not on(L.CAPTION) and on(L.LABELLED))
        out.append(new)
    return out


@pytest.mark.parametrize("entries", [False, True])
def test_first_lines_are_those_of_a_sequential_reading(spark, entries):
    rnd = random.Random(3)
    stretches = [[L.FRESH | rnd.choice((0, L.CAPTION, L.LISTED | L.LABELLED))] + [sum(bit for bit in (L.ALWAYS, L.NUMBERED, L.PROSE, L.SECOND, L.LABELLED, L.LISTED, L.CAPTIONED) if rnd.random() < 0.25) for _ in range(rnd.randrange(12))] for _ in range(300)]
    # numbered references that have begun are a stretch's own first line
    ahead = [L.FRESH | L.LISTED | L.LABELLED] if entries else []
    df = spark.createDataFrame([(k, m) for k, m in enumerate(stretches)], "id int, marks array<int>")
    got = {r["id"]: r["f"]["new"] for r in df.select("id", L.first_lines(F.col("marks"), F.lit(entries)).alias("f")).collect()}
    assert got == {k: sequential(ahead + m)[len(ahead) :] for k, m in enumerate(stretches)}


def test_paragraphs_of_stretches(spark):
    """Numbered references begin in one stretch and hold in the next ones."""
    base = dict(page=1, text="t", size=10.0, body=10.0, bold=False, italic=False, section_name=False, numbered="", next_body=True, x0=50.0, x1=300.0, col="left", span0=0.0, span1=306.0, region=None, number=None, cells=None)
    texts = ["References", "[1] One entry.", "goes on", "[2] Another.", "Figure 1. Cap", "[3] After it.", "ends here."]
    rows = [{**base, "doc_id": 1, "place": k, "text": t, "top": 40.0 + 12 * k, "bottom": 50.0 + 12 * k} for k, t in enumerate(texts)]
    rows[0] |= {"bold": True, "section_name": True, "size": 12.0}
    rows[4] |= {"region": "figure"}
    schema = "doc_id bigint, page int, place int, text string, size double, body double, bold boolean, italic boolean, section_name boolean, numbered string, next_body boolean, x0 double, x1 double, top double, bottom double, col string, span0 double, span1 double, region string, number string, cells array<array<string>>"
    names = [c.split()[0] for c in schema.split(", ")]
    got = L.paragraphs(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)).orderBy("para_no").collect()
    assert [(r["kind"], [p["place"] for p in r["places"]]) for r in got] == [("h2", [0]), ("ref", [1, 2]), ("ref", [3]), ("caption", [4]), ("ref", [5, 6])]
    assert L.paragraphs(spark.createDataFrame([], schema)).count() == 0


def test_paragraphs_become_blocks(spark):
    cells = [["a & b", "<c>"], ["1", "2"]]
    rows = [
        (1, 0, "title", None, None, None, "A <em>Study</em>"), (1, 1, "h2", None, None, None, "1 Methods &amp; more:"), (1, 2, "p", None, None, None, "text"), (1, 3, "caption", "figure", None, None, "<strong>Figure 2.</strong> A"),
        (1, 4, "caption", "table", None, cells, "Table S1. B"), (1, 5, "caption", "table", None, None, "Table 3 without cells"), (1, 6, "equation", "equation", "4a", None, "x = y (4a)"), (1, 7, "equation", "equation", None, None, "z"),
        (1, 8, "ref", None, None, None, "[7] An author"), (1, 9, "ref", None, None, None, "Another author 2020"), (1, 10, "ref", None, None, None, "[7] Again"), (1, 11, "caption", "figure", None, None, "no number"), (2, 0, "p", None, None, None, "other"),
    ]
    paras = spark.createDataFrame(rows, "doc_id bigint, para_no int, kind string, region string, number string, cells array<array<string>>, html string").withColumn("page", F.lit(0))
    got = [(r["block_id"], r["kind"], r["label"], r["fig"]) for r in L.finished_blocks(paras).orderBy("doc_id", "ord").collect()]
    assert got == [
        ("b001", "title", None, None), ("b002", "h2", None, None), ("b003", "p", None, None), ("fig-2", "figure", "Figure 2", "fig-2"), ("tab-s1", "table", "Table S1", None), ("tab-3", "figure", "Table 3", "tab-3"),
        ("eq-4a", "figure", "Equation (4a)", "eq-4a"), ("eq-x5", "figure", "Equation", "eq-x5"), ("ref-7", "ref", None, None), ("ref-x7", "ref", None, None), ("ref-7-2", "ref", None, None), ("fig-3", "figure", "Figure 3", "fig-3"), ("b001", "p", None, None),
    ]
    block = {r["block_id"]: r for r in L.finished_blocks(paras).where("doc_id = 1").collect()}
    assert block["b002"]["html"] == "1 Methods & more" and block["b001"]["html"] == "A <em>Study</em>"
    assert block["tab-s1"]["rows"] == [["a &amp; b", "&lt;c&gt;"], ["1", "2"]] and block["tab-s1"]["caption"] == "Table S1. B"
    assert block["eq-4a"]["caption"] == "<em>Equation (4a)</em>" and block["eq-4a"]["equation"] is True


def test_comments_of_annotations(spark):
    annots = [(1, 0, 0, "Highlight", None, " Ann ", 10.0, 60.0, 100.0, 110.0), (1, 0, 1, "Text", "why?", None, 0.0, 5.0, 117.0, 121.0), (1, 0, 2, "Link", "x", None, 0.0, 9.0, 0.0, 9.0), (1, 0, 3, "Text", "", None, 500.0, 505.0, 900.0, 901.0), (1, 1, 4, "Text", "", None, 0.0, 1.0, 0.0, 1.0), (1, 0, 5, "Text", "tie", None, 0.0, 1.0, 110.0, 115.0)]
    a = spark.createDataFrame(annots, "doc_id bigint, page int, annot_no int, subtype string, contents string, author string, x0 double, x1 double, top double, bottom double")
    words = spark.createDataFrame([(1, 0, k, t, x, x + 10, 100.0, 110.0) for k, (t, x) in enumerate([("one", 9.0), ("two", 30.0), ("three", 55.0)])], "doc_id bigint, page int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    lines = spark.createDataFrame([(1, 0, 0, "one two three", 100.0, 110.0), (1, 0, 1, "next line", 115.0, 125.0)], "doc_id bigint, page int, line_no int, text string, top double, bottom double")
    got = {r["annot_no"]: (r["author"], r["text"], r["exact"]) for r in L.annotation_comments(a, words, lines).collect()}
    # a mark quotes the words in its box; a note the nearest line, of equals the first; a note without text or line is none
    assert got == {0: ("Ann", "(highlight)", "one two"), 1: ("", "why?", "next line"), 3: ("", "", "next line"), 5: ("", "tie", "one two three")}
