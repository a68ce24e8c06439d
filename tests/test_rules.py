"""Functions and lookups against tables and hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from folioscope.functions import stats
from folioscope.functions import text as T
from folioscope.operators import notes as N
from folioscope.sources import latex


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_p_values_of_tables(spark):
    rows = [(0.1 * k,) for k in range(-60, 90)]
    for z, p in spark.createDataFrame(rows, "z double").select("z", stats.normal_p(F.col("z"))).collect():
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)
    # Student's t with 1 to 4 degrees of freedom, and chi-square with an even number, have closed forms.
    closed = {
        1: lambda t: 1 - 2 / math.pi * math.atan(t), 2: lambda t: 1 - t / math.sqrt(2 + t * t),
        3: lambda t: 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + t * math.sqrt(3) / (3 + t * t)), 4: lambda t: 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t)),
    }
    cases = [(t, df) for t in (0.0, 0.3, 1.0, 2.5, 9.0, 40.0) for df in closed]
    for t, df, p, q in spark.createDataFrame(cases, "t double, df int").select("t", "df", stats.t_p(F.col("t"), F.col("df")), stats.t_p(-F.col("t"), F.col("df"))).collect():
        assert p == pytest.approx(closed[df](t), abs=1e-12) and p == q
    cases = [(float(x), df) for x in (0, 0.5, 3, 20, 90) for df in (2, 4, 10, 60)]
    for x, df, p in spark.createDataFrame(cases, "x double, df int").select("x", "df", stats.chi_square_p(F.col("x"), F.col("df"))).collect():
        assert p == pytest.approx(math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(df // 2)), rel=1e-9)
    # published critical values
    for t, df, p in ((12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (2.750, 30, 0.01), (1.983971519, 100, 0.05), (2.5758293, 10**6, 0.01)):
        assert one(spark, stats.t_p(F.lit(t), F.lit(df))) == pytest.approx(p, rel=2e-4)
    for x, df, p in ((3.841458821, 1, 0.05), (18.30703805, 10, 0.05), (124.3421134, 100, 0.05), (1074.679, 1000, 0.05)):
        assert one(spark, stats.chi_square_p(F.lit(x), F.lit(df))) == pytest.approx(p, rel=1e-4)
    for bad in (stats.t_p(F.lit(1.0), F.lit(0)), stats.t_p(F.lit(None), F.lit(3)), stats.chi_square_p(F.lit(float("nan")), F.lit(3)), stats.normal_p(F.lit(None))):
        assert one(spark, bad) is None


def test_a_note_without_replies_has_an_empty_thread(spark):
    notes = spark.createDataFrame([(1, "n1"), (1, "n2"), (2, "n1")], "doc_id bigint, id string")
    replies = spark.createDataFrame([(1, "c2", "n1", "b", "2024"), (1, "c1", "n1", "a", "2024"), (1, "c3", "n1", "first", None)], "doc_id bigint, id string, note string, text string, createdAt string")
    got = {(r["doc_id"], r["id"]): [x["text"] for x in r["replies"]] for r in N.with_replies(notes, replies).collect()}
    assert got == {(1, "n1"): ["first", "a", "b"], (1, "n2"): [], (2, "n1"): []}
    assert all(r["replies"] == [] for r in N.with_replies(notes, replies.where("false")).collect())


def test_links_references_and_wrapped_paragraphs(spark):
    assert one(spark, T.without_links(F.lit(' <a href="x">one\ntwo</a> \n <a id="y">z</a>\n'))) == '<span class="link">one two</span> <span class="link">z</span>'
    for text, want in ((" [3] A", "ref-3"), ("12. B", "ref-12"), ("7) C", "ref-7"), ("2020 was a year", None), ("[4 D", None), ("", None)):
        assert one(spark, T.reference_id(F.lit(text))) == want
    for text, want in ((" <p>a <b>b</b></p>\n", "a <b>b</b>"), ("<p>a</p><p>b</p>", "<p>a</p><p>b</p>"), ("<p></p>", ""), ("x <p>a</p>", "x <p>a</p>"), ("", "")):
        assert one(spark, T.unwrapped(F.lit(text))) == want
    assert one(spark, T.without_annotations(F.lit('a<annotation encoding="t">\nx</annotation>b<annotation>y</annotation>'))) == "ab"


def test_images_are_found_by_the_front_of_their_names(spark):
    files = spark.createDataFrame([(1, "figs/fig1-final.png"), (1, "a/fig1-draft.png"), (1, "fig2.jpg"), (1, "fig2.pdf"), (2, "fig3-x.png"), (1, "raw/plot")], "doc_id bigint, path string")
    wanted = spark.createDataFrame([(1, 1, " fig1 "), (2, 1, "fig2"), (3, 1, "fig3"), (4, 2, "fig3"), (5, 1, "raw/plot"), (6, 1, "x/"), (7, 1, "other/fig2.jpg")], "k int, doc_id bigint, name string")
    got = {r["k"]: r["path"] for r in latex.resolve_images(wanted, files, "k").collect()}
    assert got == {1: "a/fig1-draft.png", 2: "fig2.pdf", 4: "fig3-x.png", 5: "raw/plot", 7: "fig2.jpg"}


def test_declared_figures_of_all_kinds(spark):
    image = r"\includegraphics{a}"
    cases = {
        rf"\begin{{figure}}{image}\end{{figure}} \begin{{sidewaysfigure*}}{image}{image}\end{{sidewaysfigure*}} \begin{{wrapfigure}}{{r}}{{2cm}}{image}\end{{wrapfigure}}": 3,
        rf"\begin{{figure*}}{image}\captionof{{figure}}{{a}}{image}\captionof{{figure}}{{b}}\end{{figure*}} \captionof{{figure}}{{c}}": 3,
        rf"\begin{{figure}}no image\end{{figure}} % \begin{{figure}}{image}\end{{figure}}": 0,
        rf"\begin{{figure}} \begin{{wrapfigure}}{image} \end{{figure}}": 1,
    }
    for text, want in cases.items():
        assert one(spark, latex.declared_figures(F.lit(text))) == want
