"""Rows that the smallest tables do not hold, with the SQL of the queries where they have one."""

import duckdb

from folioscope.operators import blocks as B
from folioscope.operators import edits as E
from folioscope.operators import layout as L
from folioscope.operators.tables import dealt, written
from folioscope.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem")


def against_sql(spark, folder, name, changed):
    """The rows of a query and of its SQL over the smallest tables, some of them ``changed`` by SQL."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"copy ({changed.get(t, 'select * from {t}').format(t=f"'{SMALL}/{t}.parquet'")}) to '{folder}/{t}.parquet'")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.sql(ORACLES[name])
    return sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))), sorted(map(str, want.fetchall()))


def test_states_of_notes_without_any(spark, tmp_path):
    """A customer whose only orders are notes without a state."""
    changed = {"orders": "select * replace (case when o_custkey % 4 = 0 then 'O' else o_orderstatus end as o_orderstatus, case when o_custkey % 4 = 0 then o_orderkey * 3 else o_orderkey end as o_orderkey) from {t}"}
    got, want = against_sql(spark, tmp_path, "a2_conditional_counts", changed)
    assert any("None" in r for r in want)
    assert got == want


def holds_few_rows(df):
    """Whether no Python step of a plan takes Arrow's batches, which hold thousands of documents however long they are."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BatchEvalPython" in plan and not any(p in plan for p in ("ArrowEvalPython", "InPandas", "InArrow"))


def test_pages_are_read_a_few_at_a_time(spark):
    """Null and empty pages among others give the elements that they have."""
    pages = spark.createDataFrame([(1, "<h1>a</h1><p>b <b>c</b></p>"), (2, None), (3, ""), (4, "<p>d</p>")], "doc_id long, html string")
    found = B.page_elements(pages)
    assert holds_few_rows(found)
    assert sorted((r.doc_id, r.pos, r.role, r.text) for r in found.collect()) == [(1, 0, "head", "a"), (1, 1, "text", "b c"), (4, 0, "text", "d")]


def test_html_is_cleaned_a_few_at_a_time(spark):
    pages = spark.createDataFrame([(1, "<p onclick='x'>a<script>b</script></p>"), (2, None)], "doc_id long, html string")
    clean = pages.select("doc_id", B.sanitised("html").alias("html"))
    assert holds_few_rows(clean)
    assert dict(clean.collect()) == {1: "<p>a</p>", 2: None}


def test_texts_are_compared_a_few_at_a_time(spark):
    pairs = spark.createDataFrame([(1, "a b c", "a x c"), (2, "", "a")], "k long, before string, after string")
    changed = E.tracked_changes(pairs, "k", "before", "after")
    assert holds_few_rows(changed)
    assert sorted((r.k, r.n, r.op, r.text) for r in changed.collect()) == [(1, 0, "keep", "a "), (1, 1, "delete", "b"), (1, 2, "insert", "x"), (1, 3, "keep", " c"), (2, 0, "insert", "a")]


def test_words_of_a_page_are_shuffled_once(spark):
    """Lines of words in buckets are those of the same words as they come, with nothing shuffled for them."""
    names = "doc_id long, page int, word_no int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string, cid boolean"
    words = spark.createDataFrame([(d, p, n, f"w{n}", 40.0 * n, 40.0 * n + 30, 60.0 + 14 * (n % 3), 70.0 + 14 * (n % 3), 10.0, "Times", False) for d in (1, 2, 3) for p in (0, 1) for n in range(8)], names)
    pages = spark.createDataFrame([(d, p, 612.0, 792.0) for d in (1, 2) for p in (0, 1)], "doc_id long, page int, w double, h double")
    gutter = words.where("doc_id = 1").select("doc_id", "page").distinct().select("doc_id", L.F.lit(1e9).alias("left_edge"), L.F.lit(2e9).alias("right_edge")).distinct()
    want = L.lines_of(L.usable_words(words, pages), gutter)
    bucketed = written(L.usable_words(L.sized(words, pages, 3), pages), 3)
    got = L.lines_of(bucketed, written(gutter, 3), 3)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.drop("w", "h").collect())) == sorted(map(str, want.collect()))
    assert {r.w for r in got.collect()} == {612.0}


def test_lines_of_pages_with_and_without_raised_words(spark):
    """Pages of one baseline, and of equal sizes, are as the search for what a small word touches leaves them; a raised word moves."""
    names = "doc_id long, page int, word_no int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string, cid boolean"
    put = lambda d, n, bottom, size: (d, 0, n, f"w{n}", 40.0 * n, 40.0 * n + 38, bottom - size, bottom, size, "Times", False)
    words = [put(1, 0, 100.0, 10.0), put(1, 1, 100.0, 6.0), put(2, 0, 100.0, 10.0), put(2, 1, 130.0, 9.0), put(3, 0, 100.0, 10.0), put(3, 1, 94.0, 6.0)]
    gutter = spark.createDataFrame([], "doc_id long, left_edge double, right_edge double")
    found = {(r.doc_id, r.word_no): (r.row, r.line, r.ref) for r in L.on_lines(spark.createDataFrame(words, names), gutter).collect()}
    assert found == {(1, 0): (0, 0, 10.0), (1, 1): (0, 0, 10.0), (2, 0): (0, 0, 10.0), (2, 1): (1, 1, 9.0), (3, 0): (1, 1, 10.0), (3, 1): (0, 1, 10.0)}


def test_more_rows_are_dealt_to_more_tasks(spark):
    rows = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert [dealt(rows.where(f"doc_id < {n}"), 10).rdd.getNumPartitions() for n in (500, 1000)] == [50, 100]


def test_bands_are_dealt_by_document(spark):
    """The steps of reading order stay in the tasks that the rows were dealt to."""
    plan = QUERIES["w12_bands"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_drafts_are_dealt_to_tasks_of_bounded_size(spark):
    plan = QUERIES["f7_box_inside_image"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
