"""Blocks from HTML, LaTeX and Word; paragraphs from words; pixels; lint."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from folioscope.operators import blocks as B
from folioscope.operators import layout as L
from folioscope.operators import lint, pixels
from folioscope.sources import docx, latex, store_files

PAGE = """<header><h1 class='title'>T &amp; U</h1><div class='author'>Ann</div><div class='abstract'><p>Short.</p></div></header>
<h2>Methods</h2><p>One <a href='x'>link</a> here<p>Two<b>bold</b></p><p><strong>Run in</strong></p><p><em>Head</em></p>
<p>Table 1. Sizes</p><table><tr><th>a<th>b</tr><tr><td>1</td><td>2</td></tr></table>
<figure><img src='a.png'><figcaption>Figure 2. Map</figcaption></figure><p><img src='b.png'></p><p>Figure 2: Again</p>
<h2>References</h2><p>[1] First.</p><p>2. Second.</p><ul><li>Third</li></ul><script>x</script>"""


def test_blocks_from_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "doc_id bigint, html string")
    found = B.finished(B.parse_blocks(pages))
    rows = found.where("doc_id = 1").orderBy("ord").collect()
    assert [(r["kind"], r["block_id"]) for r in rows] == [
        ("title", "b001"), ("p", "b002"), ("h2", "b003"), ("p", "b004"), ("h2", "b005"), ("p", "b006"), ("p", "b007"), ("h2", "b008"), ("h3", "b009"), ("table", "tab-1"), ("figure", "fig-2"), ("figure", "fig-2-2"), ("h2", "b010"), ("ref", "ref-1"), ("ref", "ref-2"), ("ref", "ref-x13"),
    ]
    assert rows[5]["html"] == 'One <span class="link">link</span> here' and rows[9]["rows"] == [["a", "b"], ["1", "2"]] and rows[9]["caption"] == "Table 1. Sizes"
    texts = {r["block_id"]: r["text"] for r in B.block_texts(found).where("doc_id = 1").collect()}
    assert texts["b001"] == "T & U" and texts["tab-1"] == "Table 1. Sizesab12" and texts["fig-2-2"] == "Figure 2: Again"
    assert found.where("doc_id > 1").count() == 0
    lines = [r["line"] for r in B.outline(found, B.block_texts(found)).orderBy("ord").collect()]
    assert lines[0] == "b001       title   T & U" and lines[9].startswith("tab-1      table   Table 1 Table 1. Sizes")


def test_sanitiser():
    assert B.sanitise("<p onclick='x'>a<script>b</script><a href='javascript:x'>c</a><font><b>d</b></font></p>") == "<p>a<a>c</a><b>d</b></p>"


TABLES = r"""\begin{document}\resizebox{\textwidth}{!}{\begin{tabular}{@{}l>{\centering}p{2cm}c@{}}\toprule
\shortstack{Site\\name} & Mean score & N \\ \midrule North clinic & 12.5 & 30 \\ South clinic & \multicolumn{1}{c}{14.0} & 28 \\ \bottomrule\end{tabular}}\end{document}"""
LONG = r"""\begin{longtable}{ll}\caption{Visits}\\ \toprule Visit & Window \\ \endfirsthead \toprule Visit & Window (continued) \\ \endhead Baseline & Day 0 \\ Follow-up & Week 4 \\ \end{longtable}"""


def test_latex_tables():
    assert latex.table_rows(latex.simplified_tables(TABLES)) == [["Site name", "Mean score", "N"], ["North clinic", "12.5", "30"], ["South clinic", "14.0", "28"]]
    rows = latex.table_rows(latex.simplified_tables(LONG))
    assert rows == [["Visit", "Window"], ["Baseline", "Day 0"], ["Follow-up", "Week 4"]]


def test_latex_project(spark):
    main = r"""\documentclass{article}\title{On things}\begin{document}\maketitle
\begin{abstract}Short.\end{abstract}\section{Intro} Some \emph{text}. % note

Next one.
\begin{figure*}\includegraphics{a}\includegraphics{b}\caption{Two maps}\end{figure*}\begin{table}\caption{Sizes}\begin{tabular}{lc} x & 1 \\ y & 2 \end{tabular}\end{table}\end{document}"""
    files = spark.createDataFrame([(1, "p/main.tex", main), (1, "p/other.tex", main * 2), (1, "p/x.tex", "x"), (1, "p/refs.bib", "@article{a, author={A. B.}, title={One {Two}}, year=2020}\n@book{b, title={Three}}")], "doc_id bigint, path string, text string")
    assert latex.main_files(files).first()["path"] == "p/main.tex"
    rows = B.finished(B.parse_blocks(latex.projects_to_html(files))).orderBy("ord").collect()
    assert [r["kind"] for r in rows] == ["title", "h2", "p", "h2", "p", "p", "figure", "table", "h2", "ref", "ref"]
    assert rows[7]["rows"] == [["x", "1"], ["y", "2"]] and rows[6]["caption"] == "Two maps" and rows[9]["html"] == "A. B.. One Two. 2020"
    counted = files.where("path = 'p/main.tex'").select(latex.declared_figures(F.col("text")).alias("n"), latex.unstarred(F.col("text")).alias("t")).first()
    assert counted["n"] == 1 and "figure*" not in counted["t"]


def word_file():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"""<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>Paper</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Results</w:t></w:r></w:p>
<w:p><w:r><w:t xml:space="preserve">A long lead of words before </w:t></w:r><w:commentRangeStart w:id="0"/><w:r><w:rPr><w:b/></w:rPr><w:t>this</w:t></w:r><w:commentRangeEnd w:id="0"/><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>2</w:t></w:r></w:p>
<w:p><w:r><w:t/></w:r><w:r><w:txbxContent><w:p><w:r><w:t>Figure 1. In a box</w:t></w:r></w:p><w:p><w:r><w:t>Figure 1. In a box</w:t></w:r></w:p></w:txbxContent></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/comments.xml", f'<w:comments {w}><w:comment w:id="0" w:author="Kim"><w:p><w:r><w:t>why</w:t></w:r></w:p></w:comment></w:comments>')
    return out.getvalue()


def test_word_files(spark):
    parsed = docx.parse_docx(spark.createDataFrame([(1, bytearray(word_file())), (2, bytearray(b"no zip")), (3, None)], "doc_id bigint, content binary")).cache()
    one = parsed.where("doc_id = 1").first()
    assert one["captions"] == ["Figure 1. In a box"] and one["html"].startswith("<header><h1>Paper</h1></header><h1>Results</h1><p>A long lead of words before <strong>this</strong><sup>2</sup></p>")
    assert [tuple(r) for r in docx.comments_of(parsed).collect()] == [(1, 0, "Kim", "why", "A long lead of words before this")]
    assert parsed.where("error is not null").count() == 2 and docx.caption_queue(parsed).first()["n"] == 1


def test_captions_in_text_boxes_reach_figures(spark):
    parsed = spark.createDataFrame(
        [(1, "<p>Words.</p><p><img src='a'></p><p>More.</p><p><img src='b'></p><p>Figure 9. Own</p><table><tr><td>1</td></tr></table>", ["Figure 1. First", "Table 3. Sizes", "Figure 2. Never"])], "doc_id bigint, html string, captions array<string>"
    )
    rows = {r["block_id"]: r["caption"] for r in docx.word_blocks(parsed).where("kind in ('figure', 'table')").collect()}
    assert rows == {"fig-1": "Figure 1. First", "fig-9": "Figure 9. Own", "tab-3": "Table 3. Sizes"}


def test_rows_of_cells_with_as_many_lines_are_split(spark):
    rows = [["a\nb", "", "c\nd"], ["x\ny", "z"], ["", None], ["one", "two"]]
    got = spark.createDataFrame([(rows,)], "rows array<array<string>>").select(L.split_rows(F.col("rows")).alias("r")).first()["r"]
    assert got == [["a", "", "c"], ["b", "", "d"], ["x y", "z"], ["one", "two"]]


def test_baselines_and_hosts():
    assert L.baselines([10.0, 10.5, 24.0, 11.9], [10.0, 6.0, 10.0, 10.0]) == [0, 0, 1, 0]


def test_words_to_paragraphs(spark):
    words, n = [], 0

    def line(text, page, top, size=10.0, x=50.0, font="Times", wide=460):
        nonlocal n
        unit = wide / (len(text) + 1)
        for t in text.split():
            words.append((1, page, n, t, x, x + len(t) * unit, top, top + size, size, font, False))
            x += (len(t) + 1) * unit
            n += 1

    for page in (0, 1):
        line("Journal of Things " + str(page + 1), page, 20.0, 8.0, wide=120)
        line(str(page + 1), page, 770.0, 8.0, wide=10)
    line("A Study of Many Things", 0, 60.0, 18.0)
    line("1 Introduction", 0, 110.0, 12.0, font="Times-Bold", wide=90)
    for i in range(8):
        line("the words of a paragraph " + "abcdefgh"[: i + 1] + " run on and on over the whole wide line so", 0, 130.0 + 12 * i)
    line("that it ends here.", 0, 130.0 + 12 * 8, wide=120)
    for i in range(4):
        line("A second " + "abcdefgh"[: i + 1] + " paragraph begins below with a gap above it and goes on for", 0, 250.0 + 12 * i)
    line("References", 1, 60.0, 12.0, font="Times-Bold", wide=70)
    line("[1] An author wrote a title that is very long and fills the whole line", 1, 80.0)
    line("[2] Another author wrote a title that is very long and fills the line", 1, 92.0)
    df = spark.createDataFrame(words, "doc_id bigint, page int, word_no int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string, cid boolean")
    pages = spark.createDataFrame([(1, 0, 612.0, 792.0), (1, 1, 612.0, 792.0)], "doc_id bigint, page int, w double, h double")
    rows = L.blocks_of(df, pages).orderBy("para_no").collect()
    assert [r["kind"] for r in rows] == ["title", "h2", "p", "p", "h2", "ref", "ref"]
    assert rows[2]["html"].endswith("that it ends here.") and "Journal" not in "".join(r["html"] for r in rows)
    assert L.body_sizes(df).first()["body"] == 10.0
    few = df.where("word_no < 5")
    assert L.blocks_of(few, pages).count() == 0


def test_pixels(spark):
    rows = [("f", y, x, 0 if y in (2, 3, 10) or x == 5 else 250) for y in range(20) for x in range(20)]
    df = spark.createDataFrame(rows, "fig_id string, y int, x int, g int")
    assert [round(r["at"], 3) for r in pixels.line_positions(pixels.dark_lines(df, "y", 0.5)).orderBy("island").collect()] == [0.125, 0.5]
    assert tuple(pixels.content_box(df).first())[1:] == (0, 0, 19, 19)


def test_store_files(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "replies").mkdir()
    for i in (1, 2):
        (tmp_path / "notes" / f"n{i}.json").write_text(json.dumps({"id": f"n{i}", "kind": "note", "comment": "x\ny"}))
        (tmp_path / "replies" / f"c{i}.json").write_text(json.dumps({"id": f"c{i}", "note": "n1", "text": "t"}))
    export = tmp_path / "export.json"
    export.write_text(json.dumps({"format": "review-notes", "version": 3, "annotations": [{"id": "n9"}], "replies": [{"id": "c9", "note": "n9"}], "edits": [{"block": "b1", "text": "new"}]}))
    assert sorted(r["id"] for r in store_files.read_notes(spark, str(tmp_path / "notes")).collect()) == ["n1", "n2"]
    assert store_files.read_notes(spark, str(export)).first()["id"] == "n9"
    assert store_files.read_replies(spark, str(tmp_path / "notes")).count() == 2
    (tmp_path / "sub").mkdir()
    moved = tmp_path / "sub" / "export.json"
    moved.write_text(export.read_text())
    assert store_files.read_replies(spark, str(moved)).first()["id"] == "c9" and store_files.read_edits(spark, str(moved)).first()["text"] == "new"
    listing = tmp_path / "list.txt"
    listing.write_text('- "n1" 12 bytes "a" version 3\nnoise\n- "n1" 12 bytes "a" version 4\n')
    assert tuple(store_files.read_listing(spark, str(listing)).first()) == ("n1", 4)


def test_lint(spark, tmp_path):
    good = tmp_path / "skills" / "tidy-notes"
    good.mkdir(parents=True)
    (good / "SKILL.md").write_text("---\nname: tidy-notes\ndescription: Tidies notes. Second sentence.\nversion: 1.2.0\nmetadata:\n  author: me\n---\nUse `scripts/a.py`.\n")
    skills = store_files.read_skills(spark, str(tmp_path / "skills"))
    assert skills.first()["meta"]["metadata.author"] == "me"
    skills = skills.withColumn("meta", F.map_filter("meta", lambda k, v: ~k.contains(".")))
    log = lint.sections(spark.createDataFrame([("# Log\n\n## tidy-notes\n\n### 1.2.0\n\nNew.\n\n### 1.1.0\n\nOld.\n\n## Repository\n\n### 2.0.0\n\nX.\n",)], "text string"))
    assert [(r["section"], r["version"]) for r in log.orderBy("s_pos", "pos").collect()] == [("tidy-notes", "1.2.0"), ("tidy-notes", "1.1.0"), ("Repository", "2.0.0")]
    files = spark.createDataFrame([("tidy-notes", "scripts/b.py")], "skill string, path string")
    bad = lint.rule_violations(skills, log, files)
    assert [r["message"] for r in bad.collect()] == ["mentioned file does not exist: scripts/a.py"]
    assert lint.lint_report(skills, bad).first()["state"] == "FAIL"
    tags = spark.createDataFrame([("tidy-notes-v1.2.0",), ("tidy-notes-v1.1.0",), ("odd",)], "tag string")
    assert [r["state"] for r in lint.release(tags, skills, log).orderBy("tag").collect()] == ["no tag of a release", "version differs", "ok"]
    assert "Tidies notes. |" in lint.index_rows(skills).first()["row"]
    names = spark.createDataFrame([("alpha",), ("Repository",), ("zeta",)], "name string")
    assert [r["name"] for r in lint.with_section(names, "mid").orderBy("place").collect()] == ["alpha", "mid", "zeta", "Repository"]
