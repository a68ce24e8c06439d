"""Text functions, captions, quotes, predicates and files, over the documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import anchors, lint
from . import standins as S
from .registry import query

_SP = "[\\s\\x1c-\\x1f]"


@query("e5_squeezed_text", f"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_SP}+', ' ', 'g')) AS tidy FROM documents")
def e5(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.squeeze(F.col("text")).alias("tidy"))


@query("e6_canonical_text", f"SELECT item_id, regexp_replace(translate('“' || text || '” – ' || chr(160) || 'x', '“”–' || chr(160), '\"\"- '), '{_SP}+', ' ', 'g') AS tidy FROM benchmark")
def e6(spark, d):
    return S.table(spark, d, "benchmark").select("item_id", T.canon(F.concat(F.lit("“"), F.col("text"), F.lit("” –  x"))).alias("tidy"))


@query("e7_token_counts", "SELECT doc_id, len(regexp_extract_all(text, '[\\s]+|[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS n FROM documents")
def e7(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))


@query("e14_change_markdown", """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE ' ' END AS o, CASE WHEN turn % 3 <> 0 THEN 'new ' || text || ' ' ELSE chr(10) END AS n FROM conversations), s AS (SELECT *, regexp_replace(o, '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(n, '^\\s+|\\s+$', '', 'g') AS b FROM c)
       SELECT conv_id, turn, CASE WHEN a = '' AND b = '' THEN '(see reason)' WHEN a = '' THEN 'insert **' || b || '**' WHEN b = '' THEN 'delete ~~' || a || '~~' ELSE '~~' || a || '~~ → **' || b || '**' END AS change FROM s""")
def e14(spark, d):
    c = S.table(spark, d, "conversations")
    o, n = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(" "), F.when(F.col("turn") % 3 != 0, F.concat(F.lit("new "), "text", F.lit(" "))).otherwise("\n")
    return c.select("conv_id", "turn", T.change_markdown(o, n).alias("change"))


_CAP = "CASE doc_id % 4 WHEN 0 THEN 'Figure ' WHEN 1 THEN 'Supplementary Table S' WHEN 2 THEN 'eFigure ' ELSE 'See ' END || CAST(doc_id % 9 + 1 AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN 'b' ELSE '' END || '. ' || text"


@query("e15_caption_labels", f"""WITH c AS (SELECT doc_id, {_CAP} AS s FROM documents), n AS (SELECT doc_id, s, regexp_extract(s, '(?i)^\\s*(?:Supplementary\\s+|Extended\\s+Data\\s+)?(Figure|Fig\\.?|eFigure|Table|eTable)\\s*(S?\\d+[A-Za-z]?)', 2) AS k,
       regexp_matches(s, '(?i)^\\s*(?:Supplementary\\s+|Extended\\s+Data\\s+)?e?Table') AS tab FROM c)
       SELECT doc_id, CASE WHEN k = '' THEN '' ELSE CASE WHEN tab THEN 'Table ' ELSE 'Figure ' END || upper(k) END AS label, CASE WHEN k = '' THEN '' ELSE CASE WHEN tab THEN 'tab-' ELSE 'fig-' END || lower(k) END AS slug FROM n""")
def e15(spark, d):
    s = F.expr(_CAP.replace("VARCHAR", "STRING"))
    return S.table(spark, d, "documents").select("doc_id", T.caption_label(s).alias("label"), T.caption_slug(s).alias("slug"))


@query("e16_links_to_spans", """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<a [^>]*>(.*?)</a>', '<span class="link">\\1</span>', 'g'), '\\s*\\n\\s*', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS html FROM pages""")
def e16(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.without_links(F.col("html")).alias("html"))


_WRAPPED = "CASE doc_id % 4 WHEN 0 THEN ' <p>' || text || '</p>' || chr(10) WHEN 1 THEN '<p>' || text || '</p><p>more</p>' WHEN 2 THEN '<p><annotation encoding=\"t\">' || text || '</annotation>x</p>' ELSE text END"


@query("e17_unwrapped", f"""WITH w AS (SELECT doc_id, {_WRAPPED} AS html FROM documents), a AS (SELECT doc_id, regexp_replace(html, '(?s)<annotation.*?</annotation>', '', 'g') AS html FROM w)
       SELECT doc_id, CASE WHEN regexp_full_match(html, '(?s)\\s*<p>.*</p>\\s*') AND NOT contains(regexp_extract(html, '(?s)^\\s*<p>(.*)</p>\\s*$', 1), '<p>') THEN regexp_extract(html, '(?s)^\\s*<p>(.*)</p>\\s*$', 1) ELSE html END AS html FROM a""")
def e17(spark, d):
    wrapped = F.expr(_WRAPPED.replace("chr(10)", "char(10)"))
    return S.table(spark, d, "documents").select("doc_id", T.unwrapped(T.without_annotations(wrapped)).alias("html"))


@query("f1_block_text", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def f1(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.without_tags(F.col("html")).alias("text"))


@query("e21_file_names", "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]+$', '') AS stem, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS suffix, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def e21(spark, d):
    u = F.col("url")
    return S.table(spark, d, "pages").select("page_id", T.file_stem(u).alias("stem"), T.file_suffix(u).alias("suffix"), T.slug(u).alias("slug"))


@query("e22_first_sentence", "SELECT item_id, CASE WHEN regexp_matches(t, '[.!?]\\s') THEN regexp_extract(t, '(?s)^(.*?[.!?])\\s', 1) ELSE t END AS first FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark)")
def e22(spark, d):
    return S.table(spark, d, "benchmark").select("item_id", T.first_sentence(F.col("text")).alias("first"))


_ENTRY = "CASE doc_id % 6 WHEN 0 THEN ' [' || doc_id || '] ' || text WHEN 1 THEN doc_id || '. ' || text WHEN 2 THEN doc_id || ') ' || text WHEN 3 THEN doc_id || ' ' || text WHEN 4 THEN '[' || doc_id || ' ' || text ELSE text END"


@query("e26_reference_ids", f"""WITH e AS (SELECT doc_id, regexp_extract({_ENTRY}, '^\\s*\\[?(\\d+)[\\].)]', 1) AS n FROM documents) SELECT doc_id, CASE WHEN n <> '' THEN 'ref-' || n END AS ref FROM e""")
def e26(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.reference_id(F.expr(_ENTRY)).alias("ref"))


@query("e13_latex_escapes", r"""WITH t AS (SELECT item_id, text || ' 50% & #1_{a}~^\ “q” ‘s’ a–b—c' AS s FROM benchmark), c AS (SELECT item_id, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS n FROM t)
       SELECT item_id, string_agg(CASE c WHEN '\' THEN '\textbackslash{}' WHEN '~' THEN '\textasciitilde{}' WHEN '^' THEN '\textasciicircum{}' WHEN '“' THEN '``' WHEN '”' THEN '''''' WHEN '‘' THEN '`' WHEN '’' THEN '''' WHEN '–' THEN '--' WHEN '—' THEN '---'
              ELSE CASE WHEN c IN ('&', '%', '$', '#', '_', '{', '}') THEN '\' || c ELSE c END END, '' ORDER BY n) AS tex FROM c GROUP BY item_id""")
def e13(spark, d):
    odd = F.concat(F.col("text"), F.lit(" 50% & #1_{a}~^\\ “q” ‘s’ a–b—c"))
    return S.table(spark, d, "benchmark").select("item_id", T.latex_escaped(odd).alias("tex"))


@query("a12_occurrences", "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def a12(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.occurrences(F.col("text"), F.lit("the")).alias("n"))


@query("w22_nth_occurrence", """WITH t AS (SELECT doc_id, text, doc_id % 4 AS occ, string_split(text, 'an') AS p FROM documents)
       SELECT doc_id, CASE WHEN len(p) - 1 <= occ THEN -1 ELSE CAST(list_sum(list_transform(p[1:occ + 1], lambda x: length(x))) + occ * 2 AS BIGINT) END AS at FROM t""")
def w22(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.nth_offset(F.col("text"), F.lit("an"), (F.col("doc_id") % 4).cast("int")).alias("at"))


@query("w27_line_numbers", "SELECT doc_id, length(p) - length(replace(p, chr(10), '')) + 1 AS line FROM (SELECT doc_id, substr(text, 1, CAST(length(text) // 2 AS BIGINT)) AS p FROM documents)")
def w27(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.line_number(F.col("text"), F.floor(F.length("text") / 2)).cast("long").alias("line"))


@query("f9_dates", "SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def f9(spark, d):
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    s = F.when(F.col("event_id") % 3 == 0, F.concat(day, F.lit("T10:00:00Z"))).when(F.col("event_id") % 3 == 1, F.lit("2026-13-45")).otherwise("soon")
    return S.table(spark, d, "events").select("event_id", T.is_iso_date(s).alias("ok"))


@query("f10_section_heads", """WITH h AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '2.1 Methods' WHEN 1 THEN 'References:' WHEN 2 THEN text ELSE '3. Literature cited' END AS s FROM conversations)
       SELECT conv_id, turn, turn % 4 IN (0, 1) AS is_section, turn % 4 IN (1, 3) AS is_references FROM h""")
def f10(spark, d):
    s = F.expr("case turn % 4 when 0 then '2.1 Methods' when 1 then 'References:' when 2 then text else '3. Literature cited' end")
    return S.table(spark, d, "conversations").select("conv_id", "turn", s.rlike(T.SECTION).alias("is_section"), s.rlike(T.REFERENCES).alias("is_references"))


@query("f13_font_styles", "SELECT p_partkey, regexp_matches(f, 'bold|demi') AS bold, contains(f, 'italic') AS italic FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'times-bold' WHEN 1 THEN 'demi-italic' WHEN 2 THEN 'times' ELSE 'roman-italic' END AS f FROM part)")
def f13(spark, d):
    f = F.expr("case p_size % 4 when 0 then 'BOLDXX+Times-Bold' when 1 then 'Demi-Italic' when 2 then 'ITALIC+Times' else 'ABC+Roman-Italic' end")
    return S.table(spark, d, "part").select("p_partkey", T.font_is_bold(f).alias("bold"), T.font_is_italic(f).alias("italic"))


@query("f21_packaged_paths", "SELECT page_id FROM pages WHERE NOT (page_id % 5 = 0 OR page_id % 7 = 0)")
def f21(spark, d):
    path = F.expr("case when page_id % 5 = 0 then 'a/__pycache__/b.txt' when page_id % 7 = 0 then 'x/y.pyc' else concat('scripts/', page_id, '.py') end")
    return lint.packaged(S.table(spark, d, "pages").select("page_id", path.alias("path"))).select("page_id")


@query("f20_release_tags", """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'odd ' || p_partkey ELSE 'tool-' || (p_partkey % 7) || '-v1.' || (p_partkey % 3) || '.' || p_size END AS tag, 'tool-' || (p_partkey % 7) AS skill, '1.' || (p_partkey % 3) || '.' || p_size AS version FROM part),
       s AS (SELECT DISTINCT 'tool-' || (s_suppkey % 6) AS skill FROM supplier), l AS (SELECT DISTINCT 'tool-' || (p_partkey % 7) AS skill, '1.' || (p_partkey % 3) || '.' || p_size AS version FROM part WHERE p_size < 30 AND p_partkey % 3 = 1)
       SELECT p_partkey, CASE WHEN starts_with(tag, 'odd') THEN '' ELSE t.skill END AS skill, CASE WHEN starts_with(tag, 'odd') THEN '' ELSE t.version END AS version,
              CASE WHEN starts_with(tag, 'odd') THEN 'no tag of a release' WHEN s.skill IS NULL THEN 'unknown skill' WHEN t.version <> '1.1.7' THEN 'version differs' WHEN l.skill IS NULL THEN 'no notes' ELSE 'ok' END AS state
       FROM t LEFT JOIN s USING (skill) LEFT JOIN l ON l.skill = t.skill AND l.version = t.version""")
def f20(spark, d):
    """Parts as release tags of tools, all of which are at version 1.1.7."""
    part = S.table(spark, d, "part")
    name = F.concat(F.lit("tool-"), (F.col("p_partkey") % 7).cast("string"))
    version = F.concat(F.lit("1."), (F.col("p_partkey") % 3).cast("string"), F.lit("."), F.col("p_size").cast("string"))
    tag = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("odd "), F.col("p_partkey").cast("string"))).otherwise(F.concat(name, F.lit("-v"), version))
    skills = S.table(spark, d, "supplier").select(F.concat(F.lit("tool-"), (F.col("s_suppkey") % 6).cast("string")).alias("skill")).distinct().withColumn("meta", F.create_map(F.lit("version"), F.lit("1.1.7")))
    log = part.where("p_size < 30 and p_partkey % 3 = 1").select(name.alias("section"), version.alias("version"), F.lit("text").alias("body")).distinct()
    # A tag names its part, so that equal tags of several parts stay apart.
    tags = part.select("p_partkey", tag.alias("tag"))
    return tags.join(lint.release(tags.select("tag").distinct(), skills, log), "tag").select("p_partkey", "skill", "version", "state")


@query("o4_first_document_of_text", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def o4(spark, d):
    return anchors.first_of(S.table(spark, d, "documents").select("text", "doc_id"), ["text"], ["doc_id"]).select("text", "doc_id")


@query("o5_probe_prefixes", "WITH t AS (SELECT item_id, text AS q, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark), p AS (SELECT item_id, unnest([q, t, substr(t, 1, 120), substr(t, 1, 60), substr(t, 1, 30)]) AS probe, generate_subscripts([1, 2, 3, 4, 5], 1) - 1 AS probe_pos FROM t) SELECT item_id, CAST(probe_pos AS BIGINT) AS probe_pos, probe FROM p WHERE length(probe) >= 3")
def o5(spark, d):
    return S.table(spark, d, "benchmark").select("item_id", F.posexplode(anchors.probes(F.col("text"))).alias("probe_pos", "probe")).select("item_id", F.col("probe_pos").cast("long").alias("probe_pos"), "probe")


@query("s1_formats", "SELECT page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS suffix, CASE WHEN regexp_matches(url, '\\.html$') THEN 'html' ELSE 'unknown' END AS format FROM pages")
def s1(spark, d):
    from ..sources.store_files import format_of

    return S.table(spark, d, "pages").select("page_id", T.file_suffix(F.col("url")).alias("suffix"), format_of(F.col("url"), {".html": "html"}).alias("format"))


@query("s6_image_candidates", """WITH f AS (SELECT 'img' || item_id || CASE item_id % 3 WHEN 0 THEN '.png' ELSE '.jpg' END AS path FROM benchmark WHERE item_id % 3 < 2), w AS (SELECT item_id, 'img' || item_id AS name FROM benchmark),
       e AS (SELECT item_id, path FROM w JOIN f ON path IN (name || '.png', name || '.jpg'))
       SELECT item_id, path FROM e UNION ALL SELECT item_id, min(path) FROM w JOIN f ON starts_with(path, name) WHERE item_id NOT IN (SELECT item_id FROM e) GROUP BY 1""")
def s6(spark, d):
    """A third of the names have no file of their own, and take the first whose name begins with theirs."""
    from ..sources.latex import resolve_images

    b = S.table(spark, d, "benchmark")
    wanted = b.select("item_id", F.concat(F.lit("img"), F.col("item_id").cast("string")).alias("name"))
    files = b.where("item_id % 3 < 2").select(F.concat(F.lit("img"), F.col("item_id").cast("string"), F.when(F.col("item_id") % 3 == 0, ".png").otherwise(".jpg")).alias("path"))
    return resolve_images(wanted, files, "item_id").select("item_id", "path")


@query("w5_unique_ids", f"""WITH {S.TALK} SELECT doc_id, ord, kind || CASE WHEN n > 1 THEN '-' || CAST(n AS VARCHAR) ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) AS n FROM talk)""")
def w5(spark, d):
    from ..operators.blocks import unique_ids

    return unique_ids(S.talk(spark, d).withColumn("base", F.col("kind")), "base").select("doc_id", "ord", "id")


@query("w8_kind_counters", f"WITH {S.TALK} SELECT doc_id, ord, count(*) OVER (PARTITION BY doc_id, kind ORDER BY ord) AS n FROM talk")
def w8(spark, d):
    return S.talk(spark, d).select("doc_id", "ord", F.count("*").over(Window.partitionBy("doc_id", "kind").orderBy("ord")).alias("n"))


@query("e28_p_values", """WITH s AS (SELECT DISTINCT l_quantity / 10 AS t, l_linenumber % 4 + 1 AS df, CAST(l_quantity AS DOUBLE) AS x, l_linenumber AS half FROM lineitem)
       SELECT t, CAST(df AS INTEGER) AS df, CAST(half AS INTEGER) AS half, round(CASE df WHEN 1 THEN 1 - 2 / pi() * atan(t) WHEN 2 THEN 1 - t / sqrt(2 + t * t) WHEN 3 THEN 1 - 2 / pi() * (atan(t / sqrt(3)) + t * sqrt(3) / (3 + t * t)) ELSE 1 - t / sqrt(4 + t * t) * (1 + 2 / (4 + t * t)) END, 8) AS t_p,
              round(exp(-x / 2) * list_sum(list_transform(range(0, CAST(half AS BIGINT)), lambda j: pow(x / 2, j) / factorial(CAST(j AS INTEGER)))), 8) AS chi_p FROM s""")
def e28(spark, d):
    """Where the tails have closed forms: t of one to four degrees of freedom, chi-square of an even number."""
    rows = S.table(spark, d, "lineitem").select((F.col("l_quantity") / 10).alias("t"), (F.col("l_linenumber") % 4 + 1).alias("df"), F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").alias("half")).distinct()
    return rows.select("t", F.col("df").cast("int").alias("df"), F.col("half").cast("int").alias("half"), F.round(stats.t_p(F.col("t"), F.col("df")), 8).alias("t_p"), F.round(stats.chi_square_p(F.col("x"), 2 * F.col("half")), 8).alias("chi_p"))
