"""Column functions over block text, quotes, captions and labels. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns (Java syntax): captions, table captions, headings of reference lists, known section names, numbered headings.
CAPTION = r"(?i)^\s*(?:Supplementary\s+|Extended\s+Data\s+)?(Figure|Fig\.?|eFigure|Table|eTable)\s*(S?\d+[A-Za-z]?)"
TABLE_CAPTION = r"(?i)^\s*(?:Supplementary\s+|Extended\s+Data\s+)?e?Table"
REFERENCES = r"(?i)^(?:\d+\.?\s*)?(references|bibliography|literature cited|works cited|reference list)\s*:?\s*$"
SECTION = (
    r"(?i)^(?:\d+(?:\.\d+)*\.?\s+)?(abstract|introduction|background|methods?|materials and methods|results|discussion|conclusions?|references|"
    r"acknowledg(e)?ments|supplementary.*|appendix.*|data availability.*|funding|author contributions|competing interests|limitations)\s*:?\s*$"
)
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+[A-Z]"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
#: Typographic characters and what they count as.
CANON_FROM = "\u201c\u201d\u201e\u2018\u2019\u201a\u2013\u2014\u2212\u00a0\u2009\u202f"
CANON_TO = "\"\"\"'''---   "
SPACE = r"[\s\x1c-\x1f]"


def strip(s: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(s, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def squeeze(s: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), rf"(?U){SPACE}+", " "))


def canon(s: Column) -> Column:
    """Typographic quotes, dashes and spaces as plain ones, runs of white space as one space."""
    return F.regexp_replace(F.translate(F.coalesce(s, F.lit("")), CANON_FROM, CANON_TO), rf"(?U){SPACE}+", " ")


def tokens(s: Column) -> Column:
    """Runs of white space, runs of word characters, and single other characters."""
    word = r"[\p{L}\p{N}_]"
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(rf"(?U)({SPACE}+|{word}+|[^\p{{L}}\p{{N}}_\s\x1c-\x1f])"), F.lit(1))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text`` without overlap; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def nth_offset(text: Column, part: Column, n: Column) -> Column:
    """Offset from 0 of occurrence ``n`` (from 0, without overlap); -1 where there is none or ``n`` is negative."""
    start = F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("from"), F.lit(True).alias("on"))

    def step(acc: Column, _: Column) -> Column:
        at = F.call_function("locate", part, text, (acc["from"] + 1).cast("int")).cast("bigint") - 1
        at = F.when(acc["on"], at).otherwise(F.lit(-1).cast("bigint"))
        return F.struct(at.alias("at"), F.when(at >= 0, at + F.length(part)).otherwise(acc["from"]).cast("bigint").alias("from"), (acc["on"] & (at >= 0)).alias("on"))

    found = F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, step, lambda acc: acc["at"])
    return F.when((n < 0) | (F.length(part) == 0), F.lit(-1).cast("bigint")).otherwise(found)


def line_number(text: Column, offset: Column) -> Column:
    """Line, from 1, in which an offset lies."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def caption_number(s: Column) -> Column:
    return F.regexp_extract(s, CAPTION, 2)


def caption_label(s: Column) -> Column:
    """``Figure 2`` or ``Table S1``; empty where the text is no caption."""
    number = caption_number(s)
    return F.when(number == "", F.lit("")).otherwise(F.concat(F.when(s.rlike(TABLE_CAPTION), "Table ").otherwise("Figure "), F.upper(number)))


def caption_slug(s: Column) -> Column:
    """``fig-2`` or ``tab-s1``; empty where the text is no caption."""
    number = caption_number(s)
    return F.when(number == "", F.lit("")).otherwise(F.concat(F.when(s.rlike(TABLE_CAPTION), "tab-").otherwise("fig-"), F.lower(number)))


def reference_id(s: Column) -> Column:
    """``ref-N`` from the number that a reference entry begins with, before a bracket or a stop; null without one."""
    number = F.regexp_extract(s, r"^\s*\[?(\d+)[\].)]", 1)
    return F.when(number != "", F.concat(F.lit("ref-"), number))


def without_links(html: Column) -> Column:
    """Anchors as spans of class ``link``, runs of line breaks as one space, no white space around."""
    return strip(F.regexp_replace(F.regexp_replace(html, r"(?s)<a [^>]*>(.*?)</a>", '<span class="link">$1</span>'), r"\s*\n\s*", " "))


def without_annotations(html: Column) -> Column:
    """Without annotation elements, in which MathML repeats its source."""
    return F.regexp_replace(html, r"(?s)<annotation.*?</annotation>", "")


def unwrapped(html: Column) -> Column:
    """The inside of a text that is one paragraph element, else the text."""
    one = r"(?s)^\s*<p>((?:(?!<p>).)*)</p>\s*$"
    return F.when(html.rlike(one), F.regexp_extract(html, one, 1)).otherwise(html)


def without_tags(html: Column) -> Column:
    """Text of well-formed inline markup without entities."""
    return F.regexp_replace(html, r"<[^>]+>", "")


#: Characters that LaTeX source writes differently.
LATEX = {
    "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}",
    "\u201c": "``", "\u201d": "''", "\u2018": "`", "\u2019": "'", "\u2013": "--", "\u2014": "---", "\u00a0": "~",
}


def latex_escaped(s: Column) -> Column:
    """Plain text as LaTeX source, each character once."""
    table = F.create_map(*[F.lit(x) for kv in LATEX.items() for x in kv])
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")


def change_markdown(old: Column, new: Column) -> Column:
    """What a change does, as Markdown."""
    o, n = strip(old), strip(new)
    return (
        F.when((o == "") & (n == ""), F.lit("(see reason)"))
        .when(o == "", F.concat(F.lit("insert **"), n, F.lit("**")))
        .when(n == "", F.concat(F.lit("delete ~~"), o, F.lit("~~")))
        .otherwise(F.concat(F.lit("~~"), o, F.lit("~~ → **"), n, F.lit("**")))
    )


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", "")


def file_suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def slug(s: Column) -> Column:
    """Lower-case ASCII letters and digits with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def first_sentence(s: Column) -> Column:
    return F.split(squeeze(s), r"(?<=[.!?])\s", 2)[0]


def is_iso_date(s: Column) -> Column:
    """A date, or a date and time, that also exists in the calendar."""
    return s.rlike(ISO_DATE) & F.try_to_timestamp(s).isNotNull()


def font_is_bold(font: Column) -> Column:
    return F.element_at(F.split(F.lower(font), r"\+"), -1).rlike("bold|black|heavy|semibold|cmbx|-bd|demi")


def font_is_italic(font: Column) -> Column:
    return F.element_at(F.split(F.lower(font), r"\+"), -1).rlike("italic|oblique|cmti|cmmi|-it|slant")
