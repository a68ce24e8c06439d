"""LaTeX projects: which file is the main one, what is cleaned before conversion, images, declared figures, HTML."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.edits import balanced_end

PREFERRED = ("main", "ms", "manuscript", "paper")
EXTENSIONS = ("", ".pdf", ".png", ".jpg", ".jpeg", ".eps", ".PDF", ".PNG", ".JPG")


def main_files(files: DataFrame) -> DataFrame:
    """Each project's main file. ``files``: ``doc_id, path, text``; preferred names first, then the largest."""
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.tex$", 1))
    able = files.where(F.contains("text", F.lit("\\documentclass")) & F.contains("text", F.lit("\\begin{document}")))
    rank = F.struct((~stem.isin(*PREFERRED)).cast("int").alias("a"), (-F.length("text")).alias("b"), F.col("path").alias("c"))
    return able.groupBy("doc_id").agg(F.min_by("path", rank).alias("path"))


def unstarred(text: Column) -> Column:
    """Floats across columns as plain ones."""
    return F.regexp_replace(text, r"\\(begin|end)\{(figure|table)\*\}", r"\\$1{$2}")


def graphics_paths(text: Column) -> Column:
    inner = F.regexp_extract(text, r"\\graphicspath\{((?:\{[^}]*\})+)\}", 1)
    return F.concat(F.array(F.lit("")), F.regexp_extract_all(inner, F.lit(r"\{([^}]*)\}"), F.lit(1)))


def resolve_images(wanted: DataFrame, files: DataFrame, key: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The first file that a name stands for: itself, with an extension, or the first by path, in any folder, whose own name begins with
    that of ``name``. Where both tables have ``doc_id``, files are those of the name's own project.

    Names meet the fronts of files' names, of which a file has no more than its name has characters."""
    own = ["doc_id"] if "doc_id" in wanted.columns and "doc_id" in files.columns and key != "doc_id" else []
    tries = wanted.select(key, *own, "name", F.posexplode(F.transform(F.array(*[F.lit(e) for e in extensions]), lambda e: F.concat(F.trim("name"), e))).alias("pos", "path"))
    known = files.select(*own, "path").distinct()
    exact = tries.join(known, [*own, "path"]).groupBy(key, *own).agg(F.min_by("path", "pos").alias("path"))
    last = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    rest = wanted.select(key, *own, last(F.trim("name")).alias("front")).where("front <> ''").join(exact, [key, *own], "left_anti")
    base = last("path")
    fronts = known.where(base != "").select(*own, "path", F.explode(F.transform(F.sequence(F.lit(1), F.length(base)), lambda n: F.substring(base, F.lit(1), n))).alias("front"))
    guessed = rest.join(fronts, [*own, "front"]).groupBy(key, *own).agg(F.min("path").alias("path"))
    return exact.unionByName(guessed)


def declared_figures(text: Column) -> Column:
    """How many figures a source declares: one for each float with an image, or one for each caption of its own inside it, and
    one for each captioned image outside of floats. Sideways and wrapped floats count too; comments do not."""
    clean = F.regexp_replace(text, r"(?m)(?<!\\)%.*$", "")
    float_ = r"(?s)\\begin\{(figure\*?|sidewaysfigure\*?|wrapfigure)\}.*?\\end\{\1\}"
    floats = F.regexp_extract_all(clean, F.lit(float_), F.lit(0))
    own = lambda s: F.size(F.regexp_extract_all(s, F.lit(r"(\\captionof\{figure\})"), F.lit(1)))
    inside = F.aggregate(floats, F.lit(0), lambda n, f: n + F.when(f.rlike(r"\\includegraphics"), F.greatest(own(f), F.lit(1))).otherwise(0))
    return (inside + own(F.regexp_replace(clean, float_, ""))).cast("long")


def _argument(s: str, at: int) -> tuple[str, int]:
    """The group that begins at ``at``, without braces, and where it ends."""
    stop = balanced_end(s, at)
    return s[at + 1 : stop - 1], stop


def _each_command(s: str, name: str, arguments: int, rewrite) -> str:
    """``s`` with every ``\\name{..}..`` rewritten from its arguments; optional ones in brackets are skipped."""
    out, at = [], 0
    for m in re.finditer(rf"\\{name}\*?(?![A-Za-z])", s):
        if m.start() < at:
            continue
        i, found = m.end(), []
        while len(found) < arguments:
            i += len(s[i:]) - len(s[i:].lstrip())
            if s[i : i + 1] == "[":
                i = balanced_end(s, i, "[]")
            elif s[i : i + 1] == "{":
                inner, i = _argument(s, i)
                found.append(inner)
            else:
                break
        if len(found) == arguments:
            out += [s[at : m.start()], rewrite(*found)]
            at = i
    return "".join([*out, s[at:]])


def simplified_tables(s: str | None) -> str | None:
    """Tables in the plain form that converters read: column letters only, cells of several columns as one and empty ones, stacked
    cells as one line, no scaling boxes, no colours, one head for tables over several pages."""
    if s is None:
        return None

    def columns(spec: str) -> str:
        for mark in ("@", "!", ">", "<"):
            while (i := spec.find(mark + "{")) >= 0:
                spec = spec[:i] + spec[balanced_end(spec, i + 1) :]
        while m := re.search(r"\*\{(\d+)\}\{", spec):
            inner, stop = _argument(spec, m.end() - 1)
            spec = spec[: m.start()] + inner * int(m[1]) + spec[stop:]
        while m := re.search(r"[pmbXS]\{", spec):
            spec = spec[: m.start()] + "l" + spec[balanced_end(spec, m.end() - 1) :]
        return re.sub(r"[^lcr]", "", spec.replace("X", "l").replace("S", "c")) or "l"

    def wide(n: str, _: str, text: str) -> str:
        return text + " &" * (int(n) - 1 if n.strip().isdigit() else 0)

    s = _each_command(s, "resizebox", 3, lambda _a, _b, t: t)
    s = _each_command(s, "scalebox", 2, lambda _a, t: t)
    s = _each_command(s, "multicolumn", 3, wide)
    s = _each_command(s, "multirow", 3, lambda _n, _w, t: t)
    s = _each_command(s, "shortstack", 1, lambda t: re.sub(r"\s*\\\\\s*", " ", t))
    s = _each_command(s, "makecell", 1, lambda t: re.sub(r"\s*\\\\\s*", " ", t))
    for name in ("rowcolor", "cellcolor", "columncolor"):
        s = _each_command(s, name, 1, lambda _: "")
    for env, extra in (("tabularx", 1), ("tabular*", 1), ("tabular", 0), ("longtable", 0), ("array", 0)):
        at = 0
        while (i := s.find(f"\\begin{{{env}}}", at)) >= 0:
            j = i + len(env) + 8
            if s[j : j + 1] == "[":
                j = balanced_end(s, j, "[]")
            for _ in range(extra):
                j = balanced_end(s, j)
            if s[j : j + 1] != "{":
                at = j
                continue
            spec, stop = _argument(s, j)
            head = f"\\begin{{{'longtable' if env == 'longtable' else 'tabular' if env != 'array' else 'array'}}}{{{columns(spec)}}}"
            s = s[:i] + head + s[stop:]
            at = i + len(head)
    s = re.sub(r"\\end\{tabular[x*]\}", r"\\end{tabular}", s)
    s = re.sub(r"(?s)\\endfirsthead.*?\\endhead", r"\\endhead", s)
    return re.sub(r"(?s)\\endfoot.*?\\endlastfoot|\\endlastfoot|\\endfoot", "", s)


def table_rows(s: str) -> list[list[str]]:
    """Cells of the first table of a simplified source."""
    found = re.search(r"(?s)\\begin\{(tabular|longtable)\}\{[lcr]*\}(.*?)\\end\{\1\}", s)
    body = re.sub(r"(?<!\\)%[^\n]*", "", found[2]) if found else ""
    body = _each_command(body, "caption", 1, lambda _: "")
    body = re.sub(r"\\(top|mid|bottom|c|h)(rule|line)\b(\([lr]*\))?(\{[^}]*\})?(\[[^\]]*\])?|\\end(first)?head|\\label\{[^}]*\}", " ", body)
    rows = [re.split(r"(?<!\\)&", line) for line in re.split(r"\\\\(?:\[[^\]]*\])?|\\tabularnewline", body)]
    return [[re.sub(r"\s+", " ", re.sub(r"\\(?:textbf|textit|emph)\{([^}]*)\}", r"\1", c)).strip() for c in r] for r in rows if "".join(r).strip()]


def to_html(s: str) -> str:
    """The parts of a LaTeX document that blocks are made of, as HTML: title, headings, paragraphs, floats, tables, lists, references."""
    s = re.sub(r"(?<!\\)%[^\n]*", "", simplified_tables(s) or "")
    title = re.search(r"\\title\s*\{", s)
    out = [f"<header><h1 class='title'>{_inline(_argument(s, title.end() - 1)[0])}</h1></header>"] if title else []
    found = re.search(r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|$)", s)
    body = found[1] if found else s
    body = re.sub(r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", r"\\section{Abstract}\n\n\1\n\n", body)
    body = re.sub(r"\\(maketitle|tableofcontents|centering|clearpage|newpage)\b", "", body)
    floats = r"\\begin\{(figure|table)\*?\}(?:\[[^\]]*\])?(.*?)\\end\{\1\*?\}|\\begin\{(longtable|tabular)\}.*?\\end\{\3\}|\\begin\{(equation|align)\*?\}.*?\\end\{\4\*?\}|\\begin\{thebibliography\}.*?\\end\{thebibliography\}"
    at = 0
    for m in re.finditer(f"(?s){floats}", body):
        out += _paragraphs(body[at : m.start()])
        at = m.end()
        caption = re.search(r"\\caption(?:\[[^\]]*\])?\s*\{", m[0])
        text = _inline(_argument(m[0], caption.end() - 1)[0]) if caption else ""
        images = re.findall(r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}", m[0])
        if m[1] == "figure" and images:
            out.append("<figure>" + "".join(f"<img src='{i}'>" for i in images) + f"<figcaption>{text}</figcaption></figure>")
        elif m[1] == "table" or m[3]:
            rows = "".join("<tr>" + "".join(f"<td>{_inline(c)}</td>" for c in r) + "</tr>" for r in table_rows(m[0]))
            out.append(f"<table><caption>{text}</caption>{rows}</table>")
        elif m[0].startswith("\\begin{thebib"):
            items = re.split(r"\\bibitem(?:\[[^\]]*\])?\{[^}]*\}", m[0])[1:]
            out.append("<div id='refs'>" + "".join(f"<div class='csl-entry' id='ref-{n}'>{_inline(i)}</div>" for n, i in enumerate(items, 1)) + "</div>")
    return "".join(out + _paragraphs(body[at:]))


def _paragraphs(s: str) -> list[str]:
    out = []
    for part in re.split(r"(\\(?:sub)*section\*?\s*\{[^}]*\})|\n\s*\n", s):
        if not part or not part.strip():
            continue
        if m := re.match(r"\\((?:sub)*)section\*?\s*\{([^}]*)\}", part):
            level = 2 + m[1].count("sub")
            out.append(f"<h{level}>{_inline(m[2])}</h{level}>")
        elif text := _inline(part).strip():
            out.append(f"<p>{text}</p>")
    return out


def _inline(s: str) -> str:
    from html import escape

    s = escape(s, quote=False)
    for name, tag in (("textbf", "strong"), ("textit", "em"), ("emph", "em"), ("textsuperscript", "sup"), ("textsubscript", "sub")):
        s = _each_command(s, name, 1, lambda t, tag=tag: f"<{tag}>{t}</{tag}>")
    s = re.sub(r"\\(label|cite[tp]?|ref|Cref|cref)\s*\{[^}]*\}|\\bibliography(style)?\{[^}]*\}", "", s)
    s = s.replace("~", " ").replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”")
    s = re.sub(r"\\([%$#_{}])|\\(&amp;)", lambda m: m[1] or m[2], s)
    s = re.sub(r"\\[A-Za-z]+\*?(\{\})?", "", s)
    return re.sub(r"\s+", " ", s.replace("{", "").replace("}", "")).strip()


def bib_entries(s: str) -> list[str]:
    """Entries of a bibliography file as text: authors, title, source, year."""
    out = []
    for m in re.finditer(r"@(\w+)\s*\{", s):
        inner, _ = _argument(s, m.end() - 1)
        fields = {k.lower(): re.sub(r"[{}\"]", "", v).strip() for k, v in re.findall(r"(\w+)\s*=\s*(\{(?:[^{}]|\{[^{}]*\})*\}|\"[^\"]*\"|\d+)", inner)}
        if m[1].lower() not in ("comment", "string", "preamble"):
            out.append(". ".join(fields[k] for k in ("author", "title", "journal", "booktitle", "year") if fields.get(k)))
    return out


def projects_to_html(files: DataFrame) -> DataFrame:
    """``doc_id, html`` of each project (``doc_id, path, text``): its main file, with its bibliography files as references."""
    main = main_files(files).withColumnRenamed("path", "main")
    tex = files.join(main, "doc_id").where(F.col("path") == F.col("main")).select("doc_id", F.col("text").alias("tex"))
    bib = files.where(F.col("path").endswith(".bib")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n").alias("bib"))

    @F.pandas_udf("string")
    def html(tex, bib):
        def one(t, b):
            refs = "".join(f"<div class='csl-entry' id='ref-{n}'>{_inline(e)}</div>" for n, e in enumerate(bib_entries(b or ""), 1))
            return to_html(t) + (f"<div id='refs'>{refs}</div>" if refs else "")

        return pd.Series([one(t, b) for t, b in zip(tex, bib, strict=True)], dtype=object)

    return tex.join(bib, "doc_id", "left").select("doc_id", html("tex", "bib").alias("html"))
