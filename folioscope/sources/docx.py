"""Word files: text as HTML, captions in text boxes, comments with the text they are about.

A file is a zip archive of XML parts, so one Arrow-batched function turns each file's bytes into rows; what follows is
relational. A file that cannot be read gives one row with an error.
"""

from __future__ import annotations

import io
import re
import zipfile
from html import escape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_CAPTION = re.compile(T.CAPTION.replace("(?i)", "", 1), re.I)
SHORT_ANCHOR, CONTEXT = 20, 90
PARTS = "doc_id BIGINT, html STRING, captions ARRAY<STRING>, comments ARRAY<STRUCT<seq:INT,author:STRING,text:STRING,exact:STRING>>, media ARRAY<STRING>, error STRING"


def _run_html(run) -> str:
    text = escape("".join("\t" if t.tag == _W + "tab" else "\n" if t.tag == _W + "br" else t.text or "" for t in run if t.tag in (_W + "t", _W + "tab", _W + "br")), quote=False)
    style = run.find(_W + "rPr")
    if style is None or not text:
        return text
    lift = style.find(_W + "vertAlign")
    on = lambda n: (e := style.find(_W + n)) is not None and e.get(_W + "val") not in ("0", "false")
    for tag, yes in (("sup", lift is not None and lift.get(_W + "val") == "superscript"), ("sub", lift is not None and lift.get(_W + "val") == "subscript"), ("strong", on("b")), ("em", on("i"))):
        if yes:
            text = f"<{tag}>{text}</{tag}>"
    return text


def _paragraph_html(p) -> str:
    """Runs of a paragraph, without those of text boxes in it; neighbours in the same style are joined."""
    boxed = {r for box in p.iter(_W + "txbxContent") for r in box.iter(_W + "r")}
    html = "".join(_run_html(r) for r in p.iter(_W + "r") if r not in boxed)
    return re.sub(r"</(strong|em|sup|sub)><\1>", "", html)


def _plain(p) -> str:
    return "".join(t.text or "" for t in p.iter(_W + "t"))


def _body_html(body, media: dict[str, str]) -> str:
    out = []
    for el in body:
        if el.tag == _W + "tbl":
            rows = ("".join(f"<td>{' '.join(_paragraph_html(p) for p in tc.iter(_W + 'p'))}</td>" for tc in tr.iter(_W + "tc")) for tr in el.iter(_W + "tr"))
            out.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
        elif el.tag == _W + "p":
            style = el.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(_W + "val") or "").lower() if style is not None else ""
            images = [media.get(b.get(_R + "embed"), "") for b in el.iter(_A + "blip")]
            text = _paragraph_html(el)
            out += [f"<p><img src='{escape(i)}'></p>" for i in images]
            if not text.strip():
                continue
            if name == "title":
                out.append(f"<header><h1>{text}</h1></header>")
            elif m := re.match(r"heading(\d)", name):
                out.append(f"<h{m[1]}>{text}</h{m[1]}>")
            else:
                out.append(f"<p>{text}</p>")
    return "".join(out)


def _captions(root) -> list[str]:
    """Captions in text boxes, each text once, in the order in which they are first met."""
    seen: dict[str, str] = {}
    for box in root.iter(_W + "txbxContent"):
        for p in box.iter(_W + "p"):
            text = _plain(p).strip()
            if _CAPTION.match(text):
                seen.setdefault(text, "".join(_run_html(r) for r in p.iter(_W + "r")))
    return [re.sub(r"</(strong|em|sup|sub)><\1>", "", h) for h in seen.values()]


def _comments(root, said: dict[str, tuple[str, str]]) -> list[dict]:
    """Comments with the text between their range's marks. A short anchor is led by words of its paragraph before it."""
    open_: dict[str, list[str]] = {}
    lead: dict[str, str] = {}
    before = ""
    for el in root.iter():
        if el.tag == _W + "p":
            before = ""
        elif el.tag == _W + "commentRangeStart":
            open_[el.get(_W + "id")], lead[el.get(_W + "id")] = [], before
        elif el.tag == _W + "commentRangeEnd":
            n = el.get(_W + "id")
            if n in open_:
                lead[n] = lead.get(n, "")
                said[n] = (*said.get(n, ("", ""))[:2], "".join(open_.pop(n)))
        elif el.tag == _W + "t" and el.text:
            for parts in open_.values():
                parts.append(el.text)
            before += el.text
    out = []
    for seq, (n, row) in enumerate(said.items()):
        exact = row[2].strip() if len(row) > 2 else ""
        if exact and len(exact) < SHORT_ANCHOR and lead.get(n, "").strip():
            tail = lead[n][-CONTEXT:]
            if len(lead[n]) > CONTEXT and " " in tail:
                tail = tail.split(" ", 1)[1]
            exact = (tail + row[2]).strip()
        out.append({"seq": seq, "author": row[0], "text": row[1], "exact": exact})
    return out


def read_docx(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        root = ElementTree.fromstring(z.read("word/document.xml"))
        rels = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else ()
        media = {r.get("Id"): r.get("Target", "") for r in rels if "media/" in r.get("Target", "")}
        said: dict = {}
        if "word/comments.xml" in names:
            for c in ElementTree.fromstring(z.read("word/comments.xml")).iter(_W + "comment"):
                said[c.get(_W + "id")] = (c.get(_W + "author") or "", "\n".join(_plain(p) for p in c.iter(_W + "p")))
        body = root.find(_W + "body")
        return {"html": _body_html(body if body is not None else [], media), "captions": _captions(root), "comments": _comments(root, said), "media": sorted(n for n in names if n.startswith("word/media/"))}


def parse_docx(files: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """``doc_id, html, captions, comments, media, error`` of each file."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                row = dict.fromkeys(("html", "captions", "comments", "media", "error"))
                try:
                    row |= read_docx(content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as e:
                    row["error"] = f"not a readable Word file: {e}"
                rows.append({"doc_id": doc, **row})
            yield pd.DataFrame(rows, columns=["doc_id", "html", "captions", "comments", "media", "error"])

    return files.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{content_col}` as binary) content").mapInPandas(run, PARTS)


def comments_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.explode("comments").alias("c")).select("doc_id", "c.*")


def caption_queue(parsed: DataFrame, kind: str = "figure") -> DataFrame:
    """Captions in text boxes as a queue for figures, or tables, without one: ``doc_id, n, caption``."""
    table = lambda c: T.without_tags(c).rlike(T.TABLE_CAPTION)
    own = F.filter("captions", table if kind == "table" else lambda c: ~table(c))
    return parsed.select("doc_id", F.posexplode(own).alias("n", "caption")).withColumn("n", F.col("n") + 1)


def word_blocks(parsed: DataFrame) -> DataFrame:
    """Blocks of Word files; figures and tables without a caption take those in text boxes, first come first served."""
    raw = B.parse_blocks(parsed.select("doc_id", "html"))
    for kind in ("figure", "table"):
        raw = B.paired_captions(raw, kind, caption_queue(parsed, kind))
    return B.finished(raw)
