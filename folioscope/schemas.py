"""Schemas of the tables that the operators exchange. Every field is nullable; nothing is inferred."""

BLOCKS = (
    "doc_id BIGINT, ord INT, block_id STRING, kind STRING, html STRING, caption STRING, label STRING, "
    "fig STRING, equation BOOLEAN, rows ARRAY<ARRAY<STRING>>"
)
TEXTS = "doc_id BIGINT, ord INT, block_id STRING, text STRING"
FIGURES = "doc_id BIGINT, fig_id STRING, media STRING, label STRING, w INT, h INT, page INT"
COMMENTS = "doc_id BIGINT, seq INT, author STRING, text STRING, exact STRING, block_id STRING"
DRAFTS = (
    "doc_id BIGINT, draft_pos INT, cat STRING, kind STRING, exact STRING, block STRING, occ INT, fig STRING, "
    "box ARRAY<DOUBLE>, comment STRING, suggestion STRING, author STRING, "
    "replies ARRAY<STRUCT<text:STRING,author:STRING,date:STRING>>"
)
NOTES = (
    "doc_id BIGINT, id STRING, seq INT, kind STRING, cat STRING, block STRING, exact STRING, occ INT, "
    "x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, comment STRING, suggestion STRING, status STRING, "
    "author STRING, authorId STRING, authorName STRING, byOwner BOOLEAN, createdAt STRING, updatedAt STRING"
)
REPLIES = (
    "doc_id BIGINT, id STRING, note STRING, text STRING, author STRING, authorId STRING, authorName STRING, "
    "byOwner BOOLEAN, createdAt STRING, updatedAt STRING, editedAt STRING"
)
EDITS = (
    "doc_id BIGINT, block STRING, html STRING, text STRING, baseText STRING, author STRING, authorId STRING, "
    "authorName STRING, addresses ARRAY<STRING>, createdAt STRING, updatedAt STRING, "
    "history ARRAY<STRUCT<html:STRING,text:STRING,author:STRING,updatedAt:STRING>>"
)
HUNKS = (
    "doc_id BIGINT, block STRING, hunk_no INT, cell STRING, old STRING, new STRING, left ARRAY<STRING>, right ARRAY<STRING>"
)
WORDS = (
    "doc_id BIGINT, page INT, word_no INT, text STRING, x0 DOUBLE, x1 DOUBLE, top DOUBLE, bottom DOUBLE, "
    "size DOUBLE, fontname STRING, cid BOOLEAN"
)
PIXELS = "fig_id STRING, y INT, x INT, g INT"

#: The categories of notes with their names, and the fields that a clean export keeps.
CATEGORIES = {
    "blocker": "Fix before sharing",
    "numbers": "Numbers don't match",
    "stats": "Methods and stats",
    "figures": "Figures",
    "framing": "Accuracy and framing",
    "refs": "References",
    "typos": "Typos and wording",
    "coauthor": "Co-author comments",
    "mine": "My notes",
}
NOTE_FIELDS = ("id", "kind", "cat", "block", "exact", "occ", "x", "y", "w", "h", "comment", "suggestion", "status", "author", "authorId", "byOwner", "seq")
REPLY_FIELDS = ("id", "note", "text", "author", "authorId", "byOwner", "createdAt", "updatedAt", "editedAt")
