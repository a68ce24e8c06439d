"""Review notes and their replies: ordering, numbering, signing, threads, clean exports and report payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nth_offset, squeeze, strip, without_tags
from ..schemas import CATEGORIES, NOTE_FIELDS, REPLY_FIELDS
from .tables import tasks_for

UNKNOWN_BLOCK = 1_000_000


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _set(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def open_notes(notes: DataFrame) -> DataFrame:
    return notes.where(F.coalesce("status", F.lit("open")) == "open")


def without_dismissed(notes: DataFrame, include: bool = False) -> DataFrame:
    return notes if include else notes.where(F.coalesce("status", F.lit("")) != "dismissed")


def threads(replies: DataFrame, notes: DataFrame) -> DataFrame:
    """Replies whose note is among ``notes``."""
    return replies.join(notes.select("doc_id", F.col("id").alias("note")), ["doc_id", "note"], "left_semi")


def sections(blocks: DataFrame) -> DataFrame:
    """Adds ``section``, ``sub`` and ``in_references`` to blocks: the headings in force, a block's own label, and whether it
    stands in a list of references. A document's blocks are one window, bounded by the document."""
    ahead = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    h2 = F.last(F.when(F.col("kind") == "h2", F.col("html")), ignorenulls=True).over(ahead)
    out = blocks.withColumn("section", F.coalesce(h2, F.lit("Front matter")))
    out = out.withColumn("__n2", F.count(F.when(F.col("kind") == "h2", 1)).over(ahead))
    under = Window.partitionBy("doc_id", "__n2").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    h3 = F.coalesce(F.last(F.when(F.col("kind") == "h3", F.col("html")), ignorenulls=True).over(under), F.lit(""))
    sub = (
        F.when(F.col("kind").isin("figure", "table"), F.col("label"))
        .when(F.col("kind") == "ref", F.concat(F.lit("Reference "), F.substr("block_id", F.lit(5))))
        .when(F.col("kind") == "title", F.lit("Title"))
        .otherwise(h3)
    )
    from ..functions.text import REFERENCES

    heads = F.when(F.col("html").rlike(REFERENCES) & F.col("kind").isin("h2", "h3"), True).when(F.col("kind") == "h2", False)
    return out.withColumn("sub", sub).withColumn("in_references", F.coalesce(F.last(heads, ignorenulls=True).over(ahead), F.lit(False))).drop("__n2")


def positions(notes: DataFrame, blocks: DataFrame, texts: DataFrame, seeds: bool = False) -> DataFrame:
    """Adds ``pos``, a struct that orders notes as the manuscript does: general notes, then blocks; boxes before quotes."""
    order = blocks.select("doc_id", F.col("block_id").alias("block"), F.col("ord").alias("__ord"))
    text = texts.select("doc_id", F.col("block_id").alias("block"), F.col("text").alias("__text"))
    out = notes.join(order, ["doc_id", "block"], "left").join(text, ["doc_id", "block"], "left")
    at = nth_offset(_empty("__text"), _empty("exact"), F.coalesce("occ", F.lit(0)))
    a = F.when(F.col("kind") == "note", -1).otherwise(F.coalesce("__ord", F.lit(UNKNOWN_BLOCK)))
    general = F.lit(0) if seeds else F.coalesce("seq", F.lit(0))
    b = F.when(F.col("kind") == "note", general).when(F.col("kind") == "box", -1).otherwise(0)
    c = F.when(F.col("kind") == "note", 0.0).when(F.col("kind") == "box", F.col("y")).otherwise(at.cast("double"))
    return out.withColumn("pos", F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), c.alias("c"))).drop("__ord", "__text")


def numbered(notes: DataFrame, tie: str = "draft_pos") -> DataFrame:
    """Adds ``seq`` and ``id`` in manuscript order, within each document."""
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", tie))
    return notes.withColumn("seq", seq).withColumn("id", F.format_string("r%03d", F.col("seq")))


def reply_rows(notes: DataFrame, base: str) -> DataFrame:
    """Replies of drafts with ids and times: their own date, else ``base``, and as many seconds later as their number says."""
    rows = notes.select("doc_id", F.col("id").alias("note"), F.posexplode("replies").alias("k", "r"))
    when = F.coalesce(F.try_to_timestamp(F.nullif(F.col("r.date"), F.lit(""))), F.to_timestamp(F.lit(base)))
    stamp = F.date_format(when + F.make_dt_interval(secs=F.col("k") + 1), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(
        "doc_id",
        F.concat("note", F.lit("-c"), (F.col("k") + 1).cast("string")).alias("id"),
        "note",
        strip(F.col("r.text")).alias("text"),
        F.coalesce("r.author", F.lit("")).alias("author"),
        F.when(F.coalesce("r.author", F.lit("")) == "", True).alias("byOwner"),
        stamp.alias("createdAt"),
        stamp.alias("updatedAt"),
    )


def batches(writes: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """Adds ``batch_no`` from 1, of at most ``size`` writes, within each document in the given order."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return writes.withColumn("batch_no", (F.floor((n - 1) / size) + 1).cast("int"))


def union_writes(notes: DataFrame, replies: DataFrame, collection: str = "annotations") -> DataFrame:
    """Set operations for notes, then for replies, with the rank and position that order them."""
    a = notes.select("doc_id", F.lit(0).alias("rank"), F.col("seq").cast("long").alias("n"), F.lit(0).alias("k"), F.lit("set").alias("op"), F.lit(collection).alias("collection"), F.col("id").alias("key"), F.to_json(F.struct(*notes.columns)).alias("data"))
    b = replies.select("doc_id", F.lit(1).alias("rank"), F.regexp_extract("note", r"(\d+)$", 1).cast("long").alias("n"), F.regexp_extract("id", r"-c(\d+)$", 1).cast("int").alias("k"), F.lit("set").alias("op"), F.lit("replies").alias("collection"), F.col("id").alias("key"), F.to_json(F.struct(*replies.columns)).alias("data"))
    return a.unionByName(b)


def union_comments(drafts: DataFrame, comments: DataFrame) -> DataFrame:
    """Drafts and, after them, imported comments; a comment without a block becomes a general note that quotes its text."""
    last = drafts.groupBy("doc_id").agg((F.max("draft_pos") + 1).alias("__from"))
    anchored = F.col("block_id").isNotNull()
    about = F.concat("text", F.lit(" (on: “"), F.left("exact", F.lit(120)), F.lit("”)"))
    rows = comments.join(last, "doc_id", "left").select(
        "doc_id",
        (F.coalesce("__from", F.lit(0)) + F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).cast("int").alias("draft_pos"),
        F.lit("coauthor").alias("cat"),
        F.when(~anchored, "note").alias("kind"),
        F.when(anchored, F.col("exact")).alias("exact"),
        F.col("block_id").alias("block"),
        F.when(anchored, F.col("text")).otherwise(about).alias("comment"),
        "author",
    )
    return drafts.unionByName(rows, allowMissingColumns=True)


def _lookup(names: dict[str, str], key: Column) -> Column:
    if not names:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def report_signature(names: dict[str, str]) -> Column:
    """The label in a report: ``*``, a mapping of the signature, the account's name, ``@owner``, or what the note is."""
    author = _empty("author")
    if "*" in names:
        label = F.lit(names["*"])
    else:
        mapped = _lookup({k: v for k, v in names.items()}, author)
        account = F.coalesce(F.nullif(_empty("authorName"), F.lit("")), F.when(_set("byOwner"), F.lit(names.get("@owner"))), F.lit(""))
        label = F.when(mapped.isNotNull() & ((author != "") | ~_set("byOwner")), mapped).when(author == "", account).otherwise(author)
    return F.when(label == "", F.when(_set("byOwner"), "Page owner").otherwise("Reviewer")).otherwise(label)


def clean_signature(names: dict[str, str]) -> Column:
    """The signature in a clean export, which knows no ``*``; null stays null."""
    author = _empty("author")
    mapped = _lookup(names, author)
    owner = F.lit(names["@owner"]) if "@owner" in names else F.col("author")
    return F.when(mapped.isNotNull() & ((author != "") | ~_set("byOwner")), mapped).when((author == "") & _set("byOwner"), owner).otherwise(F.col("author"))


def edit_signature(names: dict[str, str]) -> Column:
    """The signature of an edit: ``*``, a mapping, or the account's name; no label where there is none."""
    if "*" in names:
        return F.lit(names["*"])
    return F.coalesce(_lookup(names, _empty("author")), F.nullif(_empty("author"), F.lit("")), _empty("authorName"))


def byline() -> Column:
    """Who a reply in a clean export is by."""
    return F.coalesce(F.nullif(_empty("author"), F.lit("")), F.nullif(_empty("authorName"), F.lit("")), F.when(_set("byOwner"), F.lit("page owner")), F.lit(""))


def relabel(notes: DataFrame, old: str, new: str) -> DataFrame:
    """Update operations: the notes signed ``old`` are signed ``new``. An empty ``old`` means the owner's unsigned notes only."""
    hit = _empty("author") == old
    if not old:
        hit = hit & (_empty("authorId") == "") & _set("byOwner")
    owner = F.when((F.lit(new) == "") & (_empty("authorId") == ""), True)
    return notes.where(hit).select("doc_id", "id", F.lit("update").alias("op"), F.to_json(F.struct(F.lit(new).alias("author"), owner.alias("byOwner"))).alias("data"))


def delete_status(notes: DataFrame, status: str) -> DataFrame:
    return notes.where(F.col("status") == status).select("doc_id", "id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("data"))


def pinned(writes: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds ``if_version`` from a listing; null where the listing has none."""
    return writes.join(versions.select("id", F.col("version").alias("if_version")), "id", "left")


def with_replies(notes: DataFrame, replies: DataFrame) -> DataFrame:
    """Adds ``replies``, the thread in order of time and id; a note without replies has an empty one.

    Replies of one note are one row, as they are in the export; a thread is bounded by what people write."""
    fields = [c for c in replies.columns if c not in ("doc_id", "note", "createdAt", "id")]
    nested = replies.groupBy("doc_id", F.col("note").alias("id")).agg(F.sort_array(F.collect_list(F.struct(_empty("createdAt").alias("createdAt"), "id", *fields))).alias("replies"))
    none = F.array().cast(nested.schema["replies"].dataType)
    return notes.join(nested, ["doc_id", "id"], "left").withColumn("replies", F.coalesce("replies", none))


def latest_replies(replies: DataFrame, n: int = 2) -> DataFrame:
    """The last ``n`` replies of each thread, with ``earlier``, the number not shown."""
    whole = Window.partitionBy("doc_id", "note")
    rank = F.row_number().over(whole.orderBy(F.desc("createdAt"), F.desc("id")))
    return replies.withColumn("__r", rank).withColumn("earlier", F.greatest(F.count("*").over(whole) - n, F.lit(0))).where(F.col("__r") <= n).drop("__r")


def category_counts(notes: DataFrame) -> DataFrame:
    """Notes of each category in each document, most first, then as first seen."""
    counted = notes.groupBy("doc_id", "cat").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    name = _lookup(CATEGORIES, F.col("cat"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counted.select("doc_id", "cat", F.coalesce(name, F.col("cat")).alias("name"), "n", place.alias("place"))


def clean(notes: DataFrame, replies: DataFrame, blocks: DataFrame, texts: DataFrame, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Open notes in manuscript order with their sections, and their replies, signed by ``names``."""
    names = names or {}
    kept = positions(open_notes(notes), blocks, texts)
    place = sections(blocks).select("doc_id", F.col("block_id").alias("block"), "section", "sub")
    kept = kept.join(place, ["doc_id", "block"], "left")
    kept = kept.withColumn("section", F.when(F.col("kind") == "note", "General").otherwise(F.coalesce("section", F.lit("Other"))))
    kept = kept.withColumn("author", clean_signature(names)).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "id")))
    own = threads(replies, kept).withColumn("author", clean_signature(names)).withColumn("by", byline())
    return kept, own


def export_json(notes: DataFrame, replies: DataFrame) -> DataFrame:
    """One row a document with the export envelope as JSON; absent values are left out."""
    fields = [c for c in NOTE_FIELDS if c in notes.columns]
    rfields = [c for c in REPLY_FIELDS if c in replies.columns]
    a = notes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", F.struct(*fields).alias("v")))).alias("a"))
    order = notes.select("doc_id", F.col("id").alias("note"), "place")
    b = replies.join(order, ["doc_id", "note"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", _empty("createdAt").alias("t"), F.struct(*rfields).alias("v")))).alias("r"))
    envelope = F.struct(
        F.lit("review-notes").alias("format"), F.lit(3).alias("version"), F.transform("a", lambda x: x["v"]).alias("annotations"), F.transform("r", lambda x: x["v"]).alias("replies")
    )
    return a.join(b, "doc_id", "left").select("doc_id", F.to_json(envelope).alias("json"))


def export_markdown(notes: DataFrame, replies: DataFrame) -> DataFrame:
    """One row a document with its open notes as Markdown; a section's heading stands where it differs from the note's before."""
    tidy = lambda c: F.trim(F.regexp_replace(_empty(c), "\n", " "))
    day = F.left(_empty("createdAt"), F.lit(10))
    said = F.concat(F.lit("> **"), F.coalesce(F.nullif(F.col("by"), F.lit("")), F.lit("unsigned")), F.lit("**"), F.when(day != "", F.concat(F.lit(" ("), day, F.lit(")"))).otherwise(""), F.lit(": "), tidy("text"), F.lit("  "))
    lines = replies.groupBy("doc_id", F.col("note").alias("id")).agg(F.sort_array(F.collect_list(F.struct(_empty("createdAt").alias("t"), F.col("id").alias("i"), said.alias("line")))).alias("lines"))
    rows = notes.join(lines, ["doc_id", "id"], "left")
    before = F.lag("section").over(Window.partitionBy("doc_id").orderBy("place"))
    head = F.when(before.isNull() | (before != F.col("section")), F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"))).otherwise("")
    where = F.when(F.col("kind") == "note", "").otherwise(_empty("sub"))
    name = F.coalesce(_lookup(CATEGORIES, F.col("cat")), F.col("cat"))
    first = F.concat(F.lit("**"), F.col("place").cast("string"), F.lit(". "), name, F.lit("**"), F.when((where != "") & (where != F.col("section")), F.concat(F.lit(" ("), where, F.lit(")"))).otherwise(""))
    first = F.concat(first, F.when(F.col("kind") == "text", F.concat(F.lit(": “"), tidy("exact"), F.lit("”"))).when(F.col("kind") == "box", F.concat(F.lit(": box on "), F.coalesce(F.nullif(where, F.lit("")), F.col("block")))).otherwise(""), F.lit("  "))
    comment = F.concat(F.coalesce(F.nullif(tidy("comment"), F.lit("")), F.lit("_(highlight, no comment)_")), F.when(_empty("suggestion") != "", "  ").otherwise(""))
    suggestion = F.when(_empty("suggestion") != "", F.concat(F.lit("Suggested: "), tidy("suggestion")))
    by = F.nullif(byline(), F.lit("")) if "authorName" in notes.columns else F.nullif(_empty("author"), F.lit(""))
    parts = F.concat_ws("\n", first, comment, suggestion, F.when(by.isNotNull(), F.concat(F.lit("_"), by, F.lit("_"))), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    rows = rows.select("doc_id", "place", "cat", "pos", F.concat(head, parts).alias("part"))
    body = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("place", "part"))).alias("p"))
    counts = category_counts(notes).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(" ", "name", F.col("n").cast("string")).alias("c")))).alias("c"))
    top = F.concat(F.lit("# Open review notes\n\n"), F.col("n").cast("string"), F.lit(" open notes, in manuscript order.\n\nBy category: "), F.array_join(F.transform("c", lambda x: x["c"]), ", "), F.lit(".\n\n"))
    return body.join(counts, "doc_id").select("doc_id", F.concat(top, F.array_join(F.transform("p", lambda x: x["part"]), "\n\n"), F.lit("\n")).alias("markdown"))


def report(notes: DataFrame, replies: DataFrame, edits: DataFrame, date: str, names: dict[str, str] | None = None, include_dismissed: bool = False) -> DataFrame:
    """One row a document with the report's payload, safe to stand inside a script element, and the number of labels that had to be made up."""
    names = names or {}
    drop = lambda df, *cs: df.drop(*cs)
    unsigned = lambda label: label.isin("Page owner", "Reviewer")
    n = without_dismissed(notes, include_dismissed).withColumn("author", report_signature(names))
    r = threads(replies, n).withColumn("author", report_signature(names))
    e = edits.withColumn("author", edit_signature(names))
    n, r, e = drop(n, "authorId", "createdAt", "updatedAt", "authorName"), drop(r, "authorId", "authorName"), drop(e, "authorId", "history", "authorName")

    def listed(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c != "doc_id"]
        made_up = F.count_if(unsigned(F.col("author"))) if name != "edits" else F.lit(0).cast("long")
        key = "block" if name == "edits" else "id"
        return df.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("__k"), F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(name), made_up.alias(f"__{name}"))

    lists = [listed(n, "notes"), listed(r, "replies"), listed(e, "edits")]
    all_docs = reduce(lambda a, b: a.join(b, "doc_id", "full_outer"), lists)
    payload = F.to_json(F.struct("notes", "edits", "replies", F.lit(date).alias("date")))
    count = F.coalesce("__notes", F.lit(0).cast("long")) + F.coalesce("__replies", F.lit(0).cast("long"))
    return all_docs.select("doc_id", F.replace(payload, F.lit("</"), F.lit("<\\/")).alias("payload"), count.alias("unsigned"))


#: Fixed value: how many drafts a task of ``draft_errors`` has.
DRAFTS_A_TASK = 100_000


def draft_errors(drafts: DataFrame, blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, draft_pos, level, message`` for everything wrong with a draft. A document with an error must not be written."""
    text_of = texts.select("doc_id", F.col("block_id").alias("block"), F.col("text").alias("__text"))
    kinds = blocks.select("doc_id", F.col("block_id").alias("fig"), F.col("kind").alias("__kind"))
    kind = F.when(F.col("kind") == "note", "note").when(F.col("fig").isNotNull() | F.col("box").isNotNull(), "box").otherwise("text")
    rows = drafts.withColumn("__variant", kind).withColumn("__quote", strip(_empty("exact")))
    # dealt to tasks of so many drafts, however many there are; else a task's share would grow with the table
    tasks = tasks_for(drafts, DRAFTS_A_TASK)
    rows = rows.join(text_of, ["doc_id", "block"], "left").repartition(tasks, "doc_id", "fig").join(kinds.repartition(tasks, "doc_id", "fig"), ["doc_id", "fig"], "left")
    # quotes without a block are looked for within their document, an equality that makes this a hash join
    free = rows.where((F.col("__variant") == "text") & F.col("block").isNull() & (F.col("__quote") != "")).select("doc_id", "draft_pos", "__quote")
    hits = free.join(texts.select("doc_id", "ord", F.col("block_id").alias("__b"), F.col("text").alias("__t")), "doc_id").where(F.contains("__t", "__quote"))
    counted = hits.groupBy("doc_id", "draft_pos").agg(F.count("*").alias("__hits"), F.min(F.struct("ord", "__b", "__t")).alias("__first"))
    rows = rows.join(counted, ["doc_id", "draft_pos"], "left").withColumn("__hits", F.coalesce("__hits", F.lit(0)))
    text = F.coalesce("__text", F.when(F.col("__hits") == 1, F.col("__first.__t")))
    from ..functions.text import is_iso_date, occurrences

    n = occurrences(text, F.col("__quote"))
    is_text, is_box = F.col("__variant") == "text", F.col("__variant") == "box"
    known = F.coalesce("cat", F.lit("mine")).isin(*CATEGORIES)
    box = F.col("box")
    x, y, w, h = (F.get(box, F.lit(i)) for i in range(4))
    inside = (x >= 0) & (x < 1) & (y >= 0) & (y < 1) & (w > 0) & (w <= 1 - x + 1e-6) & (h > 0) & (h <= 1 - y + 1e-6)
    has_quote, named = is_text & (F.col("__quote") != ""), F.col("block").isNotNull()
    occ = F.coalesce("occ", F.lit(0))
    single = known & has_quote & text.isNotNull() & F.contains(text, F.col("__quote"))
    rules = [
        ("error", ~known, F.concat(F.lit("unknown cat "), F.col("cat"))),
        ("error", known & is_box & (F.coalesce("__kind", F.lit("")) != "figure"), F.lit("not a figure id")),
        ("error", known & is_box & (F.col("__kind") == "figure") & ~F.coalesce((F.size(box) == 4) & inside, F.lit(False)), F.lit("box must be fractions inside the image")),
        ("error", known & is_text & (F.col("__quote") == ""), F.lit("empty exact")),
        ("error", known & has_quote & named & F.col("__text").isNull(), F.lit("block does not exist")),
        ("error", known & has_quote & named & F.col("__text").isNotNull() & ~F.contains("__text", "__quote"), F.lit("text not found in block")),
        ("error", known & has_quote & ~named & (F.col("__hits") == 0), F.lit("text not found anywhere")),
        ("error", known & has_quote & ~named & (F.col("__hits") > 1), F.concat(F.lit("text occurs in "), F.col("__hits").cast("string"), F.lit(" blocks"))),
        ("error", single & (occ >= n), F.lit("occ is beyond the last occurrence")),
        ("warn", known & has_quote & (F.col("exact") != F.col("__quote")), F.lit("exact has white space at its ends; trimmed")),
        ("warn", single & (n > 1) & F.col("occ").isNull(), F.lit("text occurs more than once; anchoring the first")),
        ("warn", single & (occ < n) & (_empty("suggestion") != "") & (F.length("__quote") < 4), F.lit("very short quote with a suggestion")),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(level).alias("level"), message.alias("message"))) for level, test, message in rules]))
    own = rows.select("doc_id", "draft_pos", F.explode(found).alias("e")).select("doc_id", "draft_pos", "e.level", "e.message")
    replies = drafts.where(known).select("doc_id", "draft_pos", F.posexplode("replies").alias("k", "r"))
    body = strip(F.coalesce("r.text", F.lit("")))
    date = F.coalesce("r.date", F.lit(""))
    wrong = F.when(body == "", "has no text").when(F.length(body) > 4000, "is longer than 4000 characters").when((date != "") & ~is_iso_date(date), "date is not ISO")
    bad = replies.withColumn("w", wrong).where(F.col("w").isNotNull())
    return own.unionByName(bad.select("doc_id", "draft_pos", F.lit("error").alias("level"), F.concat(F.lit("reply "), (F.col("k") + 1).cast("string"), F.lit(" "), F.col("w")).alias("message")))


def writable(drafts: DataFrame, errors: DataFrame) -> DataFrame:
    """Drafts of the documents that have no error at all."""
    bad = errors.where(F.col("level") == "error").groupBy("doc_id").agg(F.lit(1).alias("one"))
    return drafts.join(bad, "doc_id", "left_anti")


def search(notes: DataFrame, replies: DataFrame, text: str = "", cats: tuple[str, ...] = ()) -> DataFrame:
    """Notes of the categories whose own text, or a reply's, holds ``text`` in any case."""
    out = notes.where(F.col("cat").isin(*cats)) if cats else notes
    if not text:
        return out
    needle = F.lit(text.lower())
    said = replies.where(F.contains(F.lower("text"), needle)).groupBy("doc_id", F.col("note").alias("id")).agg(F.lit(True).alias("__said"))
    own = reduce(lambda a, b: a | b, [F.contains(F.lower(_empty(c)), needle) for c in ("exact", "comment", "suggestion", "author")])
    return out.join(said, ["doc_id", "id"], "left").where(own | F.coalesce("__said", F.lit(False))).drop("__said")


def addressed(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Notes that an edit addresses are done, with ``addressed_by``, the edit's author."""
    links = edits.select("doc_id", F.explode("addresses").alias("id"), "author").groupBy("doc_id", "id").agg(F.max("author").alias("addressed_by"))
    out = notes.join(links, ["doc_id", "id"], "left")
    return out.withColumn("status", F.when(F.col("addressed_by").isNotNull(), "done").otherwise(F.col("status")))


def apply_suggestions(notes: DataFrame, texts: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Edits that put a note's suggestion in the place of its quote: ``doc_id, block, text, baseText, addresses``.

    Given ``blocks``, quotes that run over several cells of a table give none: these are for the editor."""
    rows = notes.where((F.col("kind") == "text") & (_empty("suggestion") != "")).join(texts.select("doc_id", F.col("block_id").alias("block"), "text"), ["doc_id", "block"])
    if blocks is not None:
        parts = F.concat(F.array(F.coalesce("caption", F.lit(""))), F.flatten("rows"))
        tables = blocks.where("kind = 'table'").select("doc_id", F.col("block_id").alias("block"), F.transform(parts, without_tags).alias("__parts"))
        rows = rows.join(tables, ["doc_id", "block"], "left").where(F.col("__parts").isNull() | F.exists("__parts", lambda c: F.contains(c, F.col("exact"))))
    at = nth_offset(F.col("text"), F.col("exact"), F.coalesce("occ", F.lit(0)))
    new = F.concat(F.left("text", at.cast("int")), F.col("suggestion"), F.substr("text", (at + F.length("exact") + 1).cast("int")))
    return rows.where(at >= 0).select("doc_id", "id", "block", new.alias("text"), F.col("text").alias("baseText"), F.array("id").alias("addresses"))


def page_state(notes: DataFrame, texts: DataFrame, edits: DataFrame, replies: DataFrame) -> DataFrame:
    """Counters of a document's page: notes by state and kind, quotes that are gone, edits, replies and threads."""
    from .anchors import orphans

    a = notes.groupBy("doc_id").agg(
        F.count("*").alias("notes"),
        *[F.count_if(F.coalesce("status", F.lit("open")) == s).alias(s) for s in ("open", "done", "dismissed")],
        F.count_if(F.col("kind") == "text").alias("marks"),
        F.count_if(F.col("kind") == "box").alias("boxes"),
        F.count_if(F.col("kind") == "note").alias("general"),
        F.count_if(_empty("suggestion") != "").alias("suggestions"),
    )
    lost = orphans(notes, texts, edits).groupBy("doc_id").agg(F.count_if(F.col("state") == "orphan").alias("orphans"), F.count_if(F.col("state") != "orphan").alias("edited_quotes"))
    b = edits.groupBy("doc_id").agg(F.count("*").alias("edits"))
    c = threads(replies, notes).groupBy("doc_id").agg(F.count("*").alias("replies"), F.countDistinct("note").alias("threads"))
    out = reduce(lambda x, y: x.join(y, "doc_id", "left"), [a, lost, b, c])
    return out.na.fill(0)


def squeezed(df: DataFrame, *columns: str) -> DataFrame:
    """White space of the given columns squeezed."""
    return df.withColumns({c: squeeze(F.col(c)) for c in columns})
