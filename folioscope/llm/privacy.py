"""Personal data, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Every distinct base value is a protected
entity. A term (a lower-cased word of three letters or more, outside base spans) that stands in a document of an entity may
reveal it. The corpus's co-occurrence says how much: of an entity's information, ``IC(e) = -log2 p(e)``, a term discloses
``PMI(t; e) = log2 p(e | t) / p(e)``, and ``IC - PMI = -log2 p(e | t)`` bits are left to guess. For ``p(e | t)`` its lower confidence
bound (Wilson's, of one standard deviation) is taken, so the fewer documents a term has, the less it is believed. Terms that leave
``REMOVE_WITHIN`` bits or less are removed, those that leave ``GENERALISE_WITHIN`` or less are generalised, wherever they stand: also
far from the entity, and in documents without it.

What is left to guess depends on the documents of the term alone and not on how large the corpus is: a term of two documents, one
of them the entity's, leaves 2.24 bits in any corpus. A term of one document is never taken, since nothing confirms it; nor is one that
makes its entity less than ``2 ** LEAST_PMI`` times as likely, as no term can an entity of more than a quarter of all documents.
Terms, entities, pairs and the corpus are all counted over distinct texts, so copies change nothing.

Null text counts as empty and has no spans. Repeated rows get the same spans each, and rows of one id with different texts each
those of its own text; columns other than the id and the text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bit_table, id_and_text, id_filter, map_batches, materialised

#: Bits left of an entity's information, bits that a term must disclose at least, and documents that it must have.
GENERALISE_WITHIN, REMOVE_WITHIN, LEAST_PMI, LEAST_DOCS = 2.3, 0.7, 2.0, 2
KINDS = ("email", "ip", "card", "phone")
#: What is put behind a term for each of its places in the table of bits.
ENDINGS = ("", "1", "23")

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
_LUHN = [sum(divmod(2 * d, 10)) for d in range(10)]


def _emails(text: str):
    """As the pattern would match from left to right: a local part is the whole run of its characters before an @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(_LUHN[d] for d in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end in code points, by kind and then by start. Matches that fail their test are dropped."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def words(text: str, spans: list[tuple[str, int, int]]):
    """Term, start and end of each word that no base span touches."""
    held, k = sorted((a, b) for _, a, b in spans), 0
    for m in WORD.finditer(text):
        while k < len(held) and held[k][1] <= m.start():
            k += 1
        if k == len(held) or held[k][0] >= m.end():
            yield m[0].lower(), m.start(), m.end()


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    return {t for t, _, _ in words(text, spans)} if spans else {w.lower() for w in set(WORD.findall(text))}


def find_base(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``spans`` (kind, begin, end), distinct ``entities`` and, where there are any, distinct ``terms``; ``key`` and ``h`` are of the text."""
    schema = "doc_id bigint, h bigint, key binary, spans array<struct<kind:string,begin:int,end:int>>, entities array<string>, terms array<string>"

    def work(batch: pa.RecordBatch) -> dict:
        keys, spans, entities, terms = [], [], [], []
        for text in batch.column("text").to_pylist():
            own = base_spans(text)
            keys.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
            spans.append([{"kind": k, "begin": a, "end": b} for k, a, b in own])
            entities.append(list({f"{k}:{text[a:b].lower()}" for k, a, b in own}))
            terms.append(list(terms_of(text, own)) if own else [])
        return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "key": keys, "spans": spans, "entities": entities, "terms": terms}

    return map_batches(id_and_text(df, id_col, text_col).withColumn("h", F.xxhash64("text")), schema, work)


def term_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term, docs``: in how many texts of ``df`` each term occurs; counted by batch before anything is shuffled."""

    def work(batch: pa.RecordBatch) -> dict:
        count: Counter = Counter()
        for text in batch.column("text").to_pylist():
            count.update(terms_of(text, base_spans(text)))
        return {"term": list(count), "docs": list(count.values())}

    return map_batches(id_and_text(df, id_col, text_col), "term string, docs bigint", work).groupBy("term").agg(F.sum("docs").alias("docs"))


def lower_bound(both: Column, docs: Column) -> Column:
    """Wilson's bound, one standard deviation low, of a share of which ``both`` of ``docs`` were seen."""
    p = both / docs
    return (p + 1 / (2 * docs) - F.sqrt(p * (1 - p) / docs + 1 / (4 * docs * docs))) / (1 + 1 / docs)


def disclosing_terms(rows: DataFrame, counts: DataFrame, documents: int, generalise_within: float = GENERALISE_WITHIN, remove_within: float = REMOVE_WITHIN, least_pmi: float = LEAST_PMI) -> DataFrame:
    """``entity, term, action`` for each pair beyond a threshold. ``rows`` has ``key``, which is of a text, ``entities`` and ``terms``.

    A pair cannot stand in more documents than its term or its entity. Those that would leave too much to guess even then, and
    so nearly all pairs with a common term, are left out before pairs are formed, which loses none."""
    held = rows.select("key", F.explode("entities").alias("entity"))
    held = held.join(held.groupBy("entity").agg(F.count("*").alias("contexts")), "entity")
    known = rows.select("key", F.explode("terms").alias("term")).join(counts.where(F.col("docs") >= LEAST_DOCS), "term")
    n = F.lit(float(max(documents, 1)))

    def left(both: Column) -> Column:
        """Bits to guess; null where the term discloses too little."""
        p = lower_bound(both, F.col("docs"))
        return F.when(p * n >= 2**least_pmi * F.col("contexts"), -F.log2(p))

    pairs = known.join(held, "key").where(left(F.least("docs", "contexts")) <= generalise_within)
    pairs = pairs.groupBy("entity", "term", "docs", "contexts").agg(F.count("*").alias("both")).withColumn("left", left(F.col("both")))
    action = F.when(F.col("left") <= remove_within, F.lit("remove")).when(F.col("left") <= generalise_within, F.lit("generalise"))
    return pairs.select("entity", "term", action.alias("action")).where(F.col("action").isNotNull())


def find_places(df: DataFrame, risky: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h, begin, end, kind`` of each place of a term of ``risky`` (``term, kind``), in all documents; ``h`` is of the text.

    A table of bits of fixed size says in the scan which words these may be; the join then knows."""
    places = F.explode(F.array(*[F.pmod(F.crc32(F.concat(F.col("term"), F.lit(e)).cast("binary")), F.lit(FILTER_BITS)) for e in ENDINGS]))
    table = bit_table(risky.select(places.alias("p")), FILTER_BITS)
    shared = df.sparkSession.sparkContext.broadcast(table.tobytes())

    def work(batch: pa.RecordBatch) -> dict | None:
        bits, endings, out = shared.value, [e.encode() for e in ENDINGS], []
        for own, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
            maybe = set()
            for word in set(WORD.findall(text)):
                own_sum = zlib.crc32(word.lower().encode())
                for end in endings:
                    at = zlib.crc32(end, own_sum) % FILTER_BITS
                    if not bits[at >> 3] >> (at & 7) & 1:
                        break
                else:
                    maybe.add(word.lower())
            if maybe:
                out += [(own, h, t, a, b) for t, a, b in words(text, base_spans(text)) if t in maybe]
        return dict(zip(("doc_id", "h", "term", "begin", "end"), map(list, zip(*out, strict=True)), strict=True)) if out else None

    texts = id_and_text(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    found = map_batches(texts, "doc_id bigint, h bigint, term string, begin int, end int", work)
    return found.join(risky, "term").select("doc_id", "h", "begin", "end", "kind")


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``h`` (a hash of the text), ``base`` and ``terms`` (arrays of kind, begin, end; terms sorted, each place once) of every row."""
    rows = materialised(find_base(df, id_col, text_col))
    # Of rows with one text the one with the smallest id counts, once. Only texts that may be copies are shuffled to leave these out.
    seen = rows.groupBy("key", "h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    seen = materialised(seen)
    again = materialised(seen.where(F.col("n") > 1).select("h"))
    maybe = id_filter(again, "h")(F.xxhash64("text"))
    texts = id_and_text(df, id_col, text_col)
    told = texts.where(maybe).groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")
    own = rows.where(F.size("entities") > 0).groupBy("key").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    pairs = disclosing_terms(own, term_counts(texts.where(~maybe).unionByName(told)), seen.count())
    risky = materialised(pairs.groupBy("term").agg(F.max("action").alias("kind")))
    hits = find_places(df, risky, id_col, text_col).groupBy("doc_id", "h", "begin", "end").agg(F.max("kind").alias("kind"))
    # A document has at most one hit a word, so a group is bounded by its text.
    terms = hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("kind", "begin", "end"))).alias("hits"))
    own_row = rows["doc_id"].eqNullSafe(terms["doc_id"]) & (rows["h"] == terms["h"])
    empty = F.expr("cast(array() as array<struct<kind:string,begin:int,end:int>>)")
    return rows.join(terms, own_row, "left").select(rows["doc_id"], rows["h"], F.col("spans").alias("base"), F.coalesce("hits", empty).alias("terms"))


def sanitise_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Base spans and generalised terms become their kind in brackets, removed terms go. Overlapping spans act as one."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], "" if kind == "remove" else "[TERM]" if kind == "generalise" else f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with its text sanitised; all rows and columns stay, null text stays null.

    Base spans are found again in the text itself, so only documents with disclosing terms have to be joined with anything. A
    table of bits of fixed size says in the scan which these may be; the other texts are not shuffled."""
    found = find_spans(df, id_col, text_col).where(F.size("terms") > 0)
    terms = materialised(found.groupBy("doc_id", "h").agg(F.first("terms").alias("terms")))
    # All of a row's other columns as one, so that their names cannot clash.
    rows = df.select(F.struct(F.lit(0).alias("_"), *[df[c] for c in df.columns if c != text_col]).alias("whole"), df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    maybe = id_filter(terms, "h")(F.col("h"))

    def clean(texts, found):
        import pandas as pd

        def one(text, own):
            if text is None:
                return None
            spans = base_spans(text) + [(x["kind"], x["begin"], x["end"]) for x in (own if own is not None else ())]
            return sanitise_text(text, spans) if spans else text

        return pd.Series([one(t, f) for t, f in zip(texts, found, strict=True)], dtype=object)

    cleaned = F.pandas_udf(clean, "string")
    plain = rows.where(~maybe).withColumn("terms", F.lit(None).cast("array<struct<kind:string,begin:int,end:int>>"))
    asked = rows.where(maybe)
    asked = asked.join(terms, asked["doc_id"].eqNullSafe(terms["doc_id"]) & (asked["h"] == terms["h"]), "left").select("whole", asked["doc_id"], "text", asked["h"], "terms")
    both = plain.unionByName(asked).withColumn("clean", cleaned("text", "terms"))
    return both.select(*[F.col("clean").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in df.columns])


def spans_text(*columns: str):
    """Column expression: all spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(F.concat(*columns), lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
