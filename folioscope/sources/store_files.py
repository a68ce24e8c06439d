"""Reading the store's files: notes, replies and edits as JSON, listings of versions, skill files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_suffix
from ..schemas import EDITS, NOTES, REPLIES

FORMATS = {".docx": "docx", ".tex": "latex", ".zip": "latex", ".pdf": "pdf"}


def format_of(path: Column, formats: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (formats or FORMATS).items() for x in kv])
    return F.coalesce(F.element_at(table, file_suffix(path)), F.lit("unknown"))


def manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """Files with their format; unknown suffixes are kept and named so."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", format_of(F.col("path")).alias("format"), "length", "content")


def _fields(ddl: str) -> str:
    """A schema without the manuscript's id, which files do not hold."""
    return ddl.replace("doc_id BIGINT, ", "", 1)


def _items(spark: SparkSession, path: str, ddl: str, name: str) -> DataFrame:
    """Rows of a folder of one-item files, of an export's list ``name``, or of a bare list."""
    lists = {"annotations": _fields(NOTES), "replies": _fields(REPLIES), "edits": _fields(EDITS)}
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    rows = text.select(F.input_file_name().alias("file"), F.trim("value").alias("v"))
    item = f"STRUCT<{', '.join(_colon(c) for c in _split(lists[name]))}>"
    envelope = F.from_json("v", f"{name} ARRAY<{item}>, id STRING, block STRING")[name]
    listed = F.when(F.col("v").startswith("["), F.from_json("v", f"ARRAY<{item}>")).when(envelope.isNotNull(), envelope).otherwise(F.array(F.from_json("v", item)))
    out = rows.select("file", F.posexplode(listed).alias("pos", "x")).select("file", "pos", "x.*")
    key = "block" if name == "edits" else "id"
    return out.where(F.col(key).isNotNull())


def _split(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()]


def _colon(field: str) -> str:
    name, kind = field.split(" ", 1)
    return f"{name}:{kind}"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return _items(spark, path, NOTES, "annotations")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def sibling(path: str, name: str) -> str:
    """The collection ``name`` beside a notes folder or file."""
    return re.sub(r"[^/]+/?$", "", path) + name


def _with_fallback(spark: SparkSession, notes_path: str, explicit: str | None, name: str, ddl: str) -> DataFrame:
    """An explicit path, a folder beside the notes, the export's own list, or nothing."""
    if explicit:
        return _items(spark, explicit, ddl, name)
    beside = sibling(notes_path, name)
    if _exists(spark, beside):
        return _items(spark, beside, ddl, name)
    if notes_path.endswith(".json"):
        return _items(spark, notes_path, ddl, name)
    return spark.createDataFrame([], "file STRING, pos INT, " + _fields(ddl))


def read_replies(spark: SparkSession, notes_path: str, explicit: str | None = None) -> DataFrame:
    return _with_fallback(spark, notes_path, explicit, "replies", REPLIES)


def read_edits(spark: SparkSession, notes_path: str, explicit: str | None = None) -> DataFrame:
    return _with_fallback(spark, notes_path, explicit, "edits", EDITS)


def version_listing(lines: DataFrame) -> DataFrame:
    """``id, version`` from lines of a listing (``value``, ``line_no``); of several lines for one id the last counts."""
    pattern = r'-\s+"([^"]+)"\s+\d+\s+bytes\s+"[^"]*"\s+version\s+(\d+)'
    found = lines.select(F.regexp_extract("value", pattern, 1).alias("id"), F.regexp_extract("value", pattern, 2).alias("v"), "line_no").where("id <> ''")
    return found.groupBy("id").agg(F.max_by(F.col("v").cast("bigint"), "line_no").alias("version"))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return version_listing(whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value")))


def parse_frontmatter(text: str) -> dict[str, str]:
    """Keys of the block between the first two ``---`` lines; a nested key is ``outer.inner``."""
    found = re.match(r"---\n(.*?)\n---", text or "", re.S)
    out: dict[str, str] = {}
    outer = ""
    for line in found[1].split("\n") if found else ():
        if m := re.match(r"( *)([\w-]+):\s*(.*)$", line):
            key = f"{outer}.{m[2]}" if m[1] and outer else m[2]
            if not m[1]:
                outer = m[2] if not m[3] else ""
            if m[3]:
                out[key] = m[3].strip().strip("\"'")
    return out


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """``skill, meta, body`` of every folder with a SKILL.md below ``path``."""
    import pandas as pd

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "SKILL.md").text(path, wholetext=True)
    rows = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/SKILL\.md$", 1).alias("skill"), F.col("value").alias("text"))

    def parsed(batches):
        for batch in batches:
            yield pd.DataFrame({"skill": batch["skill"], "meta": batch["text"].map(parse_frontmatter), "body": batch["text"].str.replace(r"(?s)^---\n.*?\n---\n", "", regex=True)})

    return rows.mapInPandas(parsed, "skill string, meta map<string,string>, body string")
