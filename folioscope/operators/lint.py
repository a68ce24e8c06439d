"""Checks on repositories of skill files: metadata, change logs, indexes, releases, packaging lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_sentence

#: The keys that metadata may have, and what packages leave out.
ALLOWED_KEYS = ("name", "description", "license", "allowed-tools", "metadata", "compatibility")
SKIPPED_DIRS, SKIPPED_FILES, SKIPPED_PATTERN = ("__pycache__", ".git", "node_modules", "evals"), (".DS_Store",), r"\.(pyc|skill)$"


def sections(changelog: DataFrame, text: str = "text") -> DataFrame:
    """``##`` headings of change logs with their ``###`` versions and the text below each: ``section, version, body, pos``."""
    parts = changelog.select(*[c for c in changelog.columns if c != text], F.posexplode(F.split(F.col(text), r"(?m)^## ")).alias("s_pos", "part")).where("s_pos > 0")
    parts = parts.withColumn("section", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)))
    rest = [c for c in parts.columns if c not in ("part",)]
    vers = parts.select(*rest, F.posexplode(F.split("part", r"(?m)^### ")).alias("pos", "v")).where("pos > 0")
    return vers.withColumn("version", F.regexp_extract("v", r"^\[?v?(\d+\.\d+\.\d+)", 1)).withColumn("body", F.trim(F.regexp_extract("v", r"(?s)^[^\n]*\n(.*)$", 1))).drop("v")


def rule_violations(skills: DataFrame, log: DataFrame, files: DataFrame) -> DataFrame:
    """``skill, level, message``. ``skills``: ``skill, meta (map), body``; ``log``: ``section, version``; ``files``: ``skill, path``."""
    meta = lambda k: F.coalesce(F.element_at("meta", k), F.lit(""))
    has = log.select(F.col("section").alias("skill"), "version").groupBy("skill", "version").agg(F.lit(True).alias("logged"))
    rows = skills.withColumn("version", meta("version")).join(has, ["skill", "version"], "left")
    extra = F.array_except(F.map_keys("meta"), F.array(*[F.lit(k) for k in (*ALLOWED_KEYS, "version", "author")]))
    rules = [
        ("error", F.size(extra) > 0, F.concat(F.lit("unexpected keys: "), F.array_join(F.sort_array(extra), ", "))),
        ("error", ~meta("name").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$") | (F.length(meta("name")) > 64), F.lit("name must be kebab-case of at most 64 characters")),
        ("error", meta("name") != F.col("skill"), F.lit("name differs from the folder")),
        ("error", (meta("description") == "") | (F.length(meta("description")) > 1024), F.lit("description must have 1 to 1024 characters")),
        ("error", meta("description").rlike("[<>]|TODO"), F.lit("description holds angle brackets or TODO")),
        ("error", F.length(meta("compatibility")) > 500, F.lit("compatibility is longer than 500 characters")),
        ("error", ~F.col("version").rlike(r"^\d+\.\d+\.\d+$"), F.lit("version is not semantic")),
        ("error", F.col("version").rlike(r"^\d+\.\d+\.\d+$") & F.col("logged").isNull(), F.lit("the change log has no entry for the version")),
        ("warn", F.size(F.split("body", "\n")) > 500, F.lit("body is longer than 500 lines")),
    ]
    own = rows.select("skill", F.explode(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(lv).alias("level"), m.alias("message"))) for lv, t, m in rules]))).alias("e")).select("skill", "e.*")
    named = F.array_distinct(F.regexp_extract_all("body", F.lit(r"`((?:scripts|references|assets)/[\w./-]+)`"), F.lit(1)))
    gone = skills.select("skill", F.explode(named).alias("path")).join(files, ["skill", "path"], "left_anti")
    return own.unionByName(gone.select("skill", F.lit("error").alias("level"), F.concat(F.lit("mentioned file does not exist: "), F.col("path")).alias("message")))


def lint_report(skills: DataFrame, violations: DataFrame) -> DataFrame:
    """``skill, state`` (``ok`` or ``FAIL``) and its messages."""
    own = violations.groupBy("skill").agg(F.max((F.col("level") == "error").cast("int")).alias("bad"), F.sort_array(F.collect_list(F.concat_ws(": ", "level", "message"))).alias("messages"))
    return skills.select("skill").join(own, "skill", "left").select("skill", F.when(F.col("bad") == 1, "FAIL").otherwise("ok").alias("state"), F.coalesce("messages", F.expr("cast(array() as array<string>)")).alias("messages"))


def release(tags: DataFrame, skills: DataFrame, log: DataFrame) -> DataFrame:
    """Release tags ``name-v1.2.3`` with their notes; ``state`` says what does not agree."""
    cut = tags.select("tag", F.regexp_extract("tag", r"^(.*)-v(\d+\.\d+\.\d+)$", 1).alias("skill"), F.regexp_extract("tag", r"^(.*)-v(\d+\.\d+\.\d+)$", 2).alias("version"))
    known = skills.select("skill", F.element_at("meta", "version").alias("current"))
    notes = log.select(F.col("section").alias("skill"), "version", F.col("body").alias("notes"))
    out = cut.join(known, "skill", "left").join(notes, ["skill", "version"], "left")
    state = F.when(F.col("skill") == "", "no tag of a release").when(F.col("current").isNull(), "unknown skill").when(F.col("current") != F.col("version"), "version differs").when(F.col("notes").isNull(), "no notes").otherwise("ok")
    return out.select("tag", "skill", "version", "notes", state.alias("state"))


def index_rows(skills: DataFrame) -> DataFrame:
    """Rows of the index table."""
    return skills.select("skill", F.concat(F.lit("| ["), F.col("skill"), F.lit("](skills/"), F.col("skill"), F.lit(") | "), first_sentence(F.element_at("meta", "description")), F.lit(" | "), F.element_at("meta", "version"), F.lit(" |")).alias("row"))


def stale(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value is not what it was, or is new."""
    return new.join(old.select(key, F.col(value).alias("__old")), key, "left").where(~F.col(value).eqNullSafe(F.col("__old"))).select(key)


def packaged(files: DataFrame) -> DataFrame:
    """Paths that go into a package."""
    parts = F.split("path", "/")
    skip = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in SKIPPED_DIRS])) | F.element_at(parts, -1).isin(*SKIPPED_FILES) | F.col("path").rlike(SKIPPED_PATTERN)
    return files.where(~skip)


def with_section(names: DataFrame, new: str) -> DataFrame:
    """Headings with a new one, in order, ``Repository`` last, each with its place."""
    added = names.select("name").unionByName(names.sparkSession.createDataFrame([(new,)], "name string")).groupBy("name").agg(F.lit(1).alias("one"))
    return added.select("name", F.row_number().over(Window.orderBy(F.col("name") == "Repository", "name")).alias("place"))
