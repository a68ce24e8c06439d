"""Views of the driver's tables that stand in for manuscripts, notes and edits, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as blocks; the first is the title."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.select("doc_id", "ord", F.format_string("b%03d", F.col("ord") + 1).alias("block_id"), F.when(F.col("ord") == 0, "title").otherwise("p").alias("kind"), "text")


BLOCKS = """blocks AS (
    SELECT doc_id, ord, 'b' || CASE WHEN ord < 999 THEN lpad(CAST(ord + 1 AS VARCHAR), 3, '0') ELSE CAST(ord + 1 AS VARCHAR) END AS block_id,
           CASE WHEN ord = 0 THEN 'title' ELSE 'p' END AS kind, text
    FROM (SELECT doc_id, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ord
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))"""


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as blocks with headings of two levels."""
    kind = F.when(F.col("role") == "system", "h2").when(F.col("role") == "user", "h3").otherwise("p")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.concat(F.lit("b"), F.col("turn").cast("string")).alias("block_id"), kind.alias("kind"), F.col("text").alias("html"), F.lit(None).cast("string").alias("label")
    )


TALK = """talk AS (
    SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS ord, 'b' || CAST(turn AS VARCHAR) AS block_id,
           CASE role WHEN 'system' THEN 'h2' WHEN 'user' THEN 'h3' ELSE 'p' END AS kind, text AS html FROM conversations)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes: a customer is the manuscript, the status a note's state, the priority its category."""
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "dismissed").when(F.col("o_orderkey") % 3 == 0, None).otherwise("open")
    unsigned = F.col("o_custkey") % 5 == 0
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"),
        F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderkey").alias("num"),
        F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]+", "").alias("cat"),
        state.alias("status"),
        F.when(unsigned, "").otherwise(F.concat(F.lit("author"), (F.col("o_custkey") % 7).cast("string"))).alias("author"),
        F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("u"), (F.col("o_custkey") % 11).cast("string"))).alias("authorId"),
        F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Name "), (F.col("o_custkey") % 11).cast("string"))).alias("authorName"),
        (unsigned & (F.col("o_orderkey") % 2 == 0)).alias("byOwner"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
        F.col("o_totalprice").alias("price"),
    )


NOTES = """notes AS (
    SELECT o_custkey AS doc_id, 'n' || CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS num,
           regexp_replace(lower(o_orderpriority), '[^a-z]+', '', 'g') AS cat,
           CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'dismissed' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'open' END AS status,
           CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'author' || CAST(o_custkey % 7 AS VARCHAR) END AS author,
           CASE WHEN o_orderkey % 4 = 1 THEN 'u' || CAST(o_custkey % 11 AS VARCHAR) END AS authorId,
           CASE WHEN o_orderkey % 4 = 1 THEN 'Name ' || CAST(o_custkey % 11 AS VARCHAR) END AS authorName,
           (o_custkey % 5 = 0 AND o_orderkey % 2 = 0) AS byOwner,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS createdAt, o_totalprice AS price
    FROM orders)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as replies. Lines have no key of their own; the text names all that tells them apart."""
    lines = table(spark, sf_dir, "lineitem")
    text = F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("bigint").cast("string"))
    return lines.select(F.concat(F.lit("n"), F.col("l_orderkey").cast("string")).alias("note"), text.alias("text"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), F.col("l_extendedprice").alias("price"))


REPLIES = """replies AS (
    SELECT 'n' || CAST(l_orderkey AS VARCHAR) AS note,
           concat_ws('/', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag, l_linestatus, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS text,
           strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS createdAt, l_extendedprice AS price
    FROM lineitem)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of blocks: the user is the block, the time and the event's id say which is later."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("block"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("version"), F.col("event_type").alias("op"), F.col("value"), F.col("props").alias("data"))


VERSIONS = "versions AS (SELECT user_id AS block, ts, event_id AS version, event_type AS op, value, props AS data FROM events)"


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


STAMP = "'%Y-%m-%dT%H:%M:%SZ'"
