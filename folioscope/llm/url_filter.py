"""URL filtering by rules and by a cascade of Bloom filters, in DataFrame functions only.

The list is a table of keys, domains; a host is listed if it or a domain above it is a key. The universe are the distinct hosts
of the corpus, which are held against the list once. Level 1 of the cascade encodes the listed hosts; level 2 encodes those
unlisted hosts of the universe that level 1 lets through; level 3 the listed hosts that level 2 lets through; and so on, until
a level lets nothing through. The first level that refuses a host decides: over the universe, which is complete, membership is
exact, and no join with the list is needed to judge a row.

Level 1 has log2(universe / listed) bits and more a listed host, later levels a constant number, so the size of the cascade is
bounded by the number of listed hosts. Each level is one written row with an array of bits. Where more than ``MAX_LISTED``
hosts are listed, so that a task could not hold the bits, rows are joined with the listed hosts instead, with the same result.

Null and malformed URLs have empty host and path. Repeated rows are judged alike, as are repeated keys; null and empty keys list
nothing. An empty list blocks nothing, an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_is_set, bit_words, materialised

HASHES, MAX_LISTED = 4, 5_000_000
#: Verdict, host and path prefix.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The list that the query uses: each of these names under each of these domains.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_UNDER = ("example.com", "example.net", "example.org")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


class Cascade:
    """Levels, each a number of bits and a written row with the words of 64 bits."""

    def __init__(self, levels: list[tuple[int, DataFrame]]):
        self.levels = levels

    @staticmethod
    def _places(key: Column, level: int, bits: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]

    @classmethod
    def _passes(cls, key: Column, level: int, bits: int, words: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [bit_is_set(words, p) for p in cls._places(key, level, bits)])

    @classmethod
    def build(cls, universe: DataFrame, key_col: str, listed_col: str) -> Cascade:
        """From distinct keys with a flag."""
        rest = {True: universe.where(F.col(listed_col)), False: universe.where(~F.col(listed_col))}
        sizes = {r[listed_col]: r["n"] for r in universe.groupBy(listed_col).agg(F.count("*").alias("n")).collect()}
        n, side = sizes.get(True, 0), True
        levels: list[tuple[int, DataFrame]] = []
        while n:
            level = len(levels)
            ratio = max(2.0, sizes.get(False, 0) / n) if not level else 2.0
            bits = 64 * max(1, math.ceil(n * max(3.0, 1.6 * math.log2(ratio)) / 64))
            places = rest[side].select(F.explode(F.array(*cls._places(F.col(key_col), level, bits))).alias("p"))
            levels.append((bits, bit_words(places, bits)))
            side = not side
            rest[side] = materialised(rest[side].where(cls._passes(F.col(key_col), level, *levels[-1])))
            n = rest[side].count()
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """Whether the list holds the key: the number of the first level that refuses it is even, counted from 1."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(self._passes(key, level, *self.levels[level]), verdict).otherwise(F.lit(level % 2 == 1))
        return verdict


def own_list(spark: SparkSession) -> DataFrame:
    """``key``: the domains that the query's list holds."""
    names, under = (F.explode(F.array(*[F.lit(x) for x in values])) for values in (LISTED_NAMES, LISTED_UNDER))
    return spark.range(1).select(names.alias("name"), F.lit(1)).select("name", under.alias("under")).select(F.concat_ws(".", "name", "under").alias("key"))


def listed_hosts(hosts: DataFrame, keys: DataFrame) -> DataFrame:
    """``host`` and ``listed`` for each of the distinct ``hosts``: whether it or a domain above it is among ``keys`` (``key``)."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wanted = keys.where(F.col("key") != "").select(F.translate("key", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("key")).distinct()
    found = hosts.select("host", F.explode(above).alias("key")).join(wanted, "key", "left_semi").select("host").distinct()
    return hosts.join(found.withColumn("listed", F.lit(True)), "host", "left").select("host", F.coalesce("listed", F.lit(False)).alias("listed"))


def judge(pages: DataFrame, keys: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", most: int = MAX_LISTED) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page: the rule's verdict, else block where the list of ``keys`` (``key``) holds
    the host."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = materialised(listed_hosts(rows.groupBy("host").agg(F.lit(1).alias("one")).select("host"), keys))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if hosts.where("listed").count() > most:
        rows = rows.join(hosts.where("listed"), "host", "left")
        holds = F.coalesce("listed", F.lit(False))
    else:
        holds = Cascade.build(hosts, "host", "listed").holds(F.col("host"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(holds, "block").otherwise("allow")).alias("verdict"))
