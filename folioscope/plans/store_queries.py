"""The notes store: state, history, leases, ownership, permissions, listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lint, store
from . import standins as S
from .registry import query


@query("s14_read_db", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def s14(spark, d):
    return store.read(S.table(spark, d, "orders"), [("o_orderstatus", "eq", "O"), ("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("s13_version_listing", """WITH l AS (SELECT '- "e' || CAST(user_id AS VARCHAR) || '" 12 bytes "x" version ' || CAST(event_id AS VARCHAR) AS line, event_id AS n FROM events)
       SELECT regexp_extract(line, '-\\s+"([^"]+)"\\s+\\d+\\s+bytes\\s+"[^"]*"\\s+version\\s+(\\d+)', 1) AS id, arg_max(CAST(regexp_extract(line, 'version\\s+(\\d+)', 1) AS BIGINT), n) AS version FROM l GROUP BY 1""")
def s13(spark, d):
    from ..sources.store_files import version_listing

    lines = S.table(spark, d, "events").select(F.concat(F.lit('- "e'), F.col("user_id").cast("string"), F.lit('" 12 bytes "x" version '), F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("line_no"))
    return version_listing(lines)


@query("k8_merge_with_pins", f"""WITH c AS (SELECT o_orderkey AS id, CAST(o_custkey % 4 + 1 AS BIGINT) AS version, o_orderstatus AS data FROM orders WHERE o_orderkey % 3 <> 0),
       w AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'set' END AS op, o_orderpriority AS data, CASE WHEN o_orderkey % 7 < 3 THEN CAST(o_orderkey % 4 + 1 AS BIGINT) END AS if_version FROM orders WHERE o_orderkey % 2 = 0),
       b AS (SELECT coalesce(c.id, w.id) AS id, c.version, c.data, w.op, w.data AS new, w.if_version, w.id IS NOT NULL AS asked FROM c FULL OUTER JOIN w ON c.id = w.id),
       o AS (SELECT *, CASE WHEN NOT asked THEN 'kept' WHEN if_version IS NOT NULL AND if_version <> coalesce(version, 0) THEN 'conflict' WHEN op IN ('update', 'delete') AND version IS NULL THEN 'missing' WHEN op = 'delete' THEN 'deleted' ELSE 'written' END AS outcome FROM b)
       SELECT id, CASE outcome WHEN 'deleted' THEN NULL WHEN 'written' THEN coalesce(version, 0) + 1 ELSE version END AS version, CASE outcome WHEN 'deleted' THEN NULL WHEN 'written' THEN new ELSE data END AS data, outcome FROM o""")
def k8(spark, d):
    o = S.table(spark, d, "orders")
    current = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey id", "cast(o_custkey % 4 + 1 as bigint) version", "o_orderstatus data")
    writes = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey id", "case o_orderkey % 5 when 0 then 'delete' when 1 then 'update' else 'set' end op", "o_orderpriority data", "case when o_orderkey % 7 < 3 then cast(o_orderkey % 4 + 1 as bigint) end if_version")
    return store.merge(current, writes)


@query("k8_writes_in_order", """WITH RECURSIVE w AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'set' END AS op, event_type AS data, CASE WHEN event_id % 3 = 0 THEN event_id % 4 END AS pin FROM events),
       c AS (SELECT c_custkey AS id, CAST(1 AS BIGINT) AS version, c_mktsegment AS data FROM customer WHERE c_custkey % 2 = 0),
       ids AS (SELECT id FROM c UNION SELECT id FROM w),
       s AS (SELECT id, CAST(0 AS BIGINT) AS n, c.version, c.data, '' AS outcomes FROM ids LEFT JOIN c USING (id)
             UNION ALL
             SELECT id, n, CASE o WHEN 'deleted' THEN NULL WHEN 'written' THEN coalesce(version, 0) + 1 ELSE version END, CASE o WHEN 'deleted' THEN NULL WHEN 'written' THEN new ELSE data END, outcomes || o || ' '
             FROM (SELECT s.id, w.n, s.version, s.data, w.data AS new, s.outcomes, CASE WHEN pin IS NOT NULL AND pin <> coalesce(s.version, 0) THEN 'conflict' WHEN op IN ('update', 'delete') AND s.version IS NULL THEN 'missing' WHEN op = 'delete' THEN 'deleted' ELSE 'written' END AS o
                   FROM s JOIN w ON w.id = s.id AND w.n = s.n + 1))
       SELECT id, version, data, rtrim(outcomes, ' ') AS outcomes FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1""")
def k8_in_order(spark, d):
    """Events as writes of their users, each seeing what the one before it has left."""
    writes = S.table(spark, d, "events").selectExpr("user_id id", "event_id pos", "case event_id % 5 when 0 then 'delete' when 1 then 'update' else 'set' end op", "event_type data", "case when event_id % 3 = 0 then event_id % 4 end if_version")
    current = S.table(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey id", "cast(1 as bigint) version", "c_mktsegment data")
    return store.merge_in_order(current, writes, ["pos"]).withColumn("outcomes", F.array_join("outcomes", " "))


@query("t1_latest_state", f"WITH {S.VERSIONS} SELECT block, max(version) AS version, arg_max(op, version) AS op, arg_max(data, version) AS data FROM versions GROUP BY block")
def t1(spark, d):
    return store.last_writes(S.versions(spark, d), ["block"], ["version"]).select("block", "version", "op", "data")


@query("t2_one_document_a_reply", "SELECT conv_id, turn, count(*) AS writes FROM conversations GROUP BY ALL")
def t2(spark, d):
    return S.table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("writes"))


@query("t3_lease_spans", f"""WITH {S.VERSIONS}, f AS (SELECT block, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 45 SECOND THEN 1 ELSE 0 END AS fresh FROM versions WINDOW w AS (PARTITION BY block ORDER BY ts)),
       n AS (SELECT block, ts, sum(fresh) OVER (PARTITION BY block ORDER BY ts) AS lease_no FROM f)
       SELECT block, CAST(lease_no AS BIGINT) AS lease_no, strftime(min(ts), {S.STAMP}) AS started, strftime(max(ts), {S.STAMP}) AS ended, count(*) AS beats FROM n GROUP BY block, lease_no""")
def t3(spark, d):
    return store.lease_spans(S.versions(spark, d), ["block"], "ts").select("block", "lease_no", S.stamp("started").alias("started"), S.stamp("ended").alias("ended"), "beats")


@query("w24_last_ten_versions", f"WITH {S.VERSIONS} SELECT block, version, age FROM (SELECT block, version, row_number() OVER (PARTITION BY block ORDER BY ts DESC, version DESC) AS age FROM versions) WHERE age <= 10")
def w24(spark, d):
    return store.history(S.versions(spark, d), ["block"], ["ts", "version"]).select("block", "version", F.col("age").cast("long").alias("age"))


@query("w24_use_original", f"WITH {S.VERSIONS} SELECT block, version, op FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY ts, version) AS n FROM versions) WHERE n = 1")
def w24b(spark, d):
    return store.original(S.versions(spark, d), ["block"], ["ts", "version"]).select("block", "version", "op")


@query("t5_cascade_delete", f"WITH {S.NOTES}, {S.REPLIES} SELECT note, text FROM replies WHERE note IN (SELECT id FROM notes WHERE status = 'dismissed')")
def t5(spark, d):
    gone = S.notes(spark, d).where("status = 'dismissed'").withColumn("doc_id", F.lit(0))
    return store.cascade(S.replies(spark, d).withColumn("doc_id", F.lit(0)), gone).select("note", "text")


@query("t7_first_owner", f"SELECT user_id AS block, strftime(ts, {S.STAMP}) AS since, event_type AS owner FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS n FROM events) WHERE n = 1")
def t7(spark, d):
    claims = S.table(spark, d, "events").select(F.col("user_id").alias("block"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("owner"))
    return store.first_owner(claims, "block", "owner", "ts").select("block", S.stamp("ts").alias("since"), "owner")


@query("t9_author_stamping", "SELECT e.event_id, coalesce(c.c_mktsegment, '') AS author, CASE WHEN c.c_mktsegment IS NULL THEN e.user_id END AS authorId FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = e.user_id")
def t9(spark, d):
    writes = S.table(spark, d, "events").select("event_id", F.col("user_id").alias("actor"), F.lit(1).alias("session"))
    sessions = S.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("actor"), F.lit(1).alias("session"), F.col("c_mktsegment").alias("signature"))
    return store.stamped(writes, sessions).select("event_id", "author", "authorId")


@query("t10_permitted_writes", "SELECT event_id FROM events WHERE event_type <> 'view' AND (event_id % 3 = 0 OR event_id % 5 = user_id % 5)")
def t10(spark, d):
    feed = S.table(spark, d, "events").select("event_id", (F.col("event_type") != "view").alias("can_write"), (F.col("user_id") % 5).alias("actor"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5).alias("authorId"))
    return store.permitted(feed).select("event_id")


@query("k11_stale_rows", "SELECT o_orderkey FROM orders o LEFT JOIN (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 4 <> 0) p ON p.k = o.o_orderkey WHERE p.s IS DISTINCT FROM CASE WHEN o.o_orderkey % 5 = 0 THEN 'X' ELSE o.o_orderstatus END")
def k11(spark, d):
    o = S.table(spark, d, "orders")
    new = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    old = o.where("o_orderkey % 4 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return lint.stale(new, old, "o_orderkey", "v")


@query("u4_unknown_names", """WITH s AS (SELECT 'c-' || c_custkey AS skill, c_custkey AS k FROM customer), e AS (
           SELECT skill, 'error' AS level, 'unexpected keys: odd, other' AS message FROM s WHERE k % 3 = 0
           UNION ALL SELECT skill, 'error', 'name differs from the folder' FROM s WHERE k % 7 = 0
           UNION ALL SELECT skill, 'error', 'version is not semantic' FROM s WHERE k % 5 = 0
           UNION ALL SELECT skill, 'error', 'the change log has no entry for the version' FROM s WHERE k % 5 <> 0 AND k % 2 = 1
           UNION ALL SELECT skill, 'error', 'mentioned file does not exist: scripts/a.py' FROM s WHERE k % 4 = 0 AND k % 8 <> 0)
       SELECT skill, CASE WHEN count(e.level) > 0 THEN 'FAIL' ELSE 'ok' END AS state, coalesce(string_agg(e.level || ': ' || e.message, '; ' ORDER BY e.message), '') AS messages FROM s LEFT JOIN e USING (skill) GROUP BY skill""")
def u4(spark, d):
    """Customers as skills, some of which break the rules."""
    own = S.table(spark, d, "customer").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("skill"), F.col("c_custkey").alias("k"), "c_mktsegment")
    version = F.when(F.col("k") % 5 == 0, "one").otherwise(F.concat(F.lit("1.0."), (F.col("k") % 5).cast("string")))
    meta = F.create_map(F.lit("name"), F.when(F.col("k") % 7 == 0, "another").otherwise(F.col("skill")), F.lit("description"), F.col("c_mktsegment"), F.lit("version"), version)
    meta = F.when(F.col("k") % 3 == 0, F.map_concat(meta, F.create_map(F.lit("other"), F.lit("x"), F.lit("odd"), F.lit("y")))).otherwise(meta)
    skills = own.select("skill", meta.alias("meta"), F.when(F.col("k") % 4 == 0, "Use `scripts/a.py`.").otherwise("").alias("body"))
    log = own.where("k % 2 = 0").select(F.col("skill").alias("section"), version.alias("version"))
    files = own.where("k % 8 = 0").select("skill", F.lit("scripts/a.py").alias("path"))
    found = lint.lint_report(skills, lint.rule_violations(skills, log, files))
    return found.withColumn("messages", F.array_join("messages", "; "))


@query("u6_first_seen", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def u6(spark, d):
    from ..operators.anchors import first_of

    return first_of(S.table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("a12_running_activity", f"WITH {S.VERSIONS} SELECT block, version, count(*) OVER (PARTITION BY block ORDER BY version) AS seen FROM versions")
def a12_running(spark, d):
    return S.versions(spark, d).select("block", "version", F.count("*").over(Window.partitionBy("block").orderBy("version")).alias("seen"))
