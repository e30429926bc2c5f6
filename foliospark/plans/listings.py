"""Queries for lists, dashboards, access control, edits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import access, cascade, resolve, search, timeline
from foliospark.plans import relational as R
from foliospark.plans.registry import register
from foliospark.plans.relational import E, GRANTS, NOW, O, P
from foliospark.plans.sequences import gap_sql
from foliospark.session import scratch
from foliospark.sources.catalog import audit, load, pages, proceedings
from foliospark.streaming import audit as stream
from foliospark.streaming import cache


@register("QRY1", f"SELECT id, kind, day, c_name AS folder FROM {O} JOIN customer ON folder_id = c_custkey WHERE kind ILIKE '%urgent%' AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' ORDER BY day, id LIMIT 50 OFFSET 50")
def qry1(spark, d):
    rows = proceedings(spark, d).where(T.like_ci("kind", "urgent") & F.col("day").between("1996-01-01", "1998-12-31"))
    named = rows.join(load(spark, d, "customer"), F.col("folder_id") == F.col("c_custkey"))
    return search.top(named.select("id", "kind", "day", F.col("c_name").alias("folder")), 50, F.col("day"), F.col("id"), skip=50)


@register("QRY2", "SELECT c_custkey, c_name, count(o_orderkey) AS mentions FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_name ILIKE '%1%' GROUP BY ALL ORDER BY mentions DESC, c_custkey LIMIT 30")
def qry2(spark, d):
    c = load(spark, d, "customer").where(T.like_ci("c_name", "1"))
    n = c.join(load(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("mentions"))
    return search.top(n, 30, F.col("mentions").desc(), F.col("c_custkey"))


@register("QRY3", f"SELECT id, day FROM {O} WHERE folder_id = 7 ORDER BY day, id")
def qry3(spark, d):
    return proceedings(spark, d).where("folder_id = 7").select("id", "day").orderBy("day", "id")


@register("QRY4", "SELECT p_type AS place, count(*) AS frequency FROM part WHERE p_type ILIKE '%e%' OR p_brand ILIKE '%1%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def qry4(spark, d):
    p = load(spark, d, "part").where(T.any_of([T.like_ci("p_type", "e"), T.like_ci("p_brand", "1")]))
    return search.top(p.groupBy(F.col("p_type").alias("place")).agg(F.count("*").alias("frequency")), 20, F.col("frequency").desc(), F.col("place"))


@register("QRY5", f"SELECT id, day, kind FROM {O} WHERE (verified OR kind ILIKE '%high%') AND day >= DATE '2000-01-01'")
def qry5(spark, d):
    return proceedings(spark, d).where((F.col("verified") | T.like_ci("kind", "high")) & (F.col("day") >= "2000-01-01")).select("id", "day", "kind")


@register("QRY6", f"SELECT priority, count(*) AS n, max(days) AS longest FROM ({gap_sql('days >= 180 AND days <= 1825')}) GROUP BY priority")
def qry6(spark, d):
    return timeline.gaps(proceedings(spark, d)).groupBy("priority").agg(F.count("*").alias("n"), F.max("days").alias("longest"))


@register("QRY7", f"SELECT folder_id, count(*) AS n, count_if(verified)::BIGINT AS verified, count(DISTINCT kind) AS kinds, min(day) AS first_day, max(day) AS last_day, arg_max(kind, (day, id)) AS last_kind, arg_min(kind, (day, id)) AS first_kind FROM {O} GROUP BY folder_id")
def qry7(spark, d):
    at = F.struct("day", "id")
    return proceedings(spark, d).groupBy("folder_id").agg(F.count("*").alias("n"), F.count_if("verified").alias("verified"), F.countDistinct("kind").alias("kinds"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max_by("kind", at).alias("last_kind"), F.min_by("kind", at).alias("first_kind"))


@register("QRY8", f"SELECT id, day, kind || ' (' || folder_id || ')' AS title FROM {O} WHERE day IS NOT NULL")
def qry8(spark, d):
    return proceedings(spark, d).where("day IS NOT NULL").select("id", "day", F.format_string("%s (%d)", "kind", "folder_id").alias("title"))


@register("QRY9", f"SELECT c_custkey, coalesce(n, 0) AS n, last_day FROM customer LEFT JOIN (SELECT folder_id, count(*) AS n, max(day) AS last_day FROM {O} GROUP BY 1) ON folder_id = c_custkey")
def qry9(spark, d):
    s = timeline.folder_statistics(proceedings(spark, d)).select("folder_id", "n", "last_day")
    return load(spark, d, "customer").join(s, F.col("folder_id") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "last_day")


@register("QRY10", "SELECT c_custkey, CASE WHEN n IS NULL THEN 'empty' WHEN n_open = 0 THEN 'done' ELSE 'open' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus <> 'F') AS n_open FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def qry10(spark, d):
    s = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "F").alias("n_open"))
    return load(spark, d, "customer").join(s, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.when(F.col("n").isNull(), "empty").when(F.col("n_open") == 0, "done").otherwise("open").alias("status"))


@register("QRY11", "SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_name ILIKE '%1%' GROUP BY n_name")
def qry11(spark, d):
    n = load(spark, d, "nation").where(T.like_ci("n_name", "1"))
    return n.join(load(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


@register("QRY12", f"SELECT id, ts, action, coalesce(c_name, '-') AS who FROM {E} LEFT JOIN customer ON user_id = c_custkey WHERE action LIKE 's%' AND ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, id LIMIT 100")
def qry12(spark, d):
    rows = audit(spark, d).where(F.col("action").like("s%") & (F.col("ts") >= "2024-01-20")).join(load(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    return search.top(rows.select("id", "ts", "action", F.coalesce("c_name", F.lit("-")).alias("who")), 100, F.col("ts").desc(), F.col("id"))


@register("QRY13", f"SELECT DISTINCT user_id, c_name FROM {E} JOIN customer ON user_id = c_custkey WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def qry13(spark, d):
    recent = audit(spark, d).where(F.col("ts") >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 7 DAYS")).select("user_id").distinct()
    return recent.join(load(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("user_id", "c_name")


@register("QRY13_kpis", f"SELECT count(*) AS total, count(DISTINCT user_id) AS users, count_if(action IN ('error', 'signup'))::BIGINT AS critical, count_if(ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY)::BIGINT AS last_day, count_if(ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)::BIGINT AS last_week, arg_max(action, (n, action)) AS commonest FROM {E} JOIN (SELECT action, count(*) AS n FROM {E} GROUP BY 1) USING (action)")
def qry13_kpis(spark, d):
    since = lambda days: F.count_if(F.col("ts") >= F.lit(NOW).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    a = audit(spark, d)
    most = a.groupBy("action").count().agg(F.max_by("action", F.struct("count", "action")))
    return a.agg(
        F.count("*").alias("total"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("action").isin("error", "signup")).alias("critical"), since(1).alias("last_day"),
        since(7).alias("last_week"),
    ).withColumn("commonest", most.scalar())


@register("QRY14", f"SELECT user_id, count(*) AS n FROM {E} WHERE action IN ('error', 'signup') GROUP BY user_id")
def qry14(spark, d):
    return audit(spark, d).where(F.col("action").isin("error", "signup")).groupBy("user_id").agg(F.count("*").alias("n"))


@register("QRY15", f"SELECT folder_id, string_agg(user_id, ',' ORDER BY user_id) AS users FROM {GRANTS} WHERE can_search GROUP BY folder_id")
def qry15(spark, d):
    g = R.grants(spark, d).where("can_search")
    return g.groupBy("folder_id").agg(F.array_join(F.array_sort(F.collect_list("user_id")), ",").alias("users"))


@register("QRY16", f"SELECT id, ts FROM {E} WHERE action = 'signup' AND user_id = 5 ORDER BY ts DESC, id LIMIT 10")
def qry16(spark, d):
    return search.top(audit(spark, d).where("action = 'signup' AND user_id = 5").select("id", "ts"), 10, F.col("ts").desc(), F.col("id"))


@register("QRY17", f"SELECT page_id, substr(text, 1, 500) AS preview FROM {P} WHERE engine <> 'en'")
def qry17(spark, d):
    return pages(spark, d).where("engine <> 'en'").select("page_id", F.substring("text", 1, 500).alias("preview"))


@register("QRY18", "SELECT conv_id, count(*) AS n_pages, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def qry18(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("chars"))


@register("QRY19", f"SELECT id, other FROM (SELECT a.id, b.id AS other FROM {R._PLACED} a JOIN {R._PLACED} b ON a.folder_id = b.folder_id AND a.id < b.id AND ((a.kind = b.kind AND a.day = b.day) OR a.place = b.place)) ORDER BY id, other LIMIT 10")
def qry19(spark, d):
    return search.top(R.jn10(spark, d), 10, F.col("id"), F.col("other"))


# access


def _visible(key: str, where: str, **options) -> None:
    @register(key, f"SELECT n_nationkey AS folder_id FROM nation WHERE {where}")
    def query(spark, d):
        rows = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("folder_id"))
        g = R.grants(spark, d).withColumns({"folder_id": F.col("folder_id").cast("long"), "user_id": F.col("user_id") % 20})
        return access.visible(rows, g, 3, "folder_id", **options)


_MINE = f"n_nationkey IN (SELECT folder_id FROM {GRANTS} WHERE user_id % 20 = 3"
_visible("ACL1", "true", role="Admin")
_visible("ACL2", _MINE + ")", role="analyst")
_visible("ACL3", _MINE + " AND can_search)", flag="can_search")
_visible("ACL4", _MINE + f" AND (ends IS NULL OR ends >= TIMESTAMP '{NOW}'))", now=NOW)


@register("ACL5", "SELECT c_custkey, coalesce(c_custkey % 5 IN (1, 2), false) AS allowed FROM customer")
def acl5(spark, d):
    level = F.element_at(F.array(*[F.lit(x).cast("string") for x in ("read", "write", "admin", "none", None)]), (F.col("c_custkey") % 5).cast("int") + 1)
    return load(spark, d, "customer").select("c_custkey", access.at_least(level, "write").alias("allowed"))


@register("ACL6", f"SELECT user_id FROM {GRANTS} WHERE can_search")
def acl6(spark, d):
    return access.without_empty(R.grants(spark, d), ["can_search"]).select("user_id")


# edits


@register("DML1", "SELECT c_custkey, CASE WHEN c_custkey % 100 = 0 THEN 'EDITED' ELSE c_name END AS c_name FROM customer")
def dml1(spark, d):
    c = load(spark, d, "customer", "c_custkey", "c_name")
    return resolve.edited(c, c.where("c_custkey % 100 = 0").select("c_custkey", F.lit("EDITED").alias("c_name")), "c_custkey", ["c_name"])


_TREE = """(SELECT 'region ' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation
    UNION ALL SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer UNION ALL SELECT 'order ' || o_orderkey, 'customer ' || o_custkey FROM orders)"""
#: A region, and customers that owe much.
_GONE = f"""WITH RECURSIVE t AS {_TREE}, gone(node, depth) AS (SELECT node, 0 FROM t WHERE node = 'region 1' OR node IN (SELECT 'customer ' || c_custkey FROM customer WHERE c_acctbal < -900)
    UNION SELECT t.node, depth + 1 FROM gone JOIN t ON t.parent = gone.node)"""


def _tree(spark, d):
    """Regions, nations, customers and orders as folders, volumes, pages and entities of one tree."""
    kinds = (("region", "r_regionkey", None, None), ("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey"))
    name = lambda kind, c: F.concat(F.lit(f"{kind.removesuffix('s')} "), F.col(c).cast("string"))
    each = [load(spark, d, t).select(name(t, k).alias("node"), (name(p, pk) if p else F.lit(None).cast("string")).alias("parent")) for t, k, p, pk in kinds]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def _gone(spark, d):
    poor = load(spark, d, "customer").where("c_acctbal < -900").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("node"))
    return cascade.below(poor.unionByName(spark.range(1).select(F.lit("region 1").alias("node"))), _tree(spark, d))


@register("DML2", f"{_GONE} SELECT node, parent FROM t WHERE node NOT IN (SELECT node FROM gone)")
def dml2(spark, d):
    """What stays when a delete goes down to all levels."""
    return cascade.deleted(_tree(spark, d), _gone(spark, d), "node")


@register("DML2_soft", f"{_GONE} SELECT node, min(depth)::INT AS depth, TIMESTAMP '2024-06-01' AS deleted_at FROM gone GROUP BY node")
def dml2_soft(spark, d):
    """What a soft delete marks, and how far below the row that was deleted it is."""
    gone = _gone(spark, d)
    rows = cascade.marked(_tree(spark, d), gone, "node", F.lit("2024-06-01").cast("timestamp"))
    return rows.where("deleted_at IS NOT NULL").join(gone, "node").select("node", "depth", "deleted_at")


# streams: STM1 to STM4 and STM6 run as such over the files of the log, and give what has landed; STM5 shows the batch form


def _log(spark, d):
    names = {"event_id": "id", "event_type": "action"}
    log = stream.table_stream(spark, f"{d}/events.parquet").withColumnsRenamed(names)
    return log.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark wants an instant


@register("STM1", f"SELECT count(*) AS rows FROM {E}")
def stm1(spark, d):
    """How far a copy of the log has come: the rows that its batches have read."""
    return stream.landed(_log(spark, d).groupBy().agg(F.count("*").alias("rows")), scratch(spark, "stm1"), "complete")


@register("STM2", f"SELECT user_id, least(count(*), 3)::BIGINT AS tries, CASE WHEN count(*) >= 3 THEN 'failed' ELSE 'waiting' END AS state FROM {E} WHERE action = 'error' GROUP BY user_id")
def stm2(spark, d):
    """A user's errors as attempts of one job, which fails at the third."""
    tries = stream.retried(_log(spark, d).where("action = 'error'").select(F.col("user_id").alias("job"), F.lit(False).alias("ok")))
    last = stream.landed(tries, scratch(spark, "stm2"), "update").groupBy("job").agg(F.max("tries").cast("long").alias("tries"), F.max_by("state", "batch").alias("state"))
    return last.withColumnRenamed("job", "user_id")


@register("STM3", f"SELECT DISTINCT user_id, action FROM {E}")
def stm3(spark, d):
    once = stream.first_jobs(_log(spark, d).select("ts", "user_id", "action"), "user_id", "action", late="31 days").select("user_id", "action")
    return stream.landed(once, scratch(spark, "stm3"))


@register("STM4", f"SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM {E} GROUP BY 1")
def stm4(spark, d):
    return stream.landed(stream.windowed(_log(spark, d), by=None).drop("users"), scratch(spark, "stm4"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("STM5", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, action, count(*) AS n FROM {E} GROUP BY ALL")
def stm5(spark, d):
    return stream.windowed(audit(spark, d)).drop("users")


@register("STM5_sessions", f"""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id) AS s
    FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM {E})) GROUP BY user_id, s""")
def stm5_sessions(spark, d):
    return stream.sessions(audit(spark, d))


@register("STM5_bursts", f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, user_id, count(*) AS n FROM {E} WHERE action = 'error' GROUP BY ALL HAVING count(*) >= 2")
def stm5_bursts(spark, d):
    return stream.bursts(audit(spark, d), "error", "1 day", 2)


@register("STM6", f"SELECT user_id::VARCHAR AS source, max(ts) AS last FROM {E} GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-29'")
def stm6(spark, d):
    beats = _log(spark, d).select(F.col("user_id").cast("string").alias("source"), "ts")
    return stream.landed(stream.stale(beats, "2024-01-29", 0), scratch(spark, "stm6"), "complete").withColumn("last", F.col("last").cast("timestamp_ntz"))


@register("STM7", f"""SELECT id, CASE WHEN action = 'signup' THEN 'stored' WHEN epoch_ms(ts) - epoch_ms(put) < 604800000 THEN 'hit' ELSE 'miss' END AS outcome,
    CASE WHEN action = 'signup' OR epoch_ms(ts) - epoch_ms(put) < 604800000 THEN held END AS value FROM (SELECT id, ts, action, last_value(CASE WHEN action = 'signup' THEN ts END IGNORE NULLS) OVER w AS put,
    last_value(CASE WHEN action = 'signup' THEN id::VARCHAR END IGNORE NULLS) OVER w AS held FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), id))""")
def stm7(spark, d):
    """A user's sign-ups are kept for a week, and other events ask for the last one."""
    asked = _log(spark, d).select(F.col("user_id").cast("string").alias("key"), "id", "ts", F.when(F.col("action") == "signup", F.col("id").cast("string")).alias("value"))
    return stream.landed(cache.cached(asked, 604_800), scratch(spark, "stm7")).where("outcome <> 'expired'").select("id", "outcome", "value")


@register("STM8", f"SELECT id, action FROM {E}")
def stm8(spark, d):
    """The log is copied, stopped as soon as may be, and taken up again until all has come: each row is there once."""
    rows, path = _log(spark, d).select("id", "action"), scratch(spark, "stm8")
    stream.landed_while(rows, path, lambda done: False)
    return stream.landed(rows, path)
