"""Queries for sources, sinks, filters, joins, aggregates, windows, paging and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import dates
from foliospark.functions import text as T
from foliospark.operators import access, fulltext, likeness, resolve, search, timeline
from foliospark.plans.registry import register
from foliospark.session import scratch
from foliospark.sources import catalog, sinks
from foliospark.sources.catalog import audit, load, pages, proceedings

P = "(SELECT doc_id AS page_id, source AS folder, lang AS engine, text, ((doc_id * 37) % 101)::DOUBLE AS confidence FROM documents) p"
O = "(SELECT o_orderkey AS id, o_custkey AS folder_id, o_orderpriority AS kind, o_orderdate::DATE AS day, o_totalprice AS amount, o_orderstatus = 'F' AS verified FROM orders) o"
E = "(SELECT event_id AS id, ts, user_id, event_type AS action, value, props FROM events) e"
NOW = "2024-01-31"

# sources


@register("SRC1", "SELECT * FROM nation")
def src1(spark, d):
    return load(spark, d, "nation")


@register("SRC2", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 7 LIMIT 1")
def src2(spark, d):
    return load(spark, d, "documents").where("doc_id = 7").select("doc_id", "lang", "source").limit(1)


@register("SRC3", "SELECT doc_id AS page, source AS folder FROM documents")
def src3(spark, d):
    return load(spark, d, "documents", F.col("doc_id").alias("page"), F.col("source").alias("folder"))


@register("SRC6", "SELECT event_id AS id, (props->>'$.k')::BIGINT AS k FROM events")
def src6(spark, d):
    return audit(spark, d).select("id", F.from_json("props", "k long")["k"].alias("k"))


PRIORITIES = [("1-URGENT", "urgent", 1), ("2-HIGH", "high", 2), ("3-MEDIUM", "medium", 3), ("4-NOT SPECIFIED", "none", 4), ("5-LOW", "low", 5)]
_V = "(VALUES ('1-URGENT', 'urgent', 1), ('2-HIGH', 'high', 2), ('3-MEDIUM', 'medium', 3), ('4-NOT SPECIFIED', 'none', 4), ('5-LOW', 'low', 5)) v(variant, canonical, rank)"


def priorities(spark):
    return catalog.lookup(spark, PRIORITIES, "variant string, canonical string, rank int")


@register("SRC7", f"SELECT canonical, rank, count(*) AS n FROM orders JOIN {_V} ON o_orderpriority = variant GROUP BY ALL")
def src7(spark, d):
    return load(spark, d, "orders", F.col("o_orderpriority").alias("variant")).join(priorities(spark), "variant").groupBy("canonical", "rank").agg(F.count("*").alias("n"))


@register("SRC8", "SELECT s_suppkey AS id, coalesce(n_name, 'unknown') AS place FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def src8(spark, d):
    known = load(spark, d, "nation").where("n_regionkey < 3")
    return load(spark, d, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("id"), F.coalesce("n_name", F.lit("unknown")).alias("place"))


@register("SRC9", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def src9(spark, d):
    return catalog.assemble(load(spark, d, "conversations"), "conv_id", "turn", "text")


@register("SRC10")
def src10(spark, d):
    return catalog.file_listing(spark, d, "*.parquet")


# sinks: written below the shared folder and read again


@register("SNK1", f"SELECT coalesce(id::VARCHAR, '-') AS id, coalesce(action, '-') AS action, coalesce(props, '-') AS props FROM {E}")
def snk1(spark, d):
    return sinks.exported(sinks.export_rows(audit(spark, d).select("id", "action", "props")), scratch(spark, "export") + "/csv")


@register("SNK2", f"SELECT page_id::VARCHAR AS page_id, folder FROM {P} WHERE contains(lower(text), 'an') ORDER BY p.page_id LIMIT 10000")
def snk2(spark, d):
    found = pages(spark, d).where(T.contains_ci("text", "an")).orderBy("page_id").limit(10_000).select("page_id", "folder")
    return sinks.exported(sinks.export_rows(found), scratch(spark, "export") + "/csv")


@register("SNK3", f"""SELECT 'info' AS sheet, NULL AS folder, NULL AS page_id, count(DISTINCT folder)::VARCHAR AS preview, count(*) AS rank FROM {P}
    UNION ALL SELECT 'volumes', folder, NULL, NULL, count(*) FROM {P} GROUP BY folder
    UNION ALL SELECT 'pages', folder, page_id, substr(text, 1, 100), k FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY page_id) AS k FROM {P}) WHERE k <= 10""")
def snk3(spark, d):
    """Three sheets: the counts of volumes and pages, the pages of each volume, the start of each volume's first ten pages."""
    p, no = pages(spark, d), lambda kind: F.lit(None).cast(kind)
    info = p.agg(F.countDistinct("folder").cast("string").alias("preview"), F.count("*").alias("rank")).select(F.lit("info").alias("sheet"), no("string").alias("folder"), no("long").alias("page_id"), "preview", "rank")
    volumes = p.groupBy("folder").agg(F.count("*").alias("rank")).select(F.lit("volumes").alias("sheet"), "folder", no("long").alias("page_id"), no("string").alias("preview"), "rank")
    first = search.first_per_group(p, 10, ["folder"], F.col("page_id"))
    first = first.select(F.lit("pages").alias("sheet"), "folder", "page_id", F.substring("text", 1, 100).alias("preview"), F.col("rank").cast("long"))
    path = scratch(spark, "workbook") + "/sheets"
    info.unionByName(volumes).unionByName(first).write.partitionBy("sheet").parquet(path)
    return spark.read.parquet(path)


@register("SNK4", f"SELECT kind, count(*) AS n FROM {O} GROUP BY kind")
def snk4(spark, d):
    return proceedings(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@register("SNK5", f"SELECT engine, CASE WHEN confidence >= 50 THEN 'high' ELSE 'low' END AS band, count(*) AS n FROM {P} GROUP BY ALL")
def snk5(spark, d):
    return pages(spark, d).groupBy("engine", F.when(F.col("confidence") >= 50, "high").otherwise("low").alias("band")).agg(F.count("*").alias("n"))


@register("SNK6", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name FROM nation")
def snk6(spark, d):
    old = load(spark, d, "nation", "n_nationkey", "n_name")
    return sinks.upserted(old, old.where("n_nationkey < 5").withColumn("n_name", F.lit("new")), ["n_nationkey"])


@register("SNK7", f"SELECT id, folder_id FROM {O} WHERE folder_id >= 100 UNION ALL SELECT -folder_id, folder_id FROM {O} WHERE folder_id < 100 GROUP BY folder_id")
def snk7(spark, d):
    rows = proceedings(spark, d).select("id", "folder_id")
    new = rows.where("folder_id < 100").select((-F.col("folder_id")).alias("id"), "folder_id").distinct()
    return sinks.upserted(rows, new, ["folder_id"])


_TOK = "(SELECT page_id, unnest(string_split_regex(translate(lower(text), 'áéíóúàèìòùäëïöüâêîôûñç', 'aeiouaeiouaeiouaeiounc'), '[^\\p{L}\\p{N}]+')) AS token FROM " + P + ") t"


@register("SNK8", f"SELECT token, page_id, count(*) AS tf FROM {_TOK} WHERE token <> '' GROUP BY ALL")
def snk8(spark, d):
    return fulltext.postings(pages(spark, d))


@register("SNK9", f"SELECT id, action, '***' AS password, (props->>'$.k') AS k FROM {E}")
def snk9(spark, d):
    """Sign-ups are appended to a log of the other actions; the values of secret keys are masked before they are written."""
    given = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("password"), F.col("user_id").cast("string")))
    masked = T.masked_keys(given)
    rows = audit(spark, d).select("id", "action", masked["password"].alias("password"), F.try_element_at(masked, F.lit("k")).alias("k"))
    path = scratch(spark, "log") + "/rows"
    sinks.appended(rows.where("action <> 'signup'"), path)
    return sinks.appended(rows.where("action = 'signup'"), path)


@register("SNK10", """SELECT id, category, result FROM (SELECT o_orderkey AS id, unnest(['kind', 'state']) AS category,
    unnest(['{"value":"' || o_orderpriority || '"}', '{"value":"' || o_orderstatus || '"}']) AS result FROM orders)""")
def snk10(spark, d):
    return sinks.as_categories(load(spark, d, "orders", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("state")), "id", ["kind", "state"])


# filters

def _filter(key: str, where: str, condition) -> None:
    @register(key, f"SELECT page_id FROM {P} WHERE {where}")
    def query(spark, d):
        return pages(spark, d).where(condition() if callable(condition) else condition).select("page_id")


def _orders(key: str, where: str, condition) -> None:
    @register(key, f"SELECT id FROM {O} WHERE {where}")
    def query(spark, d):
        return proceedings(spark, d).where(condition()).select("id")


def _events(key: str, where: str, condition) -> None:
    @register(key, f"SELECT id FROM {E} WHERE {where}")
    def query(spark, d):
        return audit(spark, d).where(condition()).select("id")


_filter("FLT1", "contains(text, 'The ')", lambda: F.col("text").contains("The "))
_filter("FLT2", "text ILIKE '%con%'", lambda: T.like_ci("text", "con"))
_filter("FLT3", "contains(lower(text), 'que')", lambda: T.contains_ci("text", "QUE"))
_filter("FLT4", "text ILIKE '%tion%' OR folder ILIKE '%src1%'", lambda: T.any_of([T.like_ci("text", "tion"), T.like_ci("folder", "src1")]))
_filter("FLT5", "(contains(lower(text), 'the') AND contains(lower(text), 'ing')) AND contains(lower(text), 'of the') AND NOT contains(lower(text), 'idiot')", lambda: T.boolean_match("text", ["the", "ing"], "AND", "of the", ("idiot",)))
_filter("FLT6", "contains(lower(text), 'der') OR contains(lower(text), 'que')", lambda: T.any_of([T.contains_ci("text", t) for t in ("der", "que")]))
_filter("FLT7", "NOT regexp_matches(lower(text), '(idiot|clown|spam)') AND length(text) >= 200", lambda: ~F.lower("text").rlike("(idiot|clown|spam)") & (F.length("text") >= 200))
_orders("FLT8", "verified AND kind = '1-URGENT'", lambda: F.col("verified") & (F.col("kind") == "1-URGENT"))
_orders("FLT9", "day >= DATE '1996-01-01' AND day < DATE '1997-01-01'", lambda: F.col("day").between(F.try_to_date(F.lit("1996-01-01")), F.try_to_date(F.lit("1996-12-31"))))
_events("FLT10", f"ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{NOW}' + INTERVAL 1 DAY", lambda: (F.col("ts") >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < F.lit(NOW).cast("timestamp") + F.expr("INTERVAL 1 DAY")))
_filter("FLT11", "confidence >= 60 AND page_id BETWEEN 10 AND 500", lambda: (F.col("confidence") >= 60) & F.col("page_id").between(10, 500))
_filter("FLT12", "folder IN ('src1', 'src2')", lambda: F.col("folder").isin("src1", "src2"))
_events("FLT15", "props IS NOT NULL AND props <> '{}'", lambda: F.col("props").isNotNull() & (F.col("props") != "{}"))
_filter("FLT17", "regexp_matches(text, '[0-9]{3,}')", lambda: F.col("text").rlike("[0-9]{3,}"))
_filter("FLT18", "length(text) < 100", lambda: F.length("text") < 100)
_orders("FLT19", "NOT day BETWEEN DATE '1995-06-01' AND DATE '2000-12-31'", lambda: ~F.col("day").between("1995-06-01", "2000-12-31"))
_orders("FLT20", "amount < 50000 AND NOT verified", lambda: (F.col("amount") < 50000) & ~F.col("verified"))
_events("FLT21", "action LIKE 's%' OR props LIKE '%1%'", lambda: F.col("action").like("s%") | F.col("props").contains("1"))
_events("FLT22", "coalesce((props->>'$.k')::BIGINT = 5, false)", lambda: F.coalesce(F.get_json_object("props", "$.k") == "5", F.lit(False)))
_orders("FLT24", "day BETWEEN DATE '1990-01-01' AND DATE '1997-12-31'", lambda: dates.plausible("day", "1996-05-05"))


@register("FLT13", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def flt13(spark, d):
    return load(spark, d, "documents", "doc_id").join(load(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@register("FLT14", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def flt14(spark, d):
    big = load(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer", "c_custkey").join(big, "c_custkey", "left_semi")


GRANTS = "(SELECT c_custkey AS user_id, c_nationkey AS folder_id, c_acctbal > 0 AS can_search, TIMESTAMP '2024-01-01' AS starts, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-15' END AS ends FROM customer) g"


def grants(spark, d):
    ends = F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-01-15").cast("timestamp"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("folder_id"), (F.col("c_acctbal") > 0).alias("can_search"), F.lit("2024-01-01").cast("timestamp").alias("starts"), ends.alias("ends"))


@register("FLT16", f"SELECT user_id FROM {GRANTS} WHERE ends IS NULL OR ends >= TIMESTAMP '{NOW}'")
def flt16(spark, d):
    return grants(spark, d).where(access.open_at(F.col("starts"), F.col("ends"), NOW)).select("user_id")


@register("FLT23", f"SELECT page_id FROM {P} WHERE contains(lower(text), 'the')")
def flt23(spark, d):
    return pages(spark, d).where(T.contains_ci("text", search.require(" the "))).select("page_id")


# joins

@register("JN1", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jn1(spark, d):
    return load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@register("JN2", "SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def jn2(spark, d):
    head = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return load(spark, d, "lineitem").join(head, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "c_name")


@register("JN3", "SELECT l_orderkey, l_linenumber, p_name AS part, s_name AS supplier FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def jn3(spark, d):
    return (
        load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "l_linenumber", F.col("p_name").alias("part"), F.col("s_name").alias("supplier"))
    )


@register("JN4", f"SELECT c_custkey, o_orderkey, n_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN {GRANTS} ON g.folder_id = n_nationkey AND g.user_id = 1 AND g.can_search")
def jn4(spark, d):
    folders = access.visible(load(spark, d, "nation").withColumn("folder_id", F.col("n_nationkey")), grants(spark, d), 1, "folder_id", flag="can_search")
    c = load(spark, d, "customer").join(folders, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(load(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "n_name")


@register("JN5", f"SELECT id, coalesce(c_name, '-') AS who FROM {E} LEFT JOIN customer ON user_id = c_custkey")
def jn5(spark, d):
    return audit(spark, d).join(load(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left").select("id", F.coalesce("c_name", F.lit("-")).alias("who"))


@register("JN6", f"SELECT c_custkey, id FROM customer LEFT JOIN {E} ON user_id = c_custkey WHERE action = 'error'")
def jn6(spark, d):
    return load(spark, d, "customer").join(audit(spark, d), F.col("user_id") == F.col("c_custkey"), "left").where("action = 'error'").select("c_custkey", "id")


@register("JN7", f"SELECT page_id FROM {P} WHERE folder IN (SELECT source FROM documents GROUP BY source HAVING count(*) > 10)")
def jn7(spark, d):
    allowed = resolve.repeated(pages(spark, d), ["folder"], 11).select("folder")
    return pages(spark, d).select("page_id", "folder").join(allowed, "folder", "left_semi").select("page_id")


@register("JN8", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def jn8(spark, d):
    nation = load(spark, d, "nation", "n_nationkey", "n_regionkey")
    keys = [nation.where("n_regionkey = 1"), load(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")), load(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))]
    return nation.select("n_nationkey").join(access.granted_by_any(keys, "n_nationkey"), "n_nationkey", "left_semi")


@register("JN9", "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def jn9(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))


_PLACED = f"(SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY day, id) AS place FROM {O})"


@register("JN10", f"SELECT a.id, b.id AS other FROM {_PLACED} a JOIN {_PLACED} b ON a.folder_id = b.folder_id AND a.id < b.id AND ((a.kind = b.kind AND a.day = b.day) OR a.place = b.place)")
def jn10(spark, d):
    return resolve.possible_duplicates(timeline.enumerated(proceedings(spark, d)))


@register("JN11")
def jn11(spark, d):
    c = load(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_name")
    return likeness.like_pairs(c, ["p_brand"], "p_name", 0.85)


@register("JN12", "SELECT n_nationkey, n_name, coalesce(n, 0) AS n_customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def jn12(spark, d):
    n = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return load(spark, d, "nation").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n_customers"))


_OFF = "(SELECT conv_id, turn AS page, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations)"


def _offsets(spark, d):
    return timeline.offsets(load(spark, d, "conversations"), "conv_id", "turn", "text").withColumnRenamed("turn", "page")


@register("JN13", f"SELECT conv_id, position, max(page) AS page FROM (SELECT conv_id, unnest(range(0, n, 250)) AS position FROM (SELECT conv_id, sum(length(text) + 2)::BIGINT AS n FROM conversations GROUP BY conv_id)) q JOIN {_OFF} o USING (conv_id) WHERE o.start <= position GROUP BY ALL")
def jn13(spark, d):
    """The page at each 250th position of a whole conversation."""
    size = load(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text") + 2).alias("n"))
    at = size.select("conv_id", F.explode(F.expr("sequence(0L, n - 1, 250L)")).alias("position"))
    return timeline.page_of(at, _offsets(spark, d), "conv_id")


@register("JN14", """SELECT conv_id, turn, arg_max(mark, pos) AS mark FROM (SELECT c.conv_id, c.turn, m.turn AS pos, m.role || ' ' || m.turn AS mark FROM conversations c LEFT JOIN conversations m ON m.conv_id = c.conv_id AND m.turn <= c.turn AND m.role = 'user') GROUP BY ALL""")
def jn14(spark, d):
    """The last mark (here: a user's turn) at or before each row of its conversation."""
    mark = F.when(F.col("role") == "user", F.concat_ws(" ", "role", F.col("turn").cast("string")))
    return timeline.last_mark(load(spark, d, "conversations").withColumn("mark", mark), "conv_id", "turn", "mark").select("conv_id", "turn", "mark")


_Q64 = [round((i % 7 - 3) / 4, 2) for i in range(64)]
_COS = f"coalesce(list_cosine_similarity(embedding::DOUBLE[], {_Q64}::DOUBLE[]), 0)"


@register("JN15", f"SELECT vec_id, round({_COS}, 6) AS similarity FROM embeddings")
def jn15(spark, d):
    from foliospark.operators.vectors import similar

    return similar(load(spark, d, "embeddings"), _Q64, -1.0, None)


@register("JN16", f"SELECT o_orderkey, coalesce(canonical, o_orderpriority) AS canonical FROM orders LEFT JOIN {_V} ON lower(trim(o_orderpriority)) = lower(variant)")
def jn16(spark, d):
    from foliospark.operators.correct import canonical

    return canonical(load(spark, d, "orders", "o_orderkey", "o_orderpriority"), "o_orderpriority", priorities(spark)).select("o_orderkey", "canonical")


@register("JN17", """SELECT page_id, canonical FROM (SELECT page_id, canonical, row_number() OVER (PARTITION BY page_id ORDER BY priority, length(term) DESC, term) AS k
    FROM (SELECT doc_id AS page_id, upper(text) AS t FROM documents) JOIN (VALUES ('IDIOT', 'insult', 1), ('CLOWN', 'insult', 2), ('LICENSE', 'legal', 3)) c(term, canonical, priority) ON contains(t, term)) WHERE k = 1""")
def jn17(spark, d):
    from foliospark.operators.automaton import contained

    terms = catalog.lookup(spark, [("IDIOT", "insult", 1), ("CLOWN", "insult", 2), ("LICENSE", "legal", 3)], "term string, canonical string, priority int")
    return contained(pages(spark, d), "text", terms, "page_id")


# aggregates

def _agg(key: str, sql: str, source, keys: list, *aggs) -> None:
    @register(key, sql)
    def query(spark, d):
        return source(spark, d).groupBy(*keys).agg(*[a() for a in aggs])


_agg("AGG1", f"SELECT count(*) AS n FROM {P}", pages, [], lambda: F.count("*").alias("n"))
_agg("AGG2", f"SELECT kind, count(*) AS n FROM {O} GROUP BY kind", proceedings, ["kind"], lambda: F.count("*").alias("n"))
_agg("AGG3", f"SELECT engine, round(avg(confidence), 2) AS mean FROM {P} GROUP BY engine", pages, ["engine"], lambda: F.round(F.avg("confidence"), 2).alias("mean"))
_agg("AGG4", f"SELECT folder_id, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM {O} GROUP BY folder_id", proceedings, ["folder_id"], lambda: F.count("*").alias("n"), lambda: F.min("day").alias("first_day"), lambda: F.max("day").alias("last_day"))


@register("AGG5", f"""SELECT folder_id, count(*) AS n, min(day) AS first_day, max(day) AS last_day, max(day) - min(day) AS span_days,
    CASE WHEN count(day) > 1 THEN round((max(day) - min(day))::DOUBLE / (count(day) - 1), 4) END AS mean_gap, count_if(verified)::BIGINT AS n_verified, round(100.0 * count_if(verified) / count(*), 2)::DOUBLE AS verified_pct FROM {O} GROUP BY folder_id""")
def agg5(spark, d):
    return timeline.folder_statistics(proceedings(spark, d)).withColumn("verified_pct", F.col("verified_pct").cast("double"))


@register("AGG6", f"SELECT folder, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars, (SELECT count(*) FROM documents) AS total FROM {P} GROUP BY folder")
def agg6(spark, d):
    g = pages(spark, d).groupBy("folder").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))
    return g.withColumn("total", g.agg(F.sum("n_pages")).scalar())


@register("AGG7", "SELECT text_hash, count FROM (SELECT md5(text) AS text_hash, count(*) AS count FROM documents GROUP BY 1) WHERE count > 1")
def agg7(spark, d):
    return resolve.repeated(load(spark, d, "documents").select(F.md5("text").alias("text_hash")), ["text_hash"])


_agg("AGG8", f"SELECT folder_id, count(*) AS n, min(id) AS low, max(id) AS high FROM {O} GROUP BY folder_id", proceedings, ["folder_id"], lambda: F.count("*").alias("n"), lambda: F.min("id").alias("low"), lambda: F.max("id").alias("high"))


@register("AGG9", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_name) AS names, count(*) AS n FROM customer GROUP BY c_mktsegment")
def agg9(spark, d):
    return load(spark, d, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"), F.countDistinct("c_name").alias("names"), F.count("*").alias("n"))


@register("AGG10", "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg10(spark, d):
    return load(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


@register("AGG11", f"SELECT action, count(*) AS mentions, count(DISTINCT user_id) AS users, count_if(value > 50)::BIGINT AS high FROM {E} GROUP BY action HAVING count(*) > 1")
def agg11(spark, d):
    return audit(spark, d).groupBy("action").agg(F.count("*").alias("mentions"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high")).where("mentions > 1")


_BAND = "CASE WHEN confidence >= 90 THEN 'excellent' WHEN confidence >= 70 THEN 'good' WHEN confidence >= 50 THEN 'fair' ELSE 'low' END"


@register("AGG12", f"SELECT {_BAND} AS band, count(*) AS n FROM {P} GROUP BY 1")
def agg12(spark, d):
    return pages(spark, d).groupBy(F.expr(_BAND).alias("band")).agg(F.count("*").alias("n"))


_GRADE = "CASE WHEN 100.0 * {0} / {1} >= 80 THEN 'excellent' WHEN 100.0 * {0} / {1} >= 60 THEN 'good' WHEN 100.0 * {0} / {1} >= 40 THEN 'fair' ELSE 'poor' END"


@register("AGG13", f"SELECT folder, count_if(confidence >= 80)::BIGINT AS high, count_if(confidence >= 50 AND confidence < 80)::BIGINT AS middle, count_if(confidence < 50)::BIGINT AS low, {_GRADE.format('count_if(confidence >= 50)', 'count(*)')} AS grade FROM {P} GROUP BY folder")
def agg13(spark, d):
    from foliospark.operators.classify import grade

    c = F.col("confidence")
    return pages(spark, d).groupBy("folder").agg(F.count_if(c >= 80).alias("high"), F.count_if((c >= 50) & (c < 80)).alias("middle"), F.count_if(c < 50).alias("low"), grade(100.0 * F.count_if(c >= 50) / F.count("*")).alias("grade"))


@register("AGG14", f"SELECT engine, count(*) AS n, sum(confidence) AS total, round(avg(confidence), 4) AS mean, avg(confidence) = max(avg(confidence)) OVER () AS best FROM {P} GROUP BY engine")
def agg14(spark, d):
    g = pages(spark, d).groupBy("engine").agg(F.count("*").alias("n"), F.sum("confidence").alias("total"), F.avg("confidence").alias("m"))
    return g.select("engine", "n", "total", F.round("m", 4).alias("mean"), (F.col("m") == g.agg(F.max("m")).scalar()).alias("best"))


@register("AGG15", f"SELECT engine, sum(length(text))::BIGINT AS chars, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words FROM {P} GROUP BY engine")
def agg15(spark, d):
    return pages(spark, d).groupBy("engine").agg(F.sum(F.length("text")).alias("chars"), F.sum(T.word_count("text")).alias("words"))


@register("AGG16", "SELECT source AS folder, round(100.0 * count(l.doc_id) / greatest(count(*), 1), 2)::DOUBLE AS labelled_pct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def agg16(spark, d):
    got = load(spark, d, "labels").select("doc_id", F.lit(1).alias("y"))
    return load(spark, d, "documents", "doc_id", "source").join(got, "doc_id", "left").groupBy(F.col("source").alias("folder")).agg(F.round(100.0 * F.count("y") / F.greatest(F.count("*"), F.lit(1)), 2).cast("double").alias("labelled_pct"))


@register("AGG17", f"""SELECT count_if(length(trim(text)) < 50)::BIGINT AS blank, count(*) AS pages, max(length(text)) AS longest, sum(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')))::BIGINT AS words,
    round(avg(seconds), 4) AS mean_seconds, round(60 / avg(seconds), 4) AS pages_per_minute, count_if(turned)::BIGINT AS turned FROM (SELECT *, 1 + page_id % 7 AS seconds, page_id % 11 = 0 AS turned FROM {P})""")
def agg17(spark, d):
    """A run over pages; its seconds and turned pages are made from the ids."""
    run = pages(spark, d).withColumns({"seconds": 1 + F.col("page_id") % 7, "turned": F.col("page_id") % 11 == 0})
    return run.agg(
        F.count_if(F.length(F.trim("text")) < 50).alias("blank"), F.count("*").alias("pages"), F.max(F.length("text")).cast("long").alias("longest"),
        F.sum(F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+"))).alias("words"), F.round(F.avg("seconds"), 4).alias("mean_seconds"),
        F.round(60 / F.avg("seconds"), 4).alias("pages_per_minute"), F.count_if("turned").alias("turned"),
    )


@register("AGG18", f"SELECT count(*) AS total, count_if(action = 'signup')::BIGINT AS signups, count_if(action = 'error')::BIGINT AS errors, count(DISTINCT user_id) AS users FROM {E}")
def agg18(spark, d):
    a = F.col("action")
    return audit(spark, d).agg(F.count("*").alias("total"), F.count_if(a == "signup").alias("signups"), F.count_if(a == "error").alias("errors"), F.countDistinct("user_id").alias("users"))


@register("AGG19", f"SELECT user_id, count(*) AS count FROM {E} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg19(spark, d):
    return search.top(audit(spark, d).groupBy("user_id").count(), 10, F.col("count").desc(), F.col("user_id"))


@register("AGG20", "SELECT n_name, count(*) AS total, count_if(c_acctbal > 0)::BIGINT AS positive, round(100.0 * count_if(c_acctbal > 0) / count(*), 2)::DOUBLE AS pct FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def agg20(spark, d):
    j = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    up = F.count_if(F.col("c_acctbal") > 0)
    return search.top(j.groupBy("n_name").agg(F.count("*").alias("total"), up.alias("positive"), F.round(100.0 * up / F.count("*"), 2).cast("double").alias("pct")), 5, F.col("total").desc(), F.col("n_name"))


@register("AGG21", f"SELECT action, count(*) AS n, count_if(ts >= TIMESTAMP '2024-01-30')::BIGINT AS last_day FROM {E} WHERE action IN ('error', 'signup') GROUP BY action")
def agg21(spark, d):
    return audit(spark, d).where("action IN ('error', 'signup')").groupBy("action").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= "2024-01-30").alias("last_day"))


_HEALTH = "100 - CASE WHEN errors > 100 THEN 30 ELSE 0 END - CASE WHEN users < 200 THEN 20 ELSE 0 END - CASE WHEN total = 0 THEN 50 ELSE 0 END"


@register("AGG22", f"""SELECT {_HEALTH} AS score, CASE WHEN {_HEALTH} >= 80 THEN 'healthy' WHEN {_HEALTH} >= 50 THEN 'degraded' ELSE 'critical' END AS status,
    coalesce(nullif(concat_ws(',', CASE WHEN errors > 100 THEN 'read the errors' END, CASE WHEN users < 200 THEN 'few users' END, CASE WHEN total = 0 THEN 'no events' END), ''), 'none') AS advice FROM (SELECT count(*) AS total, count_if(action = 'error') AS errors, count(DISTINCT user_id) AS users FROM {E})""")
def agg22(spark, d):
    score = F.expr(_HEALTH)
    advice = F.array_compact(F.array(F.when(F.col("errors") > 100, "read the errors"), F.when(F.col("users") < 200, "few users"), F.when(F.col("total") == 0, "no events")))
    status = F.when(score >= 80, "healthy").when(score >= 50, "degraded").otherwise("critical")
    return agg18(spark, d).select(score.alias("score"), status.alias("status"), F.coalesce(F.nullif(F.array_join(advice, ","), F.lit("")), F.lit("none")).alias("advice"))


@register("AGG23", "SELECT lower(p_type) AS place, count(*) AS frequency, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY 1")
def agg23(spark, d):
    return load(spark, d, "part").groupBy(F.lower("p_type").alias("place")).agg(F.count("*").alias("frequency"), F.min_by("p_name", "p_partkey").alias("first_name"))


@register("AGG24", f"SELECT folder, string_agg(engine || '=' || n, ',' ORDER BY engine) AS by_engine, sum(n)::BIGINT AS n FROM (SELECT folder, engine, count(*) AS n FROM {P} GROUP BY ALL) GROUP BY folder")
def agg24(spark, d):
    g = pages(spark, d).groupBy("folder", "engine").agg(F.count("*").alias("n"))
    return g.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(F.concat("engine", F.lit("="), F.col("n").cast("string")))), ",").alias("by_engine"), F.sum("n").alias("n"))
