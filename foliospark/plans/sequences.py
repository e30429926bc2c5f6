"""Queries for the last aggregates, windows, paging and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import extract, likeness, resolve, search, timeline, vectors
from foliospark.plans import relational as R
from foliospark.plans.registry import register
from foliospark.plans.relational import E, GRANTS, O, P
from foliospark.sources import sinks
from foliospark.sources.catalog import audit, load, pages, proceedings


@register("AGG25", f"SELECT action AS kind, count(*) AS n, round(sum(value), 2) AS total FROM {E} GROUP BY 1")
def agg25(spark, d):
    return audit(spark, d).groupBy(F.col("action").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("AGG26", f"SELECT folder_id, count_if(can_search)::BIGINT AS can_search, count(*) AS n FROM {GRANTS} GROUP BY 1")
def agg26(spark, d):
    return R.grants(spark, d).groupBy("folder_id").agg(F.count_if("can_search").alias("can_search"), F.count("*").alias("n"))


@register("AGG27", f"SELECT DISTINCT user_id FROM {E} ORDER BY user_id LIMIT 5")
def agg27(spark, d):
    return search.top(audit(spark, d).select("user_id").distinct(), 5, F.col("user_id"))


@register("AGG28", f"SELECT count(*) AS n, round(avg(s), 6) AS mean, max(s) AS top, min(s) AS low FROM (SELECT round({R._COS}, 6) AS s FROM embeddings)")
def agg28(spark, d):
    return R.jn15(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("mean"), F.max("similarity").alias("top"), F.min("similarity").alias("low"))


@register("AGG29", f"SELECT folder, round(avg(confidence) FILTER (WHERE engine <> 'de'), 4) AS mean FROM {P} GROUP BY folder")
def agg29(spark, d):
    return pages(spark, d).groupBy("folder").agg(F.round(F.avg(F.when(F.col("engine") != "de", F.col("confidence"))), 4).alias("mean"))


# windows and sequences


@register("WIN1", f"SELECT id, folder_id, day FROM (SELECT *, row_number() OVER (PARTITION BY folder_id, day ORDER BY id DESC) AS k FROM {O}) WHERE k = 1")
def win1(spark, d):
    return sinks.newest(proceedings(spark, d), ["folder_id", "day"], "id").select("id", "folder_id", "day")


def gap_sql(where: str) -> str:
    return f"""SELECT folder_id, from_day, to_day, days, CASE WHEN days >= 365 THEN 'critical' WHEN days >= 270 THEN 'high' WHEN days >= 180 THEN 'medium' ELSE 'low' END AS priority
        FROM (SELECT folder_id, day AS from_day, lead(day) OVER w AS to_day, lead(day) OVER w - day AS days FROM {O} WINDOW w AS (PARTITION BY folder_id ORDER BY day, id)) WHERE days > 0 AND {where}"""


@register("WIN2", gap_sql("days >= 180 AND days <= 1825"))
def win2(spark, d):
    return timeline.gaps(proceedings(spark, d))


@register("WIN3", gap_sql("days > 180"))
def win3(spark, d):
    return timeline.gaps(proceedings(spark, d), 180, None, True)


@register("WIN4", f"""SELECT folder_id, 'gap' AS kind, from_day, to_day, days, CASE WHEN days > 120 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT folder_id, day AS from_day, lead(day) OVER w AS to_day, lead(day) OVER w - day AS days FROM {O} WINDOW w AS (PARTITION BY folder_id ORDER BY day, id)) WHERE days > 60
    UNION ALL SELECT folder_id, 'idle', last_day, DATE '2001-09-01', DATE '2001-09-01' - last_day, CASE WHEN DATE '2001-09-01' - last_day > 180 THEN 'high' ELSE 'medium' END FROM (SELECT folder_id, max(day) AS last_day FROM {O} GROUP BY 1) WHERE DATE '2001-09-01' - last_day > 90""")
def win4(spark, d):
    return timeline.wide_gaps(proceedings(spark, d), "2001-09-01")


@register("WIN5", "SELECT conv_id, turn, trim(coalesce(lag(right(text, 300)) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' ' || text) AS joined FROM conversations")
def win5(spark, d):
    return timeline.overlapped(load(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "joined")


@register("WIN6", f'SELECT conv_id, page, start, start + length(text) AS "end" FROM {R._OFF}')
def win6(spark, d):
    return R._offsets(spark, d).select("conv_id", "page", "start", "end")


@register("WIN7", f"SELECT id, place FROM {R._PLACED}")
def win7(spark, d):
    return timeline.enumerated(proceedings(spark, d)).select("id", F.col("place").cast("long"))


@register("WIN8", f"SELECT folder_id, max(id) + 1 AS next FROM {O} GROUP BY 1")
def win8(spark, d):
    return proceedings(spark, d).groupBy("folder_id").agg((F.max("id") + 1).alias("next"))


@register("WIN9", """WITH l AS (SELECT doc_id AS page_id, generate_subscripts(s, 1) - 1 AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
    SELECT page_id, line_no, line, string_agg(line, chr(10)) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM l""")
def win9(spark, d):
    return extract.line_contexts(pages(spark, d)).withColumn("line_no", F.col("line_no").cast("long"))


@register("WIN10", "SELECT doc_id AS page_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS head FROM documents")
def win10(spark, d):
    return pages(spark, d).select("page_id", extract.head_lines("text", 3).alias("head"))


@register("WIN11", f"SELECT a.id, b.spare FROM (SELECT id, folder_id, row_number() OVER (PARTITION BY folder_id ORDER BY id) AS k FROM {O} WHERE NOT verified) a LEFT JOIN (SELECT folder_id, id AS spare, row_number() OVER (PARTITION BY folder_id ORDER BY id) AS k FROM {O} WHERE verified) b USING (folder_id, k)")
def win11(spark, d):
    o = proceedings(spark, d)
    spare = o.where("verified").select("folder_id", "id", F.col("id").alias("spare"))
    return extract.matched_in_order(o.where("NOT verified").select("id", "folder_id"), spare, "folder_id", "id", "spare").select("id", "spare")


@register("WIN12", f"""SELECT action, round(n / minutes, 4)::DOUBLE AS per_minute, round(greatest(1000000 - n, 0) / (n / minutes), 2)::DOUBLE AS minutes_left
    FROM (SELECT action, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 AS minutes FROM {E} GROUP BY action)""")
def win12(spark, d):
    """The rate of each action, and the minutes to a million of them at that rate."""
    at = lambda t: F.unix_micros(t.cast("timestamp"))
    minutes = (at(F.max("ts")) - at(F.min("ts"))) / 60e6
    rate = F.col("n") / F.col("minutes")
    left = F.greatest(1_000_000 - F.col("n"), F.lit(0)) / rate
    return audit(spark, d).groupBy("action").agg(F.count("*").alias("n"), minutes.alias("minutes")).select("action", F.round(rate, 4).alias("per_minute"), F.round(left, 2).alias("minutes_left"))


# order, limit, paging


@register("TOPK1", f"SELECT id, day FROM {O} ORDER BY day DESC NULLS FIRST, id LIMIT 20 OFFSET 40")
def topk1(spark, d):
    return search.top(proceedings(spark, d).select("id", "day"), 20, F.col("day").desc_nulls_first(), F.col("id"), skip=40)


@register("TOPK2", f"SELECT page_id, confidence FROM {P} ORDER BY confidence DESC, page_id LIMIT 25")
def topk2(spark, d):
    return search.top(pages(spark, d).select("page_id", "confidence"), 25, F.col("confidence").desc(), F.col("page_id"))


@register("TOPK3", f"SELECT folder, page_id FROM (SELECT folder, page_id, row_number() OVER (PARTITION BY folder ORDER BY confidence DESC, page_id) AS k FROM {P}) WHERE k <= 3")
def topk3(spark, d):
    return search.first_per_group(pages(spark, d), 3, ["folder"], F.col("confidence").desc(), F.col("page_id")).select("folder", "page_id")


@register("TOPK4", f"SELECT count(*) AS total, 2 AS page, ((count(*) + 49) // 50)::BIGINT AS pages, 2 < ((count(*) + 49) // 50) AS has_next, true AS has_previous FROM {P}")
def topk4(spark, d):
    return pages(spark, d).agg(F.count("*").alias("n")).select(*search.page_info(F.col("n"), 50, 2))


@register("TOPK5", f"SELECT g.* FROM ({gap_sql('days >= 180')}) g ORDER BY CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 5 END, days DESC, folder_id, from_day LIMIT 50")
def topk5(spark, d):
    order = F.coalesce(F.create_map(*[F.lit(x) for x in ("critical", 1, "high", 2, "medium", 3, "low", 4)])[F.col("priority")], F.lit(5))
    return search.top(timeline.gaps(proceedings(spark, d), 180, None), 50, order, F.col("days").desc(), F.col("folder_id"), F.col("from_day"))


@register("TOPK6", f"SELECT folder, count(*) AS count FROM {P} WHERE contains(lower(text), 'tion') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def topk6(spark, d):
    return search.top(pages(spark, d).where(T.contains_ci("text", "tion")).groupBy("folder").count(), 10, F.col("count").desc(), F.col("folder"))


@register("TOPK7", f"SELECT folder, array_to_string(list(page_id ORDER BY page_id)[1:5], ',') AS first_pages, count(*) > 5 AS truncated FROM {P} GROUP BY folder")
def topk7(spark, d):
    few = search.first_per_group(pages(spark, d), 6, ["folder"], F.col("page_id"))
    ids = F.array_sort(F.collect_list("page_id"))
    return few.groupBy("folder").agg(F.array_join(F.slice(ids, 1, 5), ",").alias("first_pages"), (F.count("*") > 5).alias("truncated"))


@register("TOPK8", f"SELECT id FROM {O} ORDER BY kind, day, id LIMIT 1")
def topk8(spark, d):
    return search.top(proceedings(spark, d), 1, F.col("kind"), F.col("day"), F.col("id")).select("id")


@register("TOPK9", f"SELECT page_id FROM {P} WHERE contains(lower(text), 'ver') ORDER BY page_id LIMIT 40")
def topk9(spark, d):
    return search.top(pages(spark, d).where(T.contains_ci("text", "ver")).select("page_id"), 40, F.col("page_id"))


@register("TOPK10", f"SELECT folder, arg_max(page_id, confidence * 1000000 - page_id) AS best FROM {P} GROUP BY folder")
def topk10(spark, d):
    return pages(spark, d).groupBy("folder").agg(F.max_by("page_id", F.struct("confidence", (-F.col("page_id")).alias("o"))).alias("best"))


# sets and duplicates


@register("DED1", f"SELECT DISTINCT folder, engine FROM {P}")
def ded1(spark, d):
    return pages(spark, d).select("folder", "engine").distinct()


@register("DED2", f"SELECT folder_id, max(id) AS id FROM {O} GROUP BY folder_id")
def ded2(spark, d):
    return sinks.newest(proceedings(spark, d).select("folder_id", "id"), ["folder_id"], "id")


def _keyed(key: str, sql_key: str, name: str) -> None:
    @register(key, f"SELECT min(p_partkey) AS p_partkey FROM part GROUP BY {sql_key}")
    def query(spark, d):
        return resolve.first_by_key(load(spark, d, "part"), resolve.keys("p_type")[name], F.col("p_partkey")).select("p_partkey")


_keyed("DED3", "lower(trim(p_type))", "case")
_keyed("DED4", "lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g')))", "space")
_keyed("DED5", "trim(regexp_replace(upper(p_type), '[^A-Z ]', '', 'g'))", "folded")


@register("DED6")
def ded6(spark, d):
    return likeness.greedy(load(spark, d, "part", "p_partkey", "p_brand", "p_name"), "p_brand", "p_name", "p_partkey", likeness.winkler(0.88))


@register("DED7")
def ded7(spark, d):
    return likeness.greedy(load(spark, d, "part", "p_partkey", "p_brand", "p_name"), "p_brand", "p_name", "p_partkey", likeness.ratcliff(0.78), longest_first=True)


@register("DED8")
def ded8(spark, d):
    return resolve.seeds(R.jn11(spark, d))


@register("DED9", f"SELECT min(id) AS id FROM {O} GROUP BY kind, folder_id, day")
def ded9(spark, d):
    return resolve.first_by_key(proceedings(spark, d), F.struct("kind", "folder_id", "day"), F.col("id")).select("id")


@register("DED10", "SELECT id, arg_max(tag, p) AS tag FROM (SELECT doc_id AS id, 'toxic' AS tag, 1 AS p FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'poor', 2 FROM labels WHERE quality = 0) GROUP BY id")
def ded10(spark, d):
    la = load(spark, d, "labels")
    tags = la.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("toxic").alias("tag"), F.lit(1).alias("p")).unionByName(la.where("quality = 0").select(F.col("doc_id").alias("id"), F.lit("poor").alias("tag"), F.lit(2).alias("p")))
    return sinks.newest(tags, ["id"], "p").select("id", "tag")


@register("DED11", "SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def ded11(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind")).unionByName(load(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")))


Q2 = [1.0 if i % 2 else -0.5 for i in range(64)]
COS2 = f"coalesce(list_cosine_similarity(embedding::DOUBLE[], {Q2}::DOUBLE[]), 0)"


@register("DED12", f"""SELECT vec_id, concat_ws(',', CASE WHEN round({R._COS}, 6) >= 0.05 THEN 'a' END, CASE WHEN round({COS2}, 6) >= 0.05 THEN 'b' END) AS concepts,
    (round({R._COS}, 6) >= 0.05)::INT + (round({COS2}, 6) >= 0.05)::INT AS n_concepts, greatest(round({R._COS}, 6), round({COS2}, 6)) AS best FROM embeddings WHERE greatest(round({R._COS}, 6), round({COS2}, 6)) >= 0.05""")
def ded12(spark, d):
    return vectors.concepts(load(spark, d, "embeddings"), {"a": R._Q64, "b": Q2}, 0.05)


@register("DED13", "SELECT sha256(text) AS sha, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1")
def ded13(spark, d):
    return resolve.repeated(load(spark, d, "documents").select(F.sha2("text", 256).alias("sha")), ["sha"])


@register("DED14", """SELECT doc_id, array_to_string(list(w ORDER BY i)[1:10], ' ') AS firsts FROM (SELECT doc_id, w, min(i) AS i FROM
    (SELECT doc_id, unnest(s) AS w, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents)) GROUP BY ALL) GROUP BY doc_id""")
def ded14(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(F.split("text", " ")), 1, 10), " ").alias("firsts"))


@register("DED15", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 10 <> 0")
def ded15(spark, d):
    s = load(spark, d, "supplier", "s_suppkey", "s_nationkey")
    into = s.where("s_suppkey % 10 = 0").select("s_suppkey", (F.col("s_suppkey") - 1).alias("keep"))
    return resolve.merged(s, "s_suppkey", into, ["s_nationkey"])
