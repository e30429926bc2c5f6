"""Conversation repair: fault flags by windows, then one fold over the sorted turns that finds the cheapest edits.

The repaired roles read (s?(ua)+)?, an automaton of four states: nothing yet, after a system turn, after a user turn,
after an assistant turn. For each state the fold carries the cost of the cheapest edits that lead there, and their
initials (the audit): D deletes a turn, I inserts one, K keeps one, R gives one the role that is due. Equal letters cost
the same, so of two audits of equal cost none is the start of the other, and the lesser one stays the lesser one
whatever follows: the least struct of each state is enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import WS_CLASS

NEVER = 1 << 40  # the cost of a state that nothing leads to
NULL = " "  # what a null role or text becomes, and a null id or turn where it is hashed


@dataclass(frozen=True)
class Costs:
    """What the edits cost; truncated is added for a truncated turn that stays."""

    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


def damaged(turns: DataFrame) -> DataFrame:
    r"""conv_id, turn, role, text of conversations, damaged by crc32 of "conv_id:turn" modulo 20.

    0 drops the turn, 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats it, 4 makes its role user. Other columns go.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def flagged(turns: DataFrame) -> DataFrame:
    r"""turns (conv_id, turn, role, text), seen (1 where role and text are new, 2 where they come again, ...) and fault:
    the first that holds of blank, duplicate, truncated; else null.

    blank: no character but `[\x20\x09-\x0D]`. duplicate: role and text were seen earlier in the conversation.
    truncated: the last other character is not one of `[.!?]`. Turns go by number, nulls first, then by role and
    text, so that repeated turns and equal numbers have one order. Null roles and texts count as one space.
    """
    clean = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(NULL)).alias(c) for c in ("role", "text")])
    spread = clean.repartition("conv_id")  # serves both the window and the groups
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("seen") > 1, "duplicate").when(~F.col("text").rlike(rf"[.!?]{WS_CLASS}*\z"), "truncated")
    return spread.withColumn("seen", seen).withColumn("fault", fault)


def _after(state: Column, cost: Column | int, letter: str) -> Column:
    cost = F.lit(cost) if isinstance(cost, int) else cost
    return F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit"))


def _inserted(s: Column, costs: Costs) -> Column:
    """The four states before a turn or at the end, with one inserted turn where that is cheaper; two never are."""
    return F.struct(
        s["none"].alias("none"), s["s"].alias("s"),
        F.least(s["u"], *[_after(s[x], costs.insert, "I") for x in ("none", "s", "a")]).alias("u"),
        F.least(s["a"], _after(s["u"], costs.insert, "I")).alias("a"),
    )


def _stepped(s: Column, t: Column, costs: Costs) -> Column:
    """The states after a turn t, from those before it with its insertions made."""
    due = F.coalesce(t["fault"].isin("blank", "duplicate"), F.lit(False))
    extra = F.when(t["fault"] == "truncated", costs.truncated).otherwise(0)
    initial = F.substring(t["role"], 1, 1)
    gone = {x: _after(s[x], costs.delete, "D") for x in ("none", "s", "u", "a")}
    to_user = F.least(s["none"], s["s"], s["a"])

    def taken(source: Column, own: str) -> Column:
        kept = initial == own
        cost = F.when(kept, costs.keep).otherwise(costs.rerole) + extra
        return F.struct((source["cost"] + cost).cast("long").alias("cost"), F.concat(source["audit"], F.when(kept, "K").otherwise("R")).alias("audit"))

    return F.struct(
        gone["none"].alias("none"),
        F.when(due | (initial != "s"), gone["s"]).otherwise(F.least(gone["s"], _after(s["none"], F.lit(costs.keep) + extra, "K"))).alias("s"),
        F.when(due, gone["u"]).otherwise(F.least(gone["u"], taken(to_user, "u"))).alias("u"),
        F.when(due, gone["a"]).otherwise(F.least(gone["a"], taken(s["u"], "a"))).alias("a"),
    )


def cheapest(turns: Column, costs: Costs = Costs()) -> Column:
    """struct<cost, audit> of the cheapest edits of array<struct<role, text, fault>>; ties go to the least audit."""
    start = lambda cost: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("audit"))
    states = F.struct(start(0).alias("none"), *[start(NEVER).alias(x) for x in ("s", "u", "a")])
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    step = lambda s, t: let(_inserted(s, costs), lambda p: _stepped(p, t, costs))
    return F.aggregate(turns, states, step, lambda s: let(_inserted(s, costs), lambda p: F.least(p["none"], p["a"])))


def repaired(turns: Column, audit: Column) -> Column:
    """array<struct<role, text>>: the turns after the edits of the audit.

    Each turn's letters are I?[DKR]; a last I follows all turns. After a kept system turn at the start, or from the
    start on, users and assistants take turns, so that the place of a turn gives the role that it is due.
    """
    letters = F.regexp_extract_all(audit, F.lit("I?[DKR]"), F.lit(0))
    new = F.struct(F.lit("I").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text"))

    def made(t: Column, l: Column) -> Column:
        own = F.struct(F.right(l, F.lit(1)).alias("edit"), t["role"].alias("role"), t["text"].alias("text"))
        return F.filter(F.array(F.when(l.startswith("I"), new), F.when(own["edit"] != "D", own)), lambda x: x.isNotNull())

    made_all = F.concat(F.flatten(F.zip_with(turns, letters, made)), F.when(audit.endswith("I"), F.array(new)).otherwise(F.array().cast("array<struct<edit:string,role:string,text:string>>")))
    first = lambda x: F.get(x, F.lit(0))
    lead = lambda x: F.when((first(x)["edit"] == "K") & first(x)["role"].startswith("s"), 1).otherwise(0)
    due = lambda i, x: F.when((i - lead(x)) % 2 == 0, "user").otherwise("assistant")
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    pair = lambda p, i, x: F.struct(F.when(p["edit"] == "K", p["role"]).otherwise(due(i, x)).alias("role"), p["text"].alias("text"))
    return let(made_all, lambda x: F.transform(x, lambda p, i: pair(p, i, x)))


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text): its faults, the cheapest edits and their result.

    conv_id; turns, gaps, blank, duplicate, truncated, illegal and cost (long); audit; repaired, array<struct<role, text>>.
    gaps are numbers that lack between the least and the largest turn. illegal counts neighbours whose roles' initials
    are not su, ua or au. Other columns are left out; a null conv_id is a conversation of its own; repeated rows are
    turns, and duplicates. No rows give no rows. Roles other than user, assistant and system count by their initial.
    A conversation is one row of the result, so its turns meet in one task; numbers, windows and counts of it spill.
    """
    rows = flagged(turns).withColumn("one", F.struct("turn", "role", "text", "seen", "fault"))
    n = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    groups = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"), F.count("*").alias("turns"), F.min("turn").alias("first"), F.max("turn").alias("last"), *map(n, ("blank", "duplicate", "truncated")))
    initial = lambda t: F.substring(t["role"], 1, 1)
    nexts = F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0)))
    wrong = lambda a, b: ~F.coalesce(F.concat(initial(a), initial(b)).isin("su", "ua", "au"), F.lit(True))
    illegal = F.size(F.filter(F.zip_with(F.slice("all", F.lit(1), F.size(nexts)), nexts, wrong), lambda x: x)).cast("long")
    numbers = F.size(F.array_distinct(F.filter(F.col("all.turn"), lambda x: x.isNotNull())))
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - numbers, F.lit(0)).cast("long")
    found = groups.withColumns({"gaps": gaps, "illegal": illegal, "best": cheapest(F.col("all"), costs)})
    return found.select(
        "conv_id", "turns", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"),
        F.col("best.audit").alias("audit"), repaired(F.col("all"), F.col("best.audit")).alias("repaired"),
    )


def repair_digests(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """repair() of kept, with the text of the result as a digest; conversations of turns of which nothing is left get zeros.

    One more shuffle holds ids alone, made distinct where they are read.
    """
    line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
    done = repair(kept).withColumn("repaired_sha256", F.sha2(F.array_join(F.transform("repaired", line), "\n").cast("binary"), 256)).drop("repaired", "turns")
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit, digest = F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return ids.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *zero, audit, digest)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_digests(turns, damaged(turns))


#: The same by a recursion over the turns; crc32 is folded bit by bit from a list of bytes, each followed by eight shifts (-1).
SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k
  FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, octet_length(k) + 1), lambda i: [ascii(decode(k)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    ), 4294967295) % 20 AS kind FROM src
), bad AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM crc WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen, role[1] AS ini
  FROM bad
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS illegal
  FROM numbered
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM faults GROUP BY conv_id
), fold AS (
  SELECT conv_id, 0 AS i, {'c': 0::BIGINT, 'a': '', 'o': ''} AS n, {'c': 1000000000::BIGINT, 'a': '', 'o': ''} AS s,
    {'c': 1000000000::BIGINT, 'a': '', 'o': ''} AS u, {'c': 1000000000::BIGINT, 'a': '', 'o': ''} AS x FROM counts
  UNION ALL
  SELECT conv_id, i, {'c': n.c + 4, 'a': n.a || 'D', 'o': n.o},
    CASE WHEN NOT due AND ini = 's' THEN least({'c': s.c + 4, 'a': s.a || 'D', 'o': s.o}, {'c': n.c + t, 'a': n.a || 'K', 'o': n.o || chr(10) || role || ':' || text})
      ELSE {'c': s.c + 4, 'a': s.a || 'D', 'o': s.o} END,
    CASE WHEN due THEN {'c': u.c + 4, 'a': u.a || 'D', 'o': u.o}
      WHEN ini = 'u' THEN least({'c': u.c + 4, 'a': u.a || 'D', 'o': u.o}, {'c': e.c + t, 'a': e.a || 'K', 'o': e.o || chr(10) || role || ':' || text})
      ELSE least({'c': u.c + 4, 'a': u.a || 'D', 'o': u.o}, {'c': e.c + 3 + t, 'a': e.a || 'R', 'o': e.o || chr(10) || 'user:' || text}) END,
    CASE WHEN due THEN {'c': x.c + 4, 'a': x.a || 'D', 'o': x.o}
      WHEN ini = 'a' THEN least({'c': x.c + 4, 'a': x.a || 'D', 'o': x.o}, {'c': u.c + t, 'a': u.a || 'K', 'o': u.o || chr(10) || role || ':' || text})
      ELSE least({'c': x.c + 4, 'a': x.a || 'D', 'o': x.o}, {'c': u.c + 3 + t, 'a': u.a || 'R', 'o': u.o || chr(10) || 'assistant:' || text}) END
  FROM (
    SELECT g.conv_id, f.i, f.role, f.text, f.ini, f.fault IN ('blank', 'duplicate') AS due, CASE f.fault WHEN 'truncated' THEN 3 ELSE 0 END AS t, g.n, g.s,
      least(g.u, {'c': g.n.c + 3, 'a': g.n.a || 'I', 'o': g.n.o || chr(10) || 'user:'}, {'c': g.s.c + 3, 'a': g.s.a || 'I', 'o': g.s.o || chr(10) || 'user:'}, {'c': g.x.c + 3, 'a': g.x.a || 'I', 'o': g.x.o || chr(10) || 'user:'}) AS u,
      least(g.x, {'c': g.u.c + 3, 'a': g.u.a || 'I', 'o': g.u.o || chr(10) || 'assistant:'}) AS x,
      least(g.n, g.s, least(g.x, {'c': g.u.c + 3, 'a': g.u.a || 'I', 'o': g.u.o || chr(10) || 'assistant:'})) AS e
    FROM fold g JOIN faults f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i + 1
  )
), ended AS (
  SELECT g.conv_id, least(g.n, g.x, {'c': g.u.c + 3, 'a': g.u.a || 'I', 'o': g.u.o || chr(10) || 'assistant:'}) AS b
  FROM fold g JOIN counts k ON k.conv_id IS NOT DISTINCT FROM g.conv_id AND k.n = g.i
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(substr(b.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN ended z ON z.conv_id IS NOT DISTINCT FROM d.conv_id
"""
