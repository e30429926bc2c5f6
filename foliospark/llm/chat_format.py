r"""Chat formatting: reply trees to conversations, in DataFrame operations alone.

A turn is written as  <s>[INST] role [/INST] text</s>.  In role and text a backslash is doubled and each
control string gets a backslash after its first character, so that no control string of a text survives
and reading back is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import written

CHUNK = 64  # turns that are joined before conversations are put together


def _quoted(s: str) -> str:
    return rf"\Q{s}\E"


@dataclass(frozen=True)
class Template:
    """Marks around role and text, and the strings that may stand in marks only."""

    start: str = "<s>[INST] "
    middle: str = " [/INST] "
    end: str = "</s>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    trained: tuple[str, ...] = ("assistant",)

    def escape(self, c: Column) -> Column:
        at = "|".join(f"{_quoted(s[0])}(?={_quoted(s[1:])})" for s in self.control)
        return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), at, r"$0\\")

    def unescape(self, c: Column) -> Column:
        return F.regexp_replace(c, r"(?s)\\(.)", "$1")

    def read(self, formatted: Column) -> Column:
        """array<struct<role, text>> of a formatted conversation."""
        turns = F.filter(F.split(formatted, _quoted(self.end), -1), lambda t: t != "")
        halves = F.transform(turns, lambda t: F.split(t, _quoted(self.middle), 2))
        role = lambda p: self.unescape(F.substring(F.get(p, F.lit(0)), len(self.start) + 1, 2**31 - 1))
        return F.transform(halves, lambda p: F.struct(role(p).alias("role"), self.unescape(F.get(p, F.lit(1))).alias("text")))

    def masked(self, formatted: Column, spans: Column) -> Column:
        """array<string>: what stands under the loss mask, unescaped."""
        return F.transform(spans, lambda s: self.unescape(F.substring(formatted, s["start"].cast("int") + 1, s["chars"].cast("int"))))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """tree, node, up (an ancestor, null once the root is met), n and total (nodes and scores below up), by doubled
    distance; and the nodes that meet no root, if there are any."""
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    level = nodes.join(there, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("n"), F.col("score").alias("total")
    )
    levels, most = [written(level, "jumps")], None
    while not levels[-1].where("up IS NOT NULL").isEmpty():
        most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] if most is None else most
        if 2 ** (len(levels) - 1) >= most:
            return levels, levels[-1].where("up IS NOT NULL")
        above = levels[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("n").alias("m"), F.col("total").alias("more"))
        further = levels[-1].where("up IS NOT NULL").join(above, ["tree", "up"]).select(
            "tree", "node", F.col("far").alias("up"), (F.col("n") + F.col("m")).alias("n"), (F.col("total") + F.col("more")).alias("total")
        )
        levels.append(written(levels[-1].where("up IS NULL").unionByName(further), "jumps"))
    return levels, None


def reply_paths(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """tree, leaf, node, depth, rank: the nodes of the best root-to-leaf paths of each tree.

    messages: tree string (not null), node long (unique within its tree), parent long, score double (null
    counts as 0). A parent that is null or absent makes the child a root; ids need not grow along replies. Nodes
    that reach no root within as many steps as their largest tree has nodes are in a cycle or below one: of these,
    parents that are not smaller than the child are cut, which leaves no cycle. Paths rank by mean score, then
    length, then smallest leaf.

    Self-joins double the distance to the ancestor each node knows, so a path of n nodes takes log2 n joins,
    each of the messages that have not met their root yet. Only leaves are ranked, with the sums they have by then; the
    chosen ones walk the same jumps back, which gives each node of a path once.
    """
    nodes = written(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    levels, lost = _jumps(nodes)
    if lost is not None:
        smaller = F.when(F.col("lost").isNull() | (F.col("parent") < F.col("node")), F.col("parent")).alias("parent")
        marked = nodes.join(lost.select("tree", "node", F.lit(True).alias("lost")), ["tree", "node"], "left")
        levels, _ = _jumps(written(marked.select("tree", "node", smaller, "score"), "messages"))
    whole = levels.pop()
    parents = levels[0].where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct() if levels else whole.limit(0).select("tree", "node")
    best = [(F.col("total") / F.col("n")).desc(), F.col("n").desc(), F.col("node")]
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    chosen = (
        whole.join(parents, ["tree", "node"], "left_anti")
        .withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)))
        .withColumn("k", first("tree", "salt")).where(F.col("k") <= paths_per_tree)
        .withColumn("rank", first("tree")).where(F.col("rank") <= paths_per_tree)
        .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("by"), "n", "rank")
    )
    for k, jumps in reversed(list(enumerate(levels))):
        both = F.array(F.struct("node", "by"), F.struct(F.col("up").alias("node"), (F.col("by") + 2**k).alias("by")))
        chosen = (
            chosen.join(jumps.select("tree", "node", "up"), ["tree", "node"], "left")
            .select("tree", "leaf", "n", "rank", F.explode(F.filter(both, lambda x: x["node"].isNotNull())).alias("x"))
            .select("tree", "leaf", "n", "rank", "x.*")
        )
    return chosen.select("tree", "leaf", "node", (F.col("n") - 1 - F.col("by")).alias("depth"), "rank")


def format_paths(messages: DataFrame, template: Template = Template(), paths_per_tree: int = 1) -> DataFrame:
    """tree, leaf, rank, n_turns, formatted and loss_spans (code points from 0) of each chosen path.

    messages as for reply_paths(), with role and text; null ones count as empty. Turns are joined in runs of
    CHUNK before the runs meet in their conversation, which is one row of the result however it is made.
    """
    paths = reply_paths(messages, paths_per_tree)
    head = F.concat(F.lit(template.start), template.escape(F.coalesce("role", F.lit(""))), F.lit(template.middle))
    body = template.escape(F.coalesce("text", F.lit("")))
    turns = messages.select("tree", "node", head.alias("head"), body.alias("body"), F.coalesce(F.col("role").isin(*template.trained), F.lit(False)).alias("loss"))
    spans = "cast(array() AS array<struct<start: bigint, chars: bigint>>)"
    chunks = (
        paths.join(turns, ["tree", "node"])
        .select("tree", "leaf", "rank", "depth", "loss", F.length("head").cast("long").alias("skip"), F.length("body").cast("long").alias("chars"), F.concat("head", "body", F.lit(template.end)).alias("turn"))
        .groupBy("tree", "leaf", "rank", F.floor(F.col("depth") / CHUNK).alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("depth", "loss", "skip", "chars", "turn"))).alias("p"))
        .withColumn("a", F.expr(f"""aggregate(p, named_struct('o', 0L, 's', {spans}), (a, x) -> named_struct('o', a.o + length(x.turn),
            's', if(x.loss, concat(a.s, array(named_struct('start', a.o + x.skip, 'chars', x.chars))), a.s)))"""))
        .select("tree", "leaf", "rank", "chunk", F.size("p").cast("long").alias("n"), F.array_join("p.turn", "").alias("s"), "a")
    )
    return (
        chunks.groupBy("tree", "leaf", "rank")
        .agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("chunk", "s", "a"))).alias("c"))
        .withColumn("a", F.expr(f"""aggregate(c.a, named_struct('o', 0L, 's', {spans}), (a, x) -> named_struct('o', a.o + x.o,
            's', concat(a.s, transform(x.s, y -> named_struct('start', a.o + y.start, 'chars', y.chars)))))"""))
        .select("tree", "leaf", "rank", "n_turns", F.array_join("c.s", "").alias("formatted"), F.col("a.s").alias("loss_spans"))
    )


def chains(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of which each answers the one before it in its conversation, by turn, role and text.

    A null conversation is one of its own, a null turn comes first, repeated rows are turns of their own.
    Rows are numbered within runs of CHUNK turns, and runs by their sizes, so a long conversation is split.
    """
    by = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    rows = turns.select(
        F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("tree"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.col(text).alias("text"), F.coalesce(F.floor(F.col(turn) / CHUNK), F.lit(-(2**62))).alias("run"),
    )
    runs = rows.groupBy("tree", "run").count()
    before = F.sum("count").over(Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "run", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("tree", "run").orderBy(*by))
    numbered = rows.withColumn("place", place).join(runs, ["tree", "run"])
    node = (F.col("before") + F.col("place") - 1).alias("node")
    return numbered.select("tree", "conv", node, "role", "text").withColumns({"parent": F.when(F.col("node") > 0, F.col("node") - 1), "score": F.lit(0.0)})


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS v(conv_id, turn, role, text)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    t = Template()
    messages = written(chains(turns), "chains")
    line = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    done = format_paths(messages, t)
    return done.select(
        F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"),
        F.size(t.read(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(t.read(F.col("formatted")), line), ""), 256).alias("turns_sha256"),
        F.array_join(t.masked(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(replace(role || chr(0) || text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS esc FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) - 1 + length('<s>[INST] ' || ' [/INST] ' || '</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
