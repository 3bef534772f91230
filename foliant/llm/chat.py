"""Chat formatting of reply trees, in DataFrame functions only.

Nodes (tree, node, parent, role, text, score) form trees of replies. Iterative self-joins double the reach of each node's
link to its ancestors, so a path of n nodes takes log2(n) joins: they give depth and total score of the path from the root
to every node. Leaves are ranked within their tree by the mean score of their path; the chosen paths are enumerated over
the same links and each is formatted as one conversation.

The template opens a turn with <|turn|>, role and line feed, and closes it with <|end|> and line feed. Control strings
(of this template and of common others) inside roles and texts are written with an escape sign and a digit, the sign
itself with 0, so `unescape(escape(x)) = x` for every text. The loss mask is an array of spans (start, length in code
points) over the formatted string: the texts of the trained role, each once and without its marks.

Defined results: null text and null role are empty, null scores 0; a parent that isn't there makes its node a root; nodes
that reach no root (a cycle) are left out; a tree with a null key is a tree like others; rows that repeat a node are
replies beside each other; ties of score go to the smaller node; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.runtime import cut

OPEN, CLOSE = "<|turn|>", "<|end|>"
ESCAPE = "␛"
#: In this order on the way in, and backwards on the way out; the sign itself is first.
CONTROLS = (ESCAPE, OPEN, CLOSE, "<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    for i, control in enumerate(CONTROLS):
        text = F.replace(text, F.lit(control), F.lit(f"{ESCAPE}{i}"))
    return text


def unescape(text: Column) -> Column:
    for i, control in reversed(list(enumerate(CONTROLS))):
        text = F.replace(text, F.lit(f"{ESCAPE}{i}"), F.lit(control))
    return text


def escape_role(role: Column) -> Column:
    """A role ends at a line feed, so its own are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit(f"{ESCAPE}n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(f"{ESCAPE}n"), F.lit("\n")))


def paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, path_score, place, role, text): the nodes of each chosen path, place 0 at the root.

    nodes: tree and node (strings or numbers, tree never null), parent (null at a root), role, text, score.
    best: paths to keep of each tree, all if None.
    """
    base = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = base.select("tree", F.col("node").alias("parent")).distinct()
    base = base.join(known.withColumn("there", F.lit(True)), ["tree", "parent"], "left")
    links = cut(base.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "links")
    levels, most = [links], links.count()
    while links.filter("up is not null").take(1) and 1 << (len(levels) - 1) <= most:
        above = links.select("tree", F.col("node").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        links = links.join(above, ["tree", "up"], "left")
        links = links.select("tree", "node", F.col("further").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("plus", F.lit(0.0))).alias("total"))
        links = cut(links, "links")
        levels.append(links)
    inner = levels[0].filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = links.filter("up is null").join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "depth", (F.col("total") / F.col("depth")).alias("path_score"))
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if best is not None:
        leaves = leaves.filter(F.col("rank") <= best)
    on = cut(leaves.select("tree", "leaf", "rank", "path_score", F.col("leaf").alias("node"), (F.col("depth") - 1).alias("place")), "paths")
    for k, level in enumerate(levels[:-1]):
        ups = level.filter("up is not null").select("tree", "node", "up")
        more = on.join(ups, ["tree", "node"]).select("tree", "leaf", "rank", "path_score", F.col("up").alias("node"), (F.col("place") - F.lit(1 << k)).alias("place"))
        on = cut(on.unionByName(more), "paths")
    return on.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).drop("node")


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, path_score, conversation, loss): each path as one string, and the spans of the trained role."""
    turns = turns.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("line", F.concat("head", "body", F.lit(f"{CLOSE}\n")))
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.char_length("line").cast("long")).over(before), F.lit(0)) + F.char_length("head"))
    span = F.when(F.col("role") == trained, F.struct(F.col("start"), F.char_length("body").cast("long").alias("length")))
    one = F.array_sort(F.collect_list(F.struct("place", "line", span.alias("span"))))
    out = turns.groupBy("tree", "leaf", "rank", "path_score").agg(one.alias("all"))
    lines, spans = F.transform("all", lambda t: t["line"]), F.transform("all", lambda t: t["span"])
    return out.select("tree", "leaf", "rank", "path_score", F.array_join(lines, "").alias("conversation"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))


def read_back(conversation: Column) -> Column:
    """Turns (role, text) of a formatted string."""
    parts = F.split(conversation, rf"\Q{OPEN}\E", -1)
    parts = F.slice(parts, 2, F.size(parts))
    end = len(CLOSE) + 1
    role = lambda p: unescape_role(F.substring_index(p, "\n", 1))
    text = lambda p: unescape(F.substring(p, F.instr(p, "\n") + 1, F.char_length(p) - F.instr(p, "\n") - F.lit(end)))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def masked(conversation: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(conversation, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def linear_trees(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of conversations as trees without branches: each turn answers the one before."""
    c = conversations.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    key = F.coalesce(F.concat(F.lit("c"), F.col("id").cast("string")), F.lit("null"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    c = c.withColumn("tree", key).withColumn("node", F.row_number().over(order).cast("long"))
    return c.select("tree", "id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    nodes = cut(linear_trees(conversations.unionByName(extra)), "nodes")
    out = formatted(paths(nodes))
    back = out.withColumn("turns", read_back(F.col("conversation"))).withColumn("learned", masked(F.col("conversation"), F.col("loss")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.expr("CASE WHEN tree <> 'null' THEN CAST(substring(tree, 2) AS BIGINT) END").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("conversation").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, {escaped} AS body FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(role) + length(body) + {around})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _escaped_sql(text: str) -> str:
    for i, control in enumerate(CONTROLS):
        text = f"replace({text}, '{control}', '{ESCAPE}{i}')"
    return text


OP7_SQL = OP7_SQL.format(escaped=_escaped_sql("text"), around=len(OPEN) + len(CLOSE) + 2)
