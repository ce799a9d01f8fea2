"""Chat formatting: reply trees to training texts.

A reply tree is a set of messages that name their parent. Iterative self-joins enumerate the root-to-leaf
paths, doubling the reach of every join, so a path of n messages takes log2(n) joins. Branches are ranked by
score and each chosen path is formatted as one conversation with the code-point spans that carry loss.

Defined cases: a null text is empty, a null role is an empty role, a null score counts 0. A message whose parent
is null or absent is a root. Messages on a cycle, and those whose answers lead into one, have no root and are left out. Ties in score go to the smaller
leaf. A null tree id is a tree of its own. Rows that repeat a (tree, node) are one message: the smallest
(role, text) is kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Scratch

OPEN, MIDDLE, CLOSE = "### ", ": ", "\n</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Put one backslash before every control string, whatever backslashes it already has before it."""
    return F.regexp_replace(text, r"(\\*)(### |</turn>)", r"$1\\$2")


def unescape(text: Column) -> Column:
    """Take away the backslash that ``escape`` has put there."""
    return F.regexp_replace(text, r"\\(\\*)(### |</turn>)", "$1$2")


ROLE_CODES = [("\\", "\\b"), (":", "\\c"), ("\n", "\\n"), ("#", "\\h"), ("<", "\\l")]


def escape_role(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    empty = F.lit("")
    return (rows.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
            .withColumn("node", F.row_number().over(order).cast("long"))
            .select(F.col("conv_id").alias("tree"), "node",
                    F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    "role", "text", F.lit(0.0).alias("score")))


def branch_paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, leaf, node, up): every message of every root-to-leaf path, ``up`` steps above its leaf."""
    nodes = messages.select("tree", "node")
    held = messages.select("tree", "node", "parent")
    real = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    links = scratch.keep(
        held.join(real, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")))
        .select("tree", "node", F.col("parent").alias("to")), "links")
    parents = links.select(F.col("tree").alias("_t"), F.col("to").alias("_n")).distinct()
    paths = scratch.keep(
        nodes.join(parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
        .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "leaves")
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < most:
        right = links.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "to")
        on = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))
        further = paths.join(right, on).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        longer = scratch.keep(paths.unionByName(further), "paths")
        onward = links.select("tree", "node", F.col("to").alias("mid"))
        reach = scratch.keep(
            onward.join(right, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("mid") == F.col("_n")))
            .select("tree", "node", "to"), "links")
        scratch.drop(paths, links)
        paths, links, step = longer, reach, step * 2
        if links.isEmpty():
            break
    # a link that reaches further than the tree has messages leads into a cycle
    endless = links.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    return paths.join(endless, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("leaf") == F.col("_n")), "left_anti")


def format_trees(spark: SparkSession, messages: DataFrame, branches: int = 1) -> DataFrame:
    """Format the ``branches`` best paths of each tree.

    Returns (tree, leaf, branch, path_score, n_turns, formatted, loss_spans); spans are [start, end) code points
    of the assistant texts inside ``formatted``.
    """
    scratch = Scratch(spark, "chat")
    kept = (messages.where(F.col("node").isNotNull())
            .groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m"))
            .select("tree", "node", "m.parent", F.coalesce("m.role", F.lit("")).alias("role"),
                    F.coalesce("m.text", F.lit("")).alias("text"), F.coalesce("m.score", F.lit(0.0)).alias("score")))
    kept = scratch.keep(kept, "messages")
    paths = branch_paths(kept, scratch)

    right = kept.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text", "score",
                        F.col("parent").alias("_p"))
    turns = scratch.keep(
        paths.join(right, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
        .select("tree", "leaf", "up", "role", "text", "score"), "turns")
    ranked = turns.groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"))
    best = (ranked.withColumn("branch", F.row_number().over(
        Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
        .where(F.col("branch") <= branches)
        .select(F.col("tree").alias("_t"), F.col("leaf").alias("_l"), "path_score", "branch"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (turns.join(best, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("leaf") == F.col("_l")))
              .select("tree", "leaf", "up", "role", "path_score", "branch", head.alias("head"), body.alias("body"))
              .withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
              .withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")))
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(
        F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end")))
    grouped = pieces.groupBy("tree", "leaf", "branch", "path_score").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", span.alias("span")))).alias("turns"))
    return grouped.select(
        "tree", "leaf", "branch", "path_score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, "\n</turn>\n", -1)
    shape = r"(?s)^### ([^:]*): (.*)$"
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape_role(F.regexp_extract(p, shape, 1)).alias("role"),
        unescape(F.regexp_extract(p, shape, 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"))
    done = format_trees(spark, conversation_messages(rows.unionByName(extra)))
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = done.select(
        F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
folded AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('### ' || role || ': ' || regexp_replace(text, '(\\*)(### |</turn>)', '\1\\\2', 'g') || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM folded
"""
