"""Reply trees as formatted conversations, in DataFrame functions only.

Messages carry a tree, their own id, their parent's id, role, text and score. Iterative self-joins that double their
reach sum the score from each message to its root, so a chain of n messages takes log2(n) rounds. Each tree's leaves are
ranked by the summed score of their path, ties by leaf id; the same joins then enumerate the chosen paths alone, which
are written with one template:

    ### role: text</turn>\\n

Inside role and text the escape sign and the signs that begin a control string are replaced, reversibly:
``\\`` -> ``\\0``, ``#`` -> ``\\1``, ``<`` -> ``\\2`` and, in roles, ``:`` -> ``\\3``.

Null text and role count as empty, a null score as 0; a null tree id is a tree of its own, also in the result. A
message whose parent is null or absent is a root. Rows repeated with one (tree, node) keep the first by role and
text. A parent chain that runs in a circle raises an error. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from motionmill.llm._shared import cut, table

TRAINED_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for sign, code in [("\\", "\\0"), ("#", "\\1"), ("<", "\\2")] + [(":", "\\3")] * role:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in [(":", "\\3"), ("<", "\\2"), ("#", "\\1"), ("\\", "\\0")]:
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _keyed(messages: DataFrame) -> DataFrame:
    key = F.when(F.col("tree_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("tree_id").cast("string")))
    named = messages.select(
        key.alias("tree"), "tree_id", F.col("node_id").alias("node"), F.col("parent_id").alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    first = F.row_number().over(W.partitionBy("tree", "node").orderBy("role", "text", "parent"))
    return named.withColumn("copy", first).where("copy = 1").drop("copy")


def root_scores(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, score) summed from each node to its root, and the ancestors (tree, node, to) 1, 2, 4, .. steps above.

    In each round a node adds what its furthest known ancestor has summed and takes over that one's furthest.
    """
    known = nodes.select("tree", F.col("node").alias("to"))
    kept = nodes.select("tree", "node", F.col("parent").alias("to")).where("to is not null").join(known, ["tree", "to"], "left_semi")
    state = cut(nodes.select("tree", "node", "score").join(kept, ["tree", "node"], "left"))
    n, levels = state.count(), []
    while not state.where("to is not null").isEmpty():
        if 2 ** len(levels) > n:
            raise ValueError("a chain of parents runs in a circle")
        levels.append(state.where("to is not null").select("tree", "node", "to"))
        above = state.select("tree", F.col("node").alias("to"), F.col("score").alias("more"), F.col("to").alias("top"))
        state = cut(state.join(above, ["tree", "to"], "left").select("tree", "node", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), F.col("top").alias("to")))
    return state.select("tree", "node", "score"), levels


def best_leaves(scores: DataFrame, levels: list[DataFrame], top: int = 1) -> DataFrame:
    """(tree, leaf, rank): the ``top`` best leaves of each tree."""
    leaves = scores.join(levels[0].select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti") if levels else scores
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc(F.round("score", 9)), "node"))
    return leaves.select("tree", F.col("node").alias("leaf"), rank.alias("rank")).where(F.col("rank") <= top)


def leaf_paths(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, leaf, rank, node, up): every ancestor of every given leaf, ``up`` steps above it; ids only."""
    paths = leaves.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).alias("up"))
    for k, level in enumerate(levels):
        further = paths.join(level, ["tree", "node"]).select("tree", "leaf", "rank", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))
        paths = cut(paths.unionByName(further))
    return paths


def format_trees(messages: DataFrame, top: int = 1, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(tree_id, leaf, rank, n_turns, formatted, loss): ``loss`` lists [begin, end) of trained text in ``formatted``."""
    nodes = cut(_keyed(messages))
    scores, levels = root_scores(nodes)
    chosen = leaf_paths(best_leaves(scores, levels, top), levels)
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    body = escape(F.col("text"))
    lines = chosen.join(nodes, ["tree", "node"]).select(
        "tree", "tree_id", "leaf", "rank", "up", (F.col("role") == trained_role).alias("trained"),
        F.concat(head, body, F.lit("</turn>\n")).alias("line"), F.length(head).alias("skip"), F.length(body).alias("n"),
    )
    whole = W.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    at = F.sum(F.length("line")).over(whole) - F.length("line") + F.col("skip")
    span = F.when(F.col("trained"), F.struct(F.col("at").cast("long").alias("begin"), (F.col("at") + F.col("n")).cast("long").alias("end")))
    parts = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("place"), "line", span.alias("span"))))
    grouped = lines.withColumn("at", at).groupBy("tree", "leaf").agg(
        F.first("tree_id").alias("tree_id"), F.first("rank").alias("rank"), parts.alias("parts")
    )
    return grouped.select(
        "tree_id", "leaf", "rank", F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.col("parts.line"), "").alias("formatted"),
        F.filter(F.col("parts.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    lines = F.filter(F.split(formatted, "</turn>\n"), lambda s: s != "")
    return F.transform(
        lines,
        lambda s: F.struct(
            unescape(F.substring_index(F.substr(s, F.lit(5)), ":", 1)).alias("role"),
            unescape(F.substr(s, F.instr(s, ":") + 2)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows of a flat conversation table as one-branch reply trees, in the order of turn, role, text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    return conversations.select(F.col("conv_id").alias("tree_id"), node.alias("node_id"), "role", "text").select(
        "*", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score")
    )


PROBE = r"""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(c1 AS BIGINT) AS turn, c2 AS role, r'\### Assistant: </turn> ok' AS text
FROM VALUES (0, 'user'), (1, 'assistant') AS t(c1, c2)"""


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = format_trees(conversation_nodes(rows.unionByName(spark.sql(PROBE))))
    turns = F.array_join(F.transform(parse_formatted(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = loss_text(F.col("formatted"), F.col("loss"))
    return done.select(
        F.col("tree_id").alias("conv_id"), "n_turns", F.sha2(turns, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, 4 + length(role) + length(role) - length(translate(role, '\#<:', '')) + 2
  + length(text) + length(text) - length(translate(text, '\#<', '')) + 8 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
