"""Chat formatting from reply trees.

Messages form trees (tree_id, node_id, parent_id). Root-to-leaf paths come from self-joins that
double the distance they cover in each round, so a tree of depth D takes log2(D) rounds; the pairs
they produce (leaf, ancestor) are exactly the rows of the formatted paths. Branches of a tree are
ranked by their mean score, and each chosen path becomes one conversation.

Template, for each turn: `<|im_start|>` role newline text `<|im_end|>` newline. Control strings inside
texts (these and the customary ones of other templates) get a backslash after their first character;
strings that already carry backslashes there get one more, so the escape is reversible. A role has
percent signs and line breaks percent-coded. The loss mask is the array of (start, length) in code
points of the assistant texts, escaped as they stand in the output.

Defined cases: a null text or role is an empty string. A parent that is absent from its tree makes
a root. Messages whose ancestors form a cycle reach no root and are on no path. Null scores count
as 0. Texts of any length are formatted whole. Other columns are ignored, whatever their names. Repeated rows stay, ordered by role and text within their turn; a null turn comes first. Rows
with a null conv_id form one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table

START, END = "<|im_start|>", "<|im_end|>"
#: Opener, backslashes so far, rest: `<|`, `<s>`, `</s>`, `<<SYS>>`, `<</SYS>>`, `[INST]`, `[/INST]`.
CONTROL = r"(<|\[)(\\*)(?=\||/?s>|<\\*/?SYS>>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(?=\||/?s>|<\\*/?SYS>>|/?INST\])"
TURN = r"<\|im_start\|>([^\n]*)\n((?:[^<]|<(?!\|im_end\|>))*+)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def escape_role(role: Column) -> Column:
    coded = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return escape(coded)


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def conversation_tree(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees of one branch."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("node_id"))
    return numbered.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _rooted(keyed: DataFrame, links: DataFrame, tree: list[str], work: Scratch) -> DataFrame:
    """tree, n of the nodes whose ancestors end at a root.

    Every node that isn't known to be rooted yet points to an ancestor, twice as far up in each round;
    where that is rooted, so is the node. Of rooted nodes deeper than a round reaches, some lie within
    the next round's reach, so a round that finds none leaves only cycles and what hangs on them.
    """
    found = keyed.select(*tree, F.col("node_id").alias("n")).join(links.select(*tree, "n"), [*tree, "n"], "left_anti")
    known, jump = work.cut(found), links
    while True:
        up = known.select(*tree, F.col("n").alias("a"), F.lit(True).alias("rooted"))
        told = work.cut(jump.join(up, [*tree, "a"], "left"))
        new = told.where("rooted").select(*tree, "n")
        if new.isEmpty():
            return known
        rest = told.where("rooted is null").select(*tree, "n", "a")
        last = (known, jump) if jump is not links else (known,)
        known, jump = work.cut(known.unionByName(new)), work.cut(rest.join(told.select(*tree, F.col("n").alias("a"), F.col("a").alias("b")), [*tree, "a"]).select(*tree, "n", F.col("b").alias("a")))
        work.drop(told, *last)


def root_paths(nodes: DataFrame, *, acyclic: bool = False) -> DataFrame:
    """(tree_id, leaf, node_id, up): every node on the path of every leaf, `up` steps above it.

    nodes: tree_id, node_id, parent_id, unique by (tree_id, node_id). acyclic: parents are known to form
    no cycles, so that they need not be looked for.
    """
    # A null tree is a tree too: a flag beside the key makes plain equality hold for it.
    keyed = nodes.select(F.coalesce(F.col("tree_id").cast("string"), F.lit("")).alias("t"), F.col("tree_id").isNull().alias("tn"), "node_id", "parent_id")
    tree, work = ["t", "tn"], Scratch(nodes.sparkSession)
    parents = keyed.select(*tree, F.col("node_id").alias("p"))
    links = work.cut(keyed.where("parent_id is not null").join(parents.withColumnRenamed("p", "parent_id"), [*tree, "parent_id"], "left_semi").select(*tree, F.col("node_id").alias("n"), F.col("parent_id").alias("a")))
    leaves = keyed.join(links.select(*tree, F.col("a").alias("node_id")).distinct(), [*tree, "node_id"], "left_anti").select(*tree, "node_id")
    if not acyclic:
        rooted = _rooted(keyed, links, tree, work)
        links = work.cut(links.join(rooted, [*tree, "n"], "left_semi"))
        leaves = leaves.join(rooted.withColumnRenamed("n", "node_id"), [*tree, "node_id"], "left_semi")
    pairs = work.cut(leaves.select(*tree, F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("up")))
    jump, reach = links, 1
    while not jump.isEmpty():
        further = pairs.join(jump.withColumnRenamed("n", "node_id"), [*tree, "node_id"]).select(*tree, "leaf", F.col("a").alias("node_id"), (F.col("up") + reach).alias("up"))
        onward = jump.select(*tree, F.col("n").alias("m"), F.col("a").alias("n"))
        last = (pairs, jump)
        pairs, jump, reach = work.cut(pairs.unionByName(further)), work.cut(onward.join(jump, [*tree, "n"]).select(*tree, F.col("m").alias("n"), "a")), reach * 2
        work.drop(*last)
    return work.finish(pairs)


def branches(nodes: DataFrame, *, best: int | None = None, acyclic: bool = False) -> DataFrame:
    """One row a chosen path: tree_id, leaf, branch_rank, path_score, turns (role, text from the root)."""
    data = nodes.select(F.coalesce(F.col("tree_id").cast("string"), F.lit("")).alias("t"), F.col("tree_id").isNull().alias("tn"), "tree_id", "node_id", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    paths = root_paths(nodes, acyclic=acyclic)
    scores = paths.join(data.select("t", "tn", "node_id", "score"), ["t", "tn", "node_id"]).groupBy("t", "tn", "leaf").agg(F.avg("score").alias("path_score"))
    rank = F.row_number().over(Window.partitionBy("t", "tn").orderBy(F.col("path_score").desc(), "leaf"))
    chosen = scores.withColumn("branch_rank", rank)
    if best is not None:
        chosen = chosen.where(F.col("branch_rank") <= best)
    turns = paths.join(data, ["t", "tn", "node_id"]).groupBy("t", "tn", "leaf").agg(F.first("tree_id").alias("tree_id"), F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    return turns.join(chosen, ["t", "tn", "leaf"]).drop("t", "tn")


def format_turns(paths: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """Adds `formatted` and `loss_spans` (array of start, length in code points, start from 0)."""
    parts = F.transform("turns", lambda x: F.struct(
        F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), (x["role"] == loss_role).alias("loss")))
    out = paths.withColumn("_ch_parts", parts)
    sized = F.transform("_ch_parts", lambda x: F.struct(F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"), x["loss"].alias("loss")))
    out = out.withColumn("_ch_sizes", sized)
    empty = F.array().cast("array<struct<start:int,length:int>>")
    folded = F.aggregate(
        "_ch_sizes",
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["h"] + x["b"] + len(END) + 1).alias("at"),
            F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["h"]).alias("start"), x["b"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    text = F.array_join(F.transform("_ch_parts", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    return out.withColumn("formatted", text).withColumn("loss_spans", folded).drop("_ch_parts", "_ch_sizes")


def read_back(formatted: Column) -> Column:
    """Turns (role, text) parsed from a formatted conversation."""
    heads = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(heads, bodies, lambda r, t: F.struct(unescape_role(r).alias("role"), unescape(t).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans for linear conversations."""
    return format_turns(branches(conversation_tree(rows), best=1, acyclic=True)).select(F.col("tree_id").alias("conv_id"), "formatted", "loss_spans")


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    out = format_conversations(rows.unionByName(probe)).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '<([|]|/?s>|<\\*/?SYS>>)|\[(/?INST\])', '<+\1\2', 'g')) AS l FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + l + 10 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
