"""Chat formatting of reply trees. DataFrame functions only.

Nodes are messages with a parent. Root-to-leaf paths come from iterative self-joins: every
round doubles the distance that a node's pointer reaches, and each leaf gathers the ancestors
at twice the distance, so a thread of n turns takes log2(n) rounds. Branches of a tree are
ranked by score, and each chosen path becomes one conversation.

The template marks turns by control strings. Inside texts and roles a backslash is put after
the first character of each control string (its own and those of common chat templates) and
every backslash is doubled; taking away one backslash per pair restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.registry import named, query, table
from tideline.session import materialise

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# After one of these first characters and before one of these rests a control string stands.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>|/SYS>>)"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without any control string; null as the empty text."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def one_per_node(nodes: DataFrame) -> DataFrame:
    """``nodes`` without those that have no id, and one row for each (tree, node).

    Of rows with the same tree and node the first by parent (null first), role, text and score
    stands. Only if there are such rows are they brought together; ids alone tell.
    """
    nodes = nodes.filter(F.col("node").isNotNull())
    counted = nodes.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = materialise(counted.select(F.col("tree").alias("_tree"), F.col("node").alias("_node")))
    if again.isEmpty():
        return nodes
    same = [F.col("tree").eqNullSafe(F.col("_tree")), F.col("node") == F.col("_node")]
    order = ("parent", "role", "text", "score")
    # A minimum combines map-side, so a node that is repeated often is not gathered anywhere.
    firsts = (
        nodes.join(again, same, "left_semi")
        .groupBy("tree", "node")
        .agg(F.min(F.struct(*order)).alias("first"))
        .select("tree", "node", *[F.col(f"first.{c}").alias(c) for c in order])
    )
    return nodes.join(again, same, "left_anti").select("tree", "node", *order).unionByName(firsts)


def root_to_leaf(nodes: DataFrame) -> DataFrame:
    """All nodes above each leaf, itself included: ``tree``, ``leaf``, ``up`` (distance), ``node``.

    ``nodes`` has ``tree``, ``node`` (not null, unique in its tree) and ``parent``. A parent that
    is null or missing makes a root. Nodes on a cycle or below one have no root and are left out
    (``rootless`` returns them); other paths, also of the same tree, are not touched.
    """
    return _climb(nodes)[0]


def rootless(nodes: DataFrame) -> DataFrame:
    """The nodes that stand on a cycle of parents or below one: ``tree``, ``node``."""
    return _climb(nodes)[1]


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of leaves below a root, and the nodes whose parents never end.

    A path in a tree of n nodes has at most n - 1 steps, so a pointer of that reach or more
    stands on an endless one, and is followed no further.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    room = materialise(nodes.groupBy(F.col("tree").alias("of")).agg(F.count(F.lit(1)).alias("room")))
    up = nodes.filter(F.col("parent").isNotNull()).select("tree", "node", "parent")
    same = [F.col("a.tree").eqNullSafe(F.col("b.tree")), F.col("a.parent") == F.col("b.parent")]
    linked = up.alias("a").join(known.alias("b"), same, "left_semi")
    jumps = materialise(
        linked.join(room, F.col("tree").eqNullSafe(F.col("of"))).select("tree", "node", "parent", "room")
    )
    leaves = (
        nodes.alias("a")
        .join(
            jumps.alias("b"),
            [F.col("a.tree").eqNullSafe(F.col("b.tree")), F.col("a.node") == F.col("b.parent")],
            "left_anti",
        )
        .select("tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("up"), "node")
    )
    paths = materialise(leaves)
    reach = 1
    endless = jumps.filter(F.col("room") <= reach).select("tree", "node")
    jumps = jumps.filter(F.col("room") > reach)
    while not jumps.isEmpty():
        here = [F.col("p.tree").eqNullSafe(F.col("j.tree")), F.col("p.node") == F.col("j.node")]
        higher = (
            paths.alias("p")
            .join(jumps.alias("j"), here)
            .select("p.tree", "p.leaf", (F.col("p.up") + reach).alias("up"), F.col("j.parent").alias("node"))
        )
        paths = materialise(paths.unionByName(higher))
        on = [F.col("a.tree").eqNullSafe(F.col("b.tree")), F.col("a.parent") == F.col("b.node")]
        further = materialise(
            jumps.alias("a").join(jumps.alias("b"), on).select("a.tree", "a.node", "b.parent", "a.room")
        )
        reach *= 2
        endless = endless.unionByName(further.filter(F.col("room") <= reach).select("tree", "node"))
        jumps = further.filter(F.col("room") > reach)
    if not endless.isEmpty():
        never = [F.col("p.tree").eqNullSafe(F.col("e.tree")), F.col("p.leaf") == F.col("e.node")]
        paths = paths.alias("p").join(endless.alias("e"), never, "left_anti")
    return paths, endless


def format_trees(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path: ``tree``, ``leaf``, ``branch`` (rank, 1 is best), ``score``,
    ``n_turns``, ``formatted`` and ``loss_spans``.

    ``nodes`` has ``tree``, ``node``, ``parent``, ``role``, ``text``, ``score``; other columns
    are not read. A branch's score is the sum of its nodes' scores (null counts 0); ties go to
    the smaller leaf. ``branches`` keeps that many per tree, None all. ``loss_spans`` has, for
    each turn to train on, its number (from 0) and the start and length of its escaped text in
    ``formatted``, in code points. A null tree is a tree of its own; no rows give no rows.
    Rows without a node id are left out, a repeated node counts once (see ``one_per_node``), and
    paths that run into a cycle of parents are left out too (see ``rootless``).
    """
    nodes = one_per_node(nodes.select("tree", "node", "parent", "role", "text", "score"))
    paths = root_to_leaf(nodes)
    here = [F.col("p.tree").eqNullSafe(F.col("n.tree")), F.col("p.node") == F.col("n.node")]
    role, body = escaped(F.col("n.role")), escaped(F.col("n.text"))
    turns = (
        paths.alias("p")
        .join(nodes.alias("n"), here)
        .select(
            "p.tree",
            "p.leaf",
            "p.up",
            F.coalesce("n.score", F.lit(0.0)).alias("score"),
            F.concat(F.lit(TURN), role, F.lit(TEXT)).alias("head"),
            body.alias("body"),
            F.coalesce(F.col("n.role") == TRAINED_ROLE, F.lit(False)).alias("train"),
        )
    )
    size = F.length("head") + F.length("body") + len(END)
    along = W.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    placed = turns.withColumn(
        "start",
        F.sum(size.cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0))
        - F.length("body")
        - len(END),
    )
    whole = placed.groupBy("tree", "leaf").agg(
        F.sum("score").alias("score"),
        F.sort_array(
            F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "train", "start"))
        ).alias("turns"),
    )
    best = W.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = whole.withColumn("branch", F.row_number().over(best))
    if branches is not None:
        ranked = ranked.filter(F.col("branch") <= branches)

    def span(turn: Column, i: Column) -> Column:
        return F.struct(
            i.cast("long").alias("turn"),
            turn["start"].alias("start"),
            F.length(turn["body"]).cast("long").alias("length"),
            turn["train"].alias("train"),
        )

    trained = F.filter(F.transform("turns", span), lambda s: s["train"])
    return ranked.select(
        "tree",
        "leaf",
        "branch",
        "score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(
            F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""
        ).alias("formatted"),
        F.transform(trained, lambda s: s.dropFields("train")).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: adds ``roles`` and ``texts`` (unescaped, by turn) and ``loss``.

    ``loss`` holds the unescaped texts under ``loss_spans``; null if a span does not have the
    length of the text it points at.
    """
    pattern = r"(?s)<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>"
    parsed = formatted.withColumns(
        {
            "roles": F.regexp_extract_all("formatted", F.lit(pattern), F.lit(1)),
            "texts": F.regexp_extract_all("formatted", F.lit(pattern), F.lit(2)),
        }
    )

    def masked(span: Column) -> Column:
        text = F.get("texts", span["turn"].cast("int"))
        return F.when(F.length(text) == span["length"], unescaped(text))

    return parsed.withColumn("loss", F.transform("loss_spans", masked)).withColumns(
        {"roles": F.transform("roles", unescaped), "texts": F.transform("texts", unescaped)}
    )


def threads(rows: DataFrame) -> DataFrame:
    """Nodes of plain conversations: each turn replies to the one before it.

    Turns are ordered by ``turn``, then role and text, so that repeated rows have a place.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.select(
        F.col("conv_id").alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )


SAMPLE = "</s>[INST] ok [/INST]"
_SQL_BODY = (
    r"regexp_replace(replace(coalesce({}, ''), '\', '\\'), "
    r"'([<\[])(\||/?s>|/?INST\]|</?SYS>>|/SYS>>)', '\1\\\2', 'g')"
)
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{SAMPLE}'), (-1, 1, 'assistant', '{SAMPLE}')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), ''
         ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{TRAINED_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
         FILTER (WHERE role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
  sum({len(TURN + TEXT + END)} + length({_SQL_BODY.format('role')})
      + length({_SQL_BODY.format('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op6_chat_formatting", ORACLE)
def op6_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(SAMPLE).alias("text"),
    )
    told = read_back(format_trees(threads(rows.unionByName(sample))))
    turns = F.transform(
        F.arrays_zip("roles", "texts"),
        lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n")),
    )
    loss = F.array_join("loss", "", "\x00a span that does not fit\x00")
    return told.select(
        F.col("tree").alias("conv_id"),
        F.size("texts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
