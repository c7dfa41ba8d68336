"""Chat formatting of reply trees.

Nodes point to the node they reply to. Self-joins that double their reach climb
to the roots: after round k each node knows the one 2**k steps above it, and the
sum and number of the scores on the way. So a chain of n turns takes log2(n)
rounds, each written to the shared folder. Branches are ranked by the mean score
of their nodes, as their leaves know it; then the chosen ones are laid out by the
same jumps, and formatted, each as one conversation.

The template writes a turn as ``<s>[INST] role [/INST] text</s>``. Inside roles
and texts its control strings get a backslash after their first character
(``<\\/s>``), and those that already have backslashes get one more; taking one
away restores the text, whatever it was. Only text within control strings
changes.

Defined cases: null texts and roles count as empty; a conversation without rows
doesn't exist; rows of equal conversation and turn stand in order of role and
text, null first, and equal rows are separate turns; a null conv_id is a
conversation of its own; a reply to a node that isn't there is a root; nodes in
a cycle have no root and are left out; an empty table gives an empty result.
Extra columns are not looked at. One conversation is one row of the result, so
its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .runtime import stored

#: The template's control strings.
START, END, HEAD, TAIL = "<s>", "</s>", "[INST]", "[/INST]"


def escape(text: Column) -> Column:
    """The text with one more backslash in whatever could be read as a control string."""
    angled = F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1")
    return F.regexp_replace(angled, r"\[(\\*/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    angled = F.regexp_replace(text, r"<\\(\\*/?s>)", r"<$1")
    return F.regexp_replace(angled, r"\[\\(\\*/?INST\])", r"[$1")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The jumps of every round, and the nodes that have a root: conv_id, node, total (of the scores up to the root), length.

    Round k has the node 2**k steps above each node that has one. A round
    joins only nodes that haven't met their root yet; when none of these meets
    it, all of them hang on cycles.
    """
    own = nodes.select("conv_id", "node", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.lit(1).cast("long").alias("length"), F.col("parent").alias("up"))
    known = nodes.select("conv_id", F.col("node").alias("there"))
    there = own.alias("o").join(known.alias("k"), _same("o", "k") & (F.col("o.up") == F.col("k.there")), "left")
    now, open_nodes = _counted(there.select("o.conv_id", "o.node", "o.total", "o.length", F.col("k.there").alias("up")))
    jumps, done, left = [], now.filter("up IS NULL").drop("up"), None
    while open_nodes and open_nodes != left:
        open_, left = now.filter("up IS NOT NULL"), open_nodes
        jumps.append(open_.select("conv_id", "node", "up"))
        above = open_.union(done.withColumn("up", F.lit(None).cast(nodes.schema["node"].dataType)))
        on = _same("a", "b") & (F.col("a.up") == F.col("b.node"))
        joined = open_.alias("a").join(above.alias("b"), on).select(
            "a.conv_id", "a.node", (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.length") + F.col("b.length")).alias("length"), "b.up"
        )
        now, open_nodes = _counted(joined)
        done = done.union(now.filter("up IS NULL").drop("up"))
    return jumps, done


def _counted(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows as written, and how many of them have something above."""
    seen = Observation()
    return stored(rows.observe(seen, F.count("up").alias("n")), "climbed"), seen.get["n"]


def leaves(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """Of the nodes that have a root, those that nothing replies to."""
    inner = nodes.filter("parent IS NOT NULL").select("conv_id", F.col("parent").alias("node")).distinct()
    return done.alias("n").join(inner.alias("i"), _same("n", "i") & (F.col("n.node") == F.col("i.node")), "left_anti")


def laid_out(ends: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """The nodes up to the root from each leaf (conv_id, leaf): conv_id, leaf, node, steps. A round of jumps doubles what is there."""
    found = ends.select("conv_id", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("steps"))
    for k, jump in enumerate(jumps):
        on = _same("f", "j") & (F.col("f.node") == F.col("j.node"))
        farther = found.alias("f").join(jump.alias("j"), on).select("f.conv_id", "f.leaf", F.col("j.up").alias("node"), (F.col("f.steps") + (1 << k)).alias("steps"))
        found = stored(found.union(farther), "paths")
    return found


def paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths: conv_id, leaf, node, steps (from the leaf to the node).

    nodes: conv_id, node, parent (null: a root), score, node ids unique and not null within a conversation.
    """
    jumps, done = climbed(nodes)
    return laid_out(leaves(nodes, done).select("conv_id", F.col("node").alias("leaf")), jumps)


def ranked_leaves(nodes: DataFrame, done: DataFrame, best: int) -> DataFrame:
    """conv_id, leaf, place and length of the ``best`` branches of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("length")), F.desc("length"), "node")
    ends = leaves(nodes, done).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= best)
    return ends.select("conv_id", F.col("node").alias("leaf"), "place", "length")


def chosen_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` branches of each conversation: conv_id, place, leaf, depth, role, text.

    nodes: conv_id, node, parent, role, text, score (null: 0). Branches stand by
    mean score, then length (longer first), then leaf. They are ranked by sums
    that the climbing nodes gather, and only the chosen ones are laid out, so the
    rows are the nodes times the rounds, and the result's.
    """
    jumps, done = climbed(nodes)
    ranked = stored(ranked_leaves(nodes, done, best), "ranked")
    found = laid_out(ranked, jumps)
    alike = _same("f", "r") & (F.col("f.leaf") == F.col("r.leaf"))
    chosen = found.alias("f").join(ranked.alias("r"), alike).select("f.conv_id", "r.place", "f.leaf", "f.node", (F.col("r.length") - 1 - F.col("f.steps")).alias("depth"))
    # Texts are joined to the chosen branches alone.
    own = nodes.select("conv_id", "node", "role", "text")
    on = _same("c", "o") & (F.col("c.node") == F.col("o.node"))
    return chosen.alias("c").join(own.alias("o"), on).select("c.conv_id", "c.place", "c.leaf", "c.depth", "o.role", "o.text")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation and path: conv_id, place, formatted, loss_spans (start and length, in characters).

    turns: conv_id, place, depth, role, text. The loss covers the assistant's texts as they stand in ``formatted``.
    """
    role, text = (escape(F.coalesce(c, F.lit(""))) for c in ("role", "text"))
    head = F.concat(F.lit(f"{START}{HEAD} "), role, F.lit(f" {TAIL} "))
    turn = F.struct("depth", head.alias("head"), text.alias("text"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    rows = turns.groupBy("conv_id", "place").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(1).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["text"]) + len(END)).alias("at"),
            F.when(t["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["text"]).alias("length"))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return rows.select("conv_id", "place", whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, from the formatted text alone: conv_id, formatted, turns, loss_text."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")

    def part(p: Column) -> Column:
        inner = F.substr(p, F.lit(len(START) + len(HEAD) + 2))
        cut = F.instr(inner, f" {TAIL} ")
        return F.struct(unescape(F.substr(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(inner, cut + len(TAIL) + 2)).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"], s["length"]))), "")
    return conversations.select("conv_id", "formatted", F.transform(pieces, part).alias("turns"), loss.alias("loss_text"))


def as_chain(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as nodes that each reply to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return nodes.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations."""
    back = read_back(conversations)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_tree(conversations: DataFrame) -> DataFrame:
    """The same rows as a tree of replies: turn n replies to turn (n - 1) / 2, and scores differ by turn and conversation."""
    nodes = as_chain(conversations)
    parent = F.floor(F.col("node") / 2).cast("long")
    score = F.pmod(F.col("node") * 7 + F.coalesce("conv_id", F.lit(0)) * 3, F.lit(8)) / 8  # sums are exact
    return nodes.withColumn("parent", F.when(parent > 0, parent)).withColumn("score", score)


#: The conversation that the query adds, a user's and an assistant's row with the template's own control strings.
PLANTED_ID, PLANTED_TEXT = -7, "</s>[INST] ok [/INST]"

ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(regexp_replace(regexp_replace(role, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')) AS role_chars,
         length(regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')) AS text_chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(role_chars + text_chars + 23) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

TREE_ORACLE = """
WITH RECURSIVE nodes AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS node FROM conversations),
scored AS (
  SELECT *, ((node * 7 + conv_id * 3) % 8) / 8 AS score FROM nodes),
up AS (
  SELECT conv_id, node AS leaf, node, score, 1 AS length FROM scored a WHERE NOT EXISTS (SELECT 1 FROM nodes b WHERE b.conv_id = a.conv_id AND b.node // 2 = a.node AND b.node > 1)
  UNION ALL SELECT up.conv_id, leaf, s.node, s.score, length + 1 FROM up JOIN scored s ON s.conv_id = up.conv_id AND s.node = up.node // 2),
branches AS (
  SELECT conv_id, leaf, row_number() OVER (PARTITION BY conv_id ORDER BY sum(score) / count(*) DESC, count(*) DESC, leaf) AS place FROM up GROUP BY conv_id, leaf)
SELECT conv_id, CAST(place AS INTEGER) AS place, leaf, count(*) AS n_turns, string_agg(n.role || ':' || length(n.text), ' ' ORDER BY up.node) AS turns
FROM up JOIN branches USING (conv_id, leaf) JOIN nodes n USING (conv_id, node) WHERE place <= 2 GROUP BY conv_id, place, leaf
"""
