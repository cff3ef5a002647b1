"""Chat formatting of reply trees, in DataFrame operations only.

Messages point at the message they answer. Self-joins that double the jump
length give every message its root, depth and score along its path, so a tree
of depth d takes about log2(d) joins. The leaves of a tree are ranked by path
score, the best are chosen, the same jumps unfold each chosen leaf into its
path, and each path is formatted as one conversation.

A conversation is a run of turns ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside
roles and texts every control string is broken by a mark after its first
character, and marks that a text has itself are doubled, so nothing in a text
can end a turn and ``parse`` gets it back exactly. ``loss_spans`` are the
stretches of the result, by code points, that hold assistant texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

START, END = "<|im_start|>", "<|im_end|>"
#: Strings of common chat templates that must not occur in a text.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>")
#: The mark, and what stands for a mark, a break and a line end in a role.
MARK, DOUBLED, BREAK, LINE = "\x1a", "\x1a1", "\x1a2", "\x1a3"


@dataclass(frozen=True)
class Branches:
    """How many of a tree's best paths are kept, and whose texts are learnt."""

    per_tree: int = 1
    learn: str = "assistant"


def escape(text: Column) -> Column:
    """Doubles marks and breaks control strings; ``unescape`` undoes it."""
    pattern = "(?:" + "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS) + ")"
    return F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(DOUBLED)), pattern, BREAK)


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(BREAK), F.lit("")), F.lit(DOUBLED), F.lit(MARK))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"), escape(text), F.lit(END + "\n"))


def paths(messages: DataFrame, stage: Stage, config: Branches = Branches()) -> DataFrame:
    """``(root, leaf, node, place)`` of the chosen root-to-leaf paths of ``messages(node, parent, score)``.

    ``place`` counts from 0 at the root. Leaves of a tree rank by the mean
    score along their path, ties by the least leaf. A parent that is null or no
    message makes a root. Messages that answer each other in a circle have no
    root and are on no path. Nodes must be unique; null nodes are left out.
    """
    nodes = messages.where("node IS NOT NULL").select("node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("node").alias("parent"))
    linked = nodes.join(known.hint("merge"), "parent", "left_semi").select("node", F.col("parent").alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("steps"))
    roots = nodes.join(known.hint("merge"), "parent", "left_anti").select("node", F.lit(None).cast(nodes.schema["node"].dataType).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("steps"))
    jumps = [stage.put(linked.union(roots), "jump-0")]
    # while some message is still on its way to a root, let every message take its target's jump as well
    pending = jumps[-1].where("up IS NOT NULL").count()
    while pending:
        now = jumps[-1]
        there = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("sum").alias("more"), F.col("steps").alias("far"))
        ahead = now.where("up IS NOT NULL").join(there.hint("merge"), "up")
        moved = ahead.select("node", F.col("next").alias("up"), (F.col("sum") + F.col("more")).alias("sum"), (F.col("steps") + F.col("far")).alias("steps"))
        doubled = moved.union(now.where("up IS NULL").select("node", "up", "sum", "steps"))
        jumps.append(stage.put(doubled, f"jump-{len(jumps)}"))
        before, pending = pending, jumps[-1].where("up IS NOT NULL").count()
        if pending == before:  # only circles are left
            break
    whole = jumps[-1].where("up IS NULL").select("node", "sum", "steps")
    leaves = whole.join(nodes.select(F.col("parent").alias("node")).hint("merge"), "node", "left_anti")
    # unfold all leaves backwards: after k rounds a leaf has its last 2^k messages
    unfolded = leaves.select(F.col("node").alias("leaf"), "node", "sum", "steps", (F.col("steps") - 1).alias("place"))
    rooted = _rooted(unfolded, jumps, stage)
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc(F.col("sum") / F.col("steps")), "leaf"))
    chosen = stage.put(rooted.withColumn("rank", rank).where(F.col("rank") <= config.per_tree).select("root", "leaf", "steps"), "chosen")
    path = chosen.select("root", "leaf", F.col("leaf").alias("node"), (F.col("steps") - 1).alias("place"))
    for k, jump in enumerate(jumps):
        up = jump.where("up IS NOT NULL").select("node", "up").hint("merge")
        more = path.join(up, "node").select("root", "leaf", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        path = stage.put(path.union(more), f"path-{k}")
    return path


def _rooted(leaves: DataFrame, jumps: list[DataFrame], stage: Stage) -> DataFrame:
    """Adds each leaf's root, by the jumps that make up the binary digits of its depth."""
    at = leaves.select("leaf", "sum", "steps", F.col("leaf").alias("node"), "place")
    for k, jump in enumerate(jumps):
        up = jump.select("node", "up").hint("merge")
        takes = F.col("place").bitwiseAND(1 << k) != 0
        at = at.join(up, "node", "left").select("leaf", "sum", "steps", "place", F.when(takes, F.col("up")).otherwise(F.col("node")).alias("node"))
    return at.withColumnRenamed("node", "root")


def formatted(turns: DataFrame, key: list[str], order: list[str], config: Branches = Branches()) -> DataFrame:
    """One row per ``key``: ``formatted``, ``loss_spans`` and ``n_turns`` of ``turns(..., role, text)`` in ``order``.

    A null role or text counts as empty; every row is a turn, repeats too.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    piece = F.struct(*(F.col(c) for c in order), _turn(role, text).alias("turn"), F.when(role == config.learn, F.char_length(escape(text))).alias("learnt"))
    whole = turns.groupBy(*key).agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: t["turn"]), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state, t):
        end = state["at"] + F.char_length(t["turn"])
        span = F.struct((end - F.lit(len(END) + 1) - t["learnt"]).alias("start"), t["learnt"].alias("length"))
        return F.struct(end.alias("at"), F.when(t["learnt"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span))).alias("spans"))

    return whole.select(*key, joined.alias("formatted"), F.aggregate("turns", start, step)["spans"].alias("loss_spans"), F.size("turns").cast("long").alias("n_turns"))


def parse(text: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    parts = F.slice(F.split(text, re.escape(START), -1), 2, 1 << 30)

    def turn(p):
        line = F.instr(p, "\n")
        body = F.substring(p, line + 1, F.char_length(p) - line - len(END) - 1)
        return F.struct(unescape(F.replace(F.substring(p, F.lit(1), line - 1), F.lit(LINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def learnt(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")


def conversations(messages: DataFrame, config: Branches = Branches()) -> DataFrame:
    """Formats the best paths of reply trees: ``(root, leaf, formatted, loss_spans, n_turns)``.

    ``messages(node, parent, role, text, score)``; see ``paths`` for roots,
    ties and circles. Extra columns are ignored; an empty table gives no rows.
    """
    stage = Stage(messages.sparkSession, "chat")
    path = paths(messages, stage, config)
    turns = path.join(messages.select("node", "role", "text").hint("merge"), "node")
    return formatted(turns, ["root", "leaf"], ["place"], config)
