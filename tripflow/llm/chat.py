"""Conversations from reply trees, formatted with a reversible template.

Messages form trees by reply links. Iterative self-joins of the links, each doubling their reach, give every message its
ancestors 1, 2, 4, ... levels up; walking these from each leaf, longest reach first, enumerates every
root-to-leaf path once. Both take as many joins as the depth has binary digits, on message keys alone, without
texts. The branches of a tree are ranked by the mean score of their messages (ties: longer, then smaller
keys), and each chosen path is formatted. Texts are shuffled once, by tree.

The template marks a turn as ``<|role|>``, line break, text, ``<|end|>``, line break. In roles and texts every ``<``
becomes ``<\\`` and every ``[`` becomes ``[\\``, so neither the template's marks nor other control strings (``</s>``, ``[INST]``)
can stand in a text, and dropping those backslashes gives it back.

Defined cases: a null text or role is empty, a null score 0; rows of one conversation with equal turns follow each
other by role and a hash of the text; repeated rows of a message all stay, at its place; of several parents or scores
of a message the smallest count; null conversation ids form one conversation; a reply to an unknown message
starts a tree; messages on a cycle of replies, or below one, have no root and give no path; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import land

END = "<|end|>\n"
TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return text.replace("<\\", "<").replace("[\\", "[")


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the character spans that carry loss (texts of the assistant)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape(role).replace('|', '<bar>')}|>\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role.replace("<bar>", "|")), unescape(text)) for role, text in TURN.findall(formatted)]


def reaches(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, key, up) of the ancestors 1, 2, 4, ... levels up, and the rows that no root ends."""
    known = nodes.select(F.col("tree").alias("t"), F.col("key").alias("k"))
    replies = (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("k"))
    table = land(nodes.join(known, replies, "left_semi").select("tree", "key", F.col("parent").alias("up")), "reach")
    tables, rows = [], table.count()
    while rows:
        tables.append(table)
        further = table.select(F.col("tree").alias("t"), F.col("key").alias("k"), F.col("up").alias("over"))
        table = table.join(further, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("k")))
        table = land(table.select("tree", "key", F.col("over").alias("up")), "reach")
        before, rows = rows, table.count()
        if rows == before:  # a reach that ends at roots loses rows each time, so only cycles are left
            break
    return tables, table


def leaf_paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, path (message keys from the root), total score: every root-to-leaf path.

    ``messages``: tree (not null), key, parent (null or unknown for a root), score.
    """
    nodes = messages.groupBy("tree", "key").agg(F.min(F.struct("parent", "score")).alias("one"))
    nodes = nodes.select("tree", "key", "one.parent", F.coalesce("one.score", F.lit(0.0)).alias("score"))
    nodes = land(nodes, "messages")
    tables, endless = reaches(nodes)
    walk = nodes
    if tables:
        parents = tables[0].select(F.col("tree").alias("t"), F.col("up").alias("k")).distinct()
        here = (F.col("tree") == F.col("t")) & F.col("key").eqNullSafe(F.col("k"))
        walk = walk.join(parents, here, "left_anti")
        walk = walk.join(endless.select(F.col("tree").alias("t"), F.col("key").alias("k")), here, "left_anti")
    walk = walk.select("tree", F.col("key").alias("leaf"), "key", F.lit(0).alias("back"))
    for power in reversed(range(len(tables))):
        step = tables[power].select(F.col("tree").alias("t"), F.col("key").alias("k"), "up")
        joined = walk.join(step, (F.col("tree") == F.col("t")) & (F.col("key") == F.col("k")), "left")
        stay = F.struct("key", "back")
        go = F.struct(F.col("up").alias("key"), (F.col("back") + (1 << power)).alias("back"))
        both = F.when(F.col("up").isNull(), F.array(stay)).otherwise(F.array(stay, go))
        walk = joined.select("tree", "leaf", F.explode(both).alias("at")).select("tree", "leaf", "at.key", "at.back")
    scores = nodes.select(F.col("tree").alias("t"), F.col("key").alias("k"), "score")
    found = walk.join(scores, (F.col("tree") == F.col("t")) & F.col("key").eqNullSafe(F.col("k")))
    steps = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("place"), "key", "score")))
    return (
        found.groupBy("tree", "leaf")
        .agg(steps.alias("steps"))
        .select(
            "tree",
            "leaf",
            F.col("steps.key").alias("path"),
            F.aggregate("steps.score", F.lit(0.0), lambda total, score: total + score).alias("total"),
        )
    )


def tree_name(tree: str = "tree") -> Column:
    """The tree's id as a text; the null id is the empty text."""
    return F.coalesce(F.col(tree).cast("string"), F.lit(""))


def ranked_paths(messages: DataFrame, branches: int) -> DataFrame:
    ranked = Window.partitionBy("tree").orderBy(
        F.desc(F.col("total") / F.size("path")), F.desc(F.size("path")), F.col("path")
    )
    paths = leaf_paths(messages).withColumn("branch", F.row_number().over(ranked))
    return paths.where(F.col("branch") <= branches).select("tree", "branch", "path")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best paths of each tree: tree, branch (from 1), path."""
    kind = messages.schema["tree"].dataType
    named = messages.select(tree_name().alias("tree"), "key", "parent", "score")
    paths = ranked_paths(named, branches)
    return paths.withColumn("tree", F.when(F.col("tree") != "", F.col("tree")).cast(kind))


def chain_messages(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: tree, key, role, text.

    The key needs no other row, so the texts need not move to get it.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return conversations.select(
        F.col("conv_id").cast("long").alias("tree"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(text).alias("mark")).alias("key"),
        role.alias("role"),
        text.alias("text"),
    )


def chain_links(messages: DataFrame) -> DataFrame:
    """tree, key, parent, score: each message replies to the one before it in the order of the keys."""
    before = F.lag("key").over(Window.partitionBy("tree").orderBy("key"))
    keys = messages.select("tree", "key").repartition("tree").distinct()
    return keys.withColumns({"parent": before, "score": F.lit(1.0)})


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch, formatted text and loss spans of the chosen paths.

    ``messages``: tree, key, role, text and, for trees, parent and score. Without parents each message
    replies to the one before it in the order of the keys.
    """
    messages = messages.withColumn("tree", tree_name())
    links = messages if "parent" in messages.columns else chain_links(messages)
    chosen = ranked_paths(links.select("tree", "key", "parent", "score"), branches)
    places = chosen.select("tree", "branch", F.posexplode("path").alias("place", "key"))
    texts = messages.select(
        "tree", "key", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Dealt by tree, the texts meet their places and are then gathered without moving again.
    both = texts.unionByName(
        places.select("tree", "key", F.struct("branch", "place").alias("place")), allowMissingColumns=True
    ).repartition("tree")
    of_key = F.collect_list("place").over(Window.partitionBy("tree", "key"))
    placed = both.withColumn("places", of_key).where("text is not null").withColumn("place", F.explode("places"))
    gathered = placed.groupBy("tree", F.col("place.branch").alias("branch")).agg(
        F.sort_array(F.collect_list(F.struct("place.place", "role", "text"))).alias("turns")
    )
    gathered = gathered.withColumn("tree", F.when(F.col("tree") != "", F.col("tree")).cast("long"))

    def rows(batches):
        for batch in batches:
            made = [format_turns([(turn["role"], turn["text"]) for turn in turns]) for turns in batch["turns"]]
            frame = batch[["tree", "branch"]].assign(
                formatted=[text for text, _ in made], loss=[[list(span) for span in spans] for _, spans in made]
            )
            frame["tree"] = frame["tree"].astype("Int64")
            yield frame

    return gathered.mapInPandas(rows, "tree long, branch int, formatted string, loss array<array<long>>")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted text gives when it is read back."""

    def rows(batches):
        for batch in batches:
            out = []
            for tree, text, spans in zip(batch["tree"], batch["formatted"], batch["loss"], strict=True):
                turns = parse_turns(text)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                out.append(
                    (
                        tree, len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(loss),
                        hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text),
                    )
                )
            frame = pd.DataFrame(
                out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            )
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInPandas(rows, schema)
