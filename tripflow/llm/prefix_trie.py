"""Prefix trie of rebuilt conversations from composable fingerprints.

A rebuilt conversation is a head of another one (its base) and a suffix of its own. A sequence of turns
has the fingerprint ``sum(h(turn) * B ** place)`` modulo 2 ** 64 and its length. Such pairs form a monoid:
``(x, m) (y, n) = (x + B ** m * y, m + n)``, and as ``B`` is odd, a common beginning can be taken off again. So the
fingerprint of each rebuilt prefix follows from stored sums over the original conversations: no rebuilt text is ever
written. Two sums with different bases make 128 bits.

Prefixes of equal depth and fingerprint are one node. Every prefix refers to the stored turn that ends it; where a node
has several such turns, their roles and texts are compared as a whole. As a fingerprint and its last turn give the
fingerprint before, equal last turns at all depths mean equal sequences. If a node fails, all is done anew with other bases.

Running sums go over ranges of (conversation, place), not over whole conversations, so one conversation may hold
most rows; nodes are partial aggregates. Sums over subtrees need no walk: a node is owned by its smallest member, all nodes
above lie on that member's path, so a node's total is the sum, over its members, of what each owns from that depth on.

Defined cases: a null role or text is empty; a null turn comes first; rows of equal turn follow by role and a hash
of both; repeated rows are turns of their own; rows without conv_id belong to no conversation; a base is
``conv_id - conv_id % 100`` with the sign of SQL's remainder; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import land, seeded

#: A base lends at most this many turns less one; bases are the conversations whose number ends so.
HEADS, HUNDRED = 6, 100
#: Conversation numbers per piece of a joined list.
CHUNK = 4096
NODE = ["depth", "x", "y"]


def bases(attempt: int) -> np.ndarray:
    """Two odd bases, 5 modulo 8: their powers repeat only after 2 ** 62 places."""
    return seeded(2, 31 + attempt) & ~np.uint64(7) | np.uint64(5)


def powers(base: np.uint64, places: np.ndarray) -> np.ndarray:
    """``base ** place`` modulo 2 ** 64; a negative place gives the inverse's power."""
    out = np.ones(len(places), np.uint64)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    for factor, left in ((base, np.maximum(places, 0)), (inverse, np.maximum(-places, 0))):
        left, factor = left.copy(), int(factor)
        while left.any():
            out = np.where(left & 1, out * np.uint64(factor), out)
            factor, left = factor * factor % (1 << 64), left >> 1
    return out


def stored_turns(conversations: DataFrame) -> DataFrame:
    """A written table of turns with a number, nulls replaced."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return land(turns.withColumn("ref", F.monotonically_increasing_id()), "turns")


def hashed_turns(turns: DataFrame) -> DataFrame:
    """Two hashes of role and text and the code points of the text, without the text."""

    def digest(batches):
        for frame in batches:
            whole = [xxhash.xxh3_128_digest(role.encode() + b"\xff" + text.encode()) for role, text in zip(frame["role"], frame["text"], strict=True)]
            lanes = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
            chars = frame["text"].str.len().to_numpy(np.int64)
            yield frame[["conv_id", "turn", "role", "ref"]].assign(a=lanes[:, 0], b=lanes[:, 1], chars=chars)

    return turns.mapInPandas(digest, "conv_id long, turn long, role string, ref long, a long, b long, chars long")


def numbered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """A written table with ``place`` (from 1) of each row in its key, sorted by ranges, not by keys.

    The ranges split a key of any size. Only keys that span ranges need the counts of the ranges before.
    """
    sort = [F.col(key), *order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)

    def count(batches):
        task, last, place = TaskContext.get().partitionId(), None, 0
        for frame in batches:
            keys = frame[key].to_numpy(np.int64)
            if len(keys):
                fresh = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
                starts = np.where(fresh, np.arange(len(keys)), 0)
                at = np.arange(len(keys)) - np.maximum.accumulate(starts)
                lead = len(keys) if not fresh.any() else int(fresh.argmax())
                at[:lead] += place
                last, place = keys[-1], int(at[-1]) + 1
                yield frame.assign(place=at + 1, task=task)

    schema = rows.schema.add("place", "long").add("task", "long")
    return land(ranged.mapInPandas(count, schema), name)


def with_places(rows: DataFrame, key: str) -> DataFrame:
    """``place`` over the whole key, from the places in each range."""
    counts = rows.groupBy(key, "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # One row per range that a key reaches: a key that fills k ranges has k rows here.
    carried = counts.withColumn("carry", F.coalesce(before, F.lit(0))).where("carry > 0").select(key, "task", "carry")
    joined = rows.join(carried, [key, "task"], "left")
    return joined.withColumn("place", F.col("place") + F.coalesce("carry", F.lit(0))).drop("carry")


def fingerprints(turns: DataFrame, attempt: int) -> DataFrame:
    """Own fingerprints before (``px``, ``py``) and after (``x``, ``y``) each original turn, by ranges of a conversation."""
    lanes = bases(attempt)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        task = TaskContext.get().partitionId()
        for frame in batches:
            if not len(frame):
                continue
            keys, places = frame["conv_id"].to_numpy(np.int64), frame["place"].to_numpy(np.int64)
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            group = np.cumsum(first) - 1
            columns, carry = {}, sums.get(int(keys[0]), np.zeros(2, np.uint64))
            ends = np.zeros(2, np.uint64)
            for lane, (value, out) in enumerate((("a", "x"), ("b", "y"))):
                terms = frame[value].to_numpy(np.int64).view(np.uint64) * powers(lanes[lane], places)
                total = np.cumsum(terms, dtype=np.uint64)
                before = total - terms
                base = before[first][group]
                start = np.where(group == 0, carry[lane], np.uint64(0))
                columns[out], columns["p" + out] = (total - base + start).view(np.int64), (before - base + start).view(np.int64)
                ends[lane] = columns[out].view(np.uint64)[-1]
            sums = {int(keys[-1]): ends}
            yield frame[["conv_id", "place", "ref", "chars"]].assign(task=task, **columns)

    schema = "conv_id long, place long, ref long, chars long, task long, x long, y long, px long, py long"
    sort = ["conv_id", "place"]
    rows = turns.select("conv_id", "place", "ref", "chars", "a", "b").repartitionByRange(*sort).sortWithinPartitions(*sort)
    local = land(rows.mapInPandas(run, schema), "sums")
    # Add what the ranges before hold of the same conversation; modulo 2 ** 64 through 128-bit sums.
    last = local.groupBy("conv_id", "task").agg(F.max_by(F.struct("x", "y"), "place").alias("end"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    for lane in ("x", "y"):
        last = last.withColumn("c" + lane, wrapped(F.sum(F.col(f"end.{lane}").cast("decimal(38,0)")).over(before)))
    carried = last.where("cx IS NOT NULL").select("conv_id", "task", "cx", "cy")
    joined = local.join(carried, ["conv_id", "task"], "left")
    for lane in ("x", "y"):
        carry = F.coalesce("c" + lane, F.lit(0))
        joined = joined.withColumn(lane, plus(F.col(lane), carry)).withColumn("p" + lane, plus(F.col("p" + lane), carry))
    return joined.drop("task", "cx", "cy")


WHOLE = "decimal(38,0)"


def wrapped(value: Column) -> Column:
    """A whole decimal as a signed 64-bit number modulo 2 ** 64."""
    size, half = (F.lit(str(1 << bits)).cast(WHOLE) for bits in (64, 63))
    low = F.pmod(value.cast(WHOLE), size)
    return F.when(low >= half, low - size).otherwise(low).cast("long")


def plus(left: Column, right: Column) -> Column:
    return F.when(right == 0, left).otherwise(wrapped(left.cast(WHOLE) + right.cast(WHOLE)))


def rebuilt_prefixes(prints: DataFrame, attempt: int) -> DataFrame:
    """One row per conversation and prefix of its rebuilt form, the empty one included.

    Columns: conv_id, depth, x, y, px, py (the fingerprint one turn before), ref and chars of the last turn, is_end.
    """
    lanes = bases(attempt)
    fields = ["place", "x", "y", "px", "py", "ref", "chars"]
    heads = prints.groupBy("conv_id").agg(
        F.max("place").alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("place") < HEADS, F.struct(*fields)))).alias("head"),
    )
    heads = heads.withColumn("lent", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)))
    base = heads.select(F.col("conv_id").alias("base_id"), F.col("head").alias("base"))
    heads = heads.withColumn("base_id", F.expr(f"conv_id - conv_id % {HUNDRED}")).join(base, "base_id", "left")
    kept = F.expr("slice(coalesce(base, array()), 1, lent)")
    heads = heads.withColumn("kept", kept).withColumn("n_kept", F.size("kept").cast("long"))
    heads = heads.withColumn("length", F.col("n_kept") + F.greatest(F.col("turns") - F.col("lent"), F.lit(0)))
    heads = land(heads.drop("base"), "heads")

    empty = heads.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in fields[1:]], "length")
    head = heads.select("conv_id", F.explode("kept").alias("k"), "length")
    head = head.select("conv_id", F.col("k.place").alias("depth"), *[f"k.{c}" for c in fields[1:]], "length")

    # An own suffix is moved from behind its own head to behind the base's: (sum - own head) * B ** (kept - lent) + base head.
    joints = heads.where("turns > lent").select(
        "conv_id",
        "lent",
        "n_kept",
        "length",
        *[F.when(F.col("lent") == 0, 0).otherwise(F.element_at("head", F.greatest("lent", F.lit(1)).cast("int"))[c]).cast("long").alias("o" + c) for c in "xy"],
        *[F.when(F.col("n_kept") == 0, 0).otherwise(F.element_at("kept", -1)[c]).cast("long").alias("k" + c) for c in "xy"],
    )
    suffix = prints.join(joints, "conv_id").where("place > lent")

    def move(batches):
        for frame in batches:
            shift = (frame["n_kept"] - frame["lent"]).to_numpy(np.int64)
            columns = {"depth": frame["place"].to_numpy(np.int64) + shift}
            for lane, c in enumerate("xy"):
                factor = powers(lanes[lane], shift)
                own, kept = (frame[k + c].to_numpy(np.int64).view(np.uint64) for k in "ok")
                for out in (c, "p" + c):
                    value = frame[out].to_numpy(np.int64).view(np.uint64)
                    columns[out] = ((value - own) * factor + kept).view(np.int64)
            yield frame[["conv_id", "ref", "chars", "length"]].assign(**columns)

    schema = "conv_id long, depth long, x long, y long, px long, py long, ref long, chars long, length long"
    own = suffix.mapInPandas(move, schema)
    rows = empty.unionByName(head).unionByName(own)
    return land(rows.withColumn("is_end", F.col("depth") == F.col("length")).drop("length"), "prefixes")


def equal_by_turns(prefixes: DataFrame, turns: DataFrame) -> bool:
    """Whether the prefixes of each node end in turns of the same role and text."""
    ends = prefixes.where("depth > 0").groupBy(*NODE, "ref").agg(F.lit(1).alias("one"))
    several = ends.groupBy(*NODE).agg(F.count("*").alias("n")).where("n > 1")
    asked = ends.join(several, NODE, "left_semi").select(*NODE, "ref")
    texts = asked.join(turns.select("ref", "role", "text"), "ref").groupBy(*NODE)
    bounds = texts.agg(*[f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in ("role", "text")])
    return bounds.where("minrole <> maxrole OR mintext <> maxtext").isEmpty()


def joined_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined conversation numbers per node.

    Ranges of (node, number) join pieces of at most ``CHUNK`` numbers; the digest reads a node's pieces in order.
    """
    columns = [*NODE, "conv_id"]
    ranged = ends.select(columns).repartitionByRange(*columns).sortWithinPartitions(*columns)

    def pieces(batches):
        for frame in batches:
            place = frame.groupby(NODE, sort=False).cumcount() // CHUNK
            grouped = frame.groupby([*NODE, place.rename("piece")], sort=False)["conv_id"]
            out = grouped.agg(first="min", numbers=lambda ids: ",".join(map(str, ids))).reset_index()
            yield out[[*NODE, "first", "numbers"]]

    schema = "depth long, x long, y long, first long, numbers string"
    parts = ranged.mapInPandas(pieces, schema)

    def digest(batches):
        node, state = None, None
        for frame in batches:
            rows = []
            for depth, x, y, _, numbers in frame.itertuples(index=False):
                if (depth, x, y) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        rows.append((*node, state.hexdigest()))
                    node, state = (depth, x, y), hashlib.sha256()
                state.update(numbers.encode())
            yield pd.DataFrame(rows, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    sort = [*NODE, "first"]
    return parts.repartition(*NODE).sortWithinPartitions(*sort).mapInPandas(digest, "depth long, x long, y long, ends_sha256 string")


def trie(prefixes: DataFrame) -> DataFrame:
    """The nodes of a table of verified prefixes."""
    nodes = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min(F.struct("px", "py")).alias("parent"),
        F.max("chars").alias("chars"),
        F.count_if("is_end").alias("n_ends"),
        F.min(F.when(F.col("is_end"), F.col("conv_id"))).alias("end"),
    )
    nodes = nodes.withColumn("px", F.col("parent.px")).withColumn("py", F.col("parent.py")).drop("parent")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
    nodes = nodes.join(children.agg(F.count("*").alias("n_children")), NODE, "left")
    nodes = land(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # Alone, a prefix saves nothing and leads to one leaf: only members of shared nodes are summed up.
    shared = nodes.where("n_convs > 1").select(*NODE, F.col("conv_id").alias("owner"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    members = land(prefixes.select(*NODE, "conv_id").join(shared, NODE), "members")
    owned = numbered(members.where("conv_id = owner").select("conv_id", "depth", "saved"), "conv_id", [F.col("depth")], "owned")
    totals = owned.groupBy("conv_id", "task").agg(F.sum("saved").alias("part"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("task"))
    totals = totals.withColumn("up_to", F.sum("part").over(after))
    by_range = Window.partitionBy("conv_id", "task").orderBy(F.desc("depth"))
    from_here = (
        owned.withColumn("inside", F.sum("saved").over(by_range))
        .join(totals, ["conv_id", "task"])
        .select("conv_id", "depth", (F.col("inside") + F.col("up_to") - F.col("part")).alias("from_here"))
    )
    all_owned = owned.groupBy("conv_id").agg(F.sum("saved").alias("all_saved"))
    leaves = nodes.where("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    own = members.where("conv_id = owner").join(from_here, ["conv_id", "depth"]).withColumnRenamed("from_here", "saves")
    other = members.where("conv_id <> owner").join(all_owned, "conv_id", "left").withColumnRenamed("all_saved", "saves")
    sums = (
        own.unionByName(other.select(own.columns))
        .join(leaves, "conv_id", "left")
        .groupBy(*NODE)
        .agg(F.sum(F.coalesce("saves", F.lit(0))).alias("saved_tokens"), F.count("leaf").alias("n_leaves"))
    )

    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id")
    )
    several = joined_ends(prefixes.where("is_end").join(nodes.where("n_ends > 1").select(*NODE), NODE, "left_semi"))
    one = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256)
    return (
        nodes.join(parents, ["depth", "px", "py"], "left")
        .join(sums, NODE, "left")
        .join(several, NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", one).alias("ends_sha256"),
        )
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations: see the module."""
    turns = stored_turns(conversations)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b"), F.col("ref")]
    placed = with_places(numbered(hashed_turns(turns), "conv_id", order, "placed"), "conv_id")
    attempt = 0
    while True:
        prefixes = rebuilt_prefixes(land(fingerprints(placed, attempt), "fingerprints"), attempt)
        if equal_by_turns(prefixes, turns):
            return trie(prefixes)
        attempt += 1
