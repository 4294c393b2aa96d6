"""Best-fit packing of documents into sequences of a fixed number of tokens.

The solver never sees documents, only how many pieces have each length (at most
``capacity`` rows). It first fixes small sets that dominate every alternative
(Martello and Toth), then best-fits the shrunken rest, both on whole runs of equal
pieces. Spark numbers the pieces of a length and looks up each one's place.

Defined cases: a null text is empty (only the end token); repeated rows and null ids are
packed as documents of their own; ties between equal pieces go by hash, id and piece;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import id_and_text, land, token_ids

CAPACITY = 1024
#: Pieces of one length are numbered in groups of about this many.
GROUP_ROWS = 5_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences that each hold ``items`` (lengths, longest first)."""

    items: tuple[int, ...]
    count: int


def dominating_set(counts: dict[int, int], sizes: list[int], big: int, capacity: int) -> Counter | None:
    """A set with ``big`` that is as good as any other set with it, or None.

    ``sizes`` are the lengths in stock, ascending. Cases: nothing fits beside it; one
    more piece at most fits, or one fills it exactly; two at most fit and either the
    largest single piece outweighs the best pair, or the best pair holds the largest
    piece and no feasible pair has a second piece above the pair's smaller one.
    """
    left = Counter({size: counts[size] for size in sizes})
    left[big] -= 1
    stock = [size for size in sizes if left[size] > 0]
    room = capacity - big
    if not stock or stock[0] > room:
        return Counter([big])
    largest = max(size for size in stock if size <= room)
    smallest: list[int] = []
    for size in stock:
        smallest += [size] * min(3 - len(smallest), left[size])
        if len(smallest) == 3:
            break
    if largest == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return Counter([big, largest])
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    best, high = (0, 0, 0), len(stock) - 1
    for low, size in enumerate(stock):
        while high >= low and (size + stock[high] > room or (high == low and left[size] < 2)):
            high -= 1
        if high < low:
            break
        best = max(best, (size + stock[high], stock[high], size))
    total, upper, lower = best
    if largest >= total:
        return Counter([big, largest])
    if upper != largest:
        return None
    above: list[int] = []
    for size in stock[bisect_left(stock, lower + 1) :]:
        above += [size] * min(2 - len(above), left[size])
        if len(above) == 2:
            break
    return Counter([big, upper, lower]) if len(above) < 2 or sum(above) > room else None


def reduce_by_dominance(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences fixed by dominance, and what is left of the histogram."""
    counts = {size: n for size, n in histogram.items() if n}
    fixed: list[Pattern] = []
    for big in sorted(counts, reverse=True):
        while counts.get(big):
            chosen = dominating_set(counts, sorted(counts), big, capacity)
            if chosen is None:
                break
            times = min(counts[size] // n for size, n in chosen.items())
            for size, n in chosen.items():
                counts[size] -= n * times
                if not counts[size]:
                    del counts[size]
            fixed.append(Pattern(tuple(sorted(chosen.elements(), reverse=True)), times))
    return fixed, counts


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on runs: each length fills the fullest open sequences it fits."""
    runs: dict[tuple[int, tuple[int, ...]], int] = {}
    order: list[tuple[int, tuple[int, ...]]] = []

    def open_run(room: int, items: tuple[int, ...], count: int) -> None:
        key = (room, items)
        if key not in runs:
            insort(order, key)
            runs[key] = 0
        runs[key] += count

    for size in sorted(histogram, reverse=True):
        todo, at = histogram[size], bisect_left(order, (size, ()))
        picked: list[tuple[tuple[int, tuple[int, ...]], int, int]] = []
        while todo and at < len(order):
            each = order[at][0] // size
            whole = min(runs[order[at]], todo // each)
            rest = todo - whole * each if whole < runs[order[at]] else 0
            if whole:
                picked.append((order[at], whole, each))
            if rest:
                picked.append((order[at], 1, rest))
            todo -= whole * each + rest
            at += 1
        for key, count, each in picked:
            runs[key] -= count
            if not runs[key]:
                del runs[key]
                order.pop(bisect_left(order, key))
            open_run(key[0] - each * size, key[1] + (size,) * each, count)
        each = capacity // size
        if todo >= each:
            open_run(capacity - each * size, (size,) * each, todo // each)
        if todo % each:
            open_run(capacity - todo % each * size, (size,) * (todo % each), 1)
    return [Pattern(key[1], count) for key, count in runs.items()]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_by_dominance(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids; of a longer document only the first may be shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        ids_of = token_ids(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = ids_of(text) + end
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                bounds = [0, *range(first, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(cut, PIECE_SCHEMA)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a landed table of pieces.

    Collects the histogram of lengths (at most ``capacity`` rows); the plan that goes
    to the tasks has its size bounded by ``capacity`` too.
    """
    spark = pieces.sparkSession
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {size: [] for size in histogram}
    used, sequence = Counter(), 0
    for pattern in plan_sequences(histogram, capacity):
        offset = 0
        for size, each in sorted(Counter(pattern.items).items(), reverse=True):
            slots[size].append((used[size], each, sequence, offset))
            used[size] += each * pattern.count
            offset += size * each
        sequence += pattern.count
    plan = spark.createDataFrame(
        [(size, -(-n // group_rows), [list(slot) for slot in slots[size]]) for size, n in histogram.items()],
        "length long, groups long, slots array<array<long>>",
    )
    numbered = (
        pieces.join(F.broadcast(plan.select("length", "groups")), "length")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "groups"))
        .withColumn(
            "place", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start")) - 1
        )
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        numbered.groupBy("length", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    rank = F.col("first") + F.col("place")
    slot = F.element_at(F.filter("slots", lambda one: one[0] <= F.col("rank")), -1)
    return (
        numbered.drop("groups")
        .join(firsts, ["length", "part"])
        .withColumn("rank", rank)
        .join(F.broadcast(plan.select("length", "slots")), "length")
        .withColumn("slot", slot)
        .withColumn("nth", F.col("rank") - F.col("slot")[0])
        .withColumn("sequence_id", F.col("slot")[2] + F.expr("nth div slot[1]"))
        .withColumn("offset", F.col("slot")[3] + F.col("nth") % F.col("slot")[1] * F.col("length"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack(land(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
