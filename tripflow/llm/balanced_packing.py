"""Cost-balanced packing of documents into training sequences.

A piece of ``n`` tokens costs ``LINEAR * n + n * n``: dense layers and attention inside the piece.
Pieces go, longest first, to the sequence of lowest cost that still has room. The solver sees only
how many pieces have each length (at most ``capacity`` rows) and works on runs: equal pieces and
sequences of equal load move together. A piece that fits nowhere is cut at a multiple of ``GRAIN``
tokens to fill the roomiest sequence, and its rest is assigned in turn, so hardly any token is padded.

Spark numbers the pieces of a length by task, without a sort, and looks up each one's places. The
checksum of a cut part follows from checksums kept every ``GRAIN`` tokens, so no text is read twice.

Defined cases: a null text is empty (only the end token); rows with a null or repeated id are
documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import id_and_text, land, token_ids

CAPACITY = 2048
#: Cost of a token outside attention, in units of one attended pair: six times a width of 768.
LINEAR = 4608
#: Pieces are cut only at multiples of this many tokens.
GRAIN = 8
#: Tasks are summed up in groups of this many before all of them are.
TASK_GROUP = 1000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, marks binary, task long, nth long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length: int) -> int:
    return LINEAR * length + length * length


@dataclass(frozen=True)
class Run:
    """``count`` pieces of length ``source``, from number ``first`` on, without their first ``start`` tokens."""

    source: int
    first: int
    count: int
    start: int
    cuts: int


@dataclass(frozen=True)
class Slot:
    """The parts of ``length`` tokens of a run, one in each of as many sequences in a row."""

    run: Run
    length: int
    sequence: int
    offset: int


class Sequences:
    """Open sequences by load: (cost, tokens used) -> intervals [first sequence, count]."""

    def __init__(self, capacity: int):
        self.capacity, self.total = capacity, 0
        self.loads: dict[tuple[int, int], list[list[int]]] = {}

    def open(self, count: int) -> None:
        self.loads.setdefault((0, 0), []).append([self.total, count])
        self.total += count

    def put(self, load: tuple[int, int], run: Run, length: int, slots: list[Slot]) -> tuple[tuple[int, int], Run | None]:
        """Put parts of a run in the sequences of a load; the load they have then and the run that is left."""
        then = (load[0] + cost(length), load[1] + length)
        intervals = self.loads[load]
        while intervals and run is not None:
            first, count = intervals.pop()
            took = min(count, run.count)
            slots.append(Slot(Run(run.source, run.first, took, run.start, run.cuts), length, first, load[1]))
            self.loads.setdefault(then, []).append([first, took])
            if took < count:
                intervals.append([first + took, count - took])
            left = run.count - took
            run = Run(run.source, run.first + took, left, run.start, run.cuts) if left else None
        if not intervals:
            del self.loads[load]
        return then, run


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> list[Slot]:
    """Places for all pieces of a histogram of lengths."""
    sequences, slots = Sequences(capacity), []
    sequences.open(-(-sum(size * n for size, n in histogram.items()) // capacity))
    waiting = defaultdict(list, {size: [Run(size, 0, n, 0, 0)] for size, n in histogram.items() if n})
    sizes = [-size for size in waiting]
    heapify(sizes)
    while sizes:
        size = -heappop(sizes)
        loads = [load for load in sequences.loads if load[1] + size <= capacity]
        heapify(loads)
        for run in waiting.pop(size):
            while run is not None:
                while loads and loads[0] not in sequences.loads:
                    heappop(loads)
                if loads:
                    then, run = sequences.put(loads[0], run, size, slots)
                    if then[1] + size <= capacity:
                        heappush(loads, then)
                    continue
                load = min(sequences.loads, key=lambda one: (one[1], one[0]), default=(0, capacity))
                head = (capacity - load[1]) // grain * grain
                if not head:
                    sequences.open(-(-run.count * size // capacity))
                    heappush(loads, (0, 0))
                    continue
                before = run
                _, run = sequences.put(load, run, head, slots)
                done = before.count - (run.count if run else 0)
                if size - head not in waiting:
                    heappush(sizes, head - size)
                waiting[size - head].append(Run(before.source, before.first, done, before.start + head, before.cuts + 1))
    return slots


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Pieces of ``capacity`` ids and one rest per document, numbered by task and length.

    ``marks`` holds the checksum of a rest after every ``grain`` ids. The numbers hold for a written table only.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        ids_of, task, seen = token_ids(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = ids_of(text) + end
                total = len(ids) // 4
                for a, b in pairwise([*range(0, total, capacity), total]):
                    piece, marks = ids[4 * a : 4 * b], []
                    if b - a < capacity:
                        check = 0
                        for at in range(0, len(piece) // (4 * grain) * 4 * grain, 4 * grain):
                            check = zlib.crc32(piece[at : at + 4 * grain], check)
                            marks.append(check)
                        check = zlib.crc32(piece[4 * grain * len(marks) :], check)
                    else:
                        check = zlib.crc32(piece)
                    rows.append((doc_id, a, b - a, check, total, np.array(marks, "<u4").tobytes(), task, seen[b - a]))
                    seen[b - a] += 1
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks", "task", "nth"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(cut, PIECES)


def apply_columns(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Product of a 32 x 32 bit matrix, given by its columns, with each value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def after_zeros(checks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The share of a checksum in that of its text followed by ``sizes`` more bytes.

    crc(AB) is that share of crc(A), xor crc(B); so crc(B) follows from the other two.
    """
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        odd = columns & np.uint32(1)
        columns = columns >> np.uint32(1) ^ np.where(odd, np.uint32(0xEDB88320), np.uint32(0))
    checks, sizes = checks.astype(np.uint32), sizes.copy()
    while sizes.any():
        checks = np.where(sizes & 1, apply_columns(columns, checks), checks)
        columns = apply_columns(columns, columns)
        sizes >>= 1
    return checks


#: More than the pieces of any length.
NUMBERS = np.int64(1) << np.int64(44)


def place_pieces(pieces: DataFrame, slots: list[Slot], grain: int = GRAIN) -> DataFrame:
    """One row per part of a numbered piece (column ``first``: pieces of its length in tasks before)."""
    depth = 1 + max((slot.run.cuts for slot in slots), default=0)
    levels = []
    for cuts in range(depth):
        level = sorted((s for s in slots if s.run.cuts == cuts), key=lambda s: (s.run.source, s.run.first))
        table = [(s.run.source, s.run.first, s.run.count, s.run.start, s.length, s.sequence, s.offset) for s in level]
        levels.append(np.array(table, np.int64).reshape(-1, 7).T)

    def place(batches):
        for frame in batches:
            source, number = frame["length"].to_numpy(np.int64), (frame["first"] + frame["nth"]).to_numpy(np.int64)
            for sources, firsts, counts, starts, lengths, sequences, offsets in levels:
                at = np.searchsorted(sources * NUMBERS + firsts, source * NUMBERS + number, "right") - 1
                place = np.maximum(at, 0)
                held = np.flatnonzero((at >= 0) & (sources[place] == source) & (number < firsts[place] + counts[place]))
                if not len(held):
                    continue
                place = place[held]
                a, b = starts[place], starts[place] + lengths[place]
                rows = frame.iloc[held]
                check = rows["ids_crc32"].to_numpy(np.uint32)
                cut = np.flatnonzero((a > 0) | (b < source[held]))
                if len(cut):
                    marks, begin, end = rows["marks"].to_numpy(), check[cut].copy(), check[cut].copy()
                    for k, row in enumerate(cut):
                        known = np.frombuffer(marks[row], "<u4")
                        begin[k] = known[a[row] // grain - 1] if a[row] else 0
                        if b[row] < source[held[row]]:
                            end[k] = known[b[row] // grain - 1]
                    check[cut] = end ^ after_zeros(begin, 4 * (b - a)[cut])
                yield pd.DataFrame(
                    {
                        "doc_id": rows["doc_id"].astype("Int64"), "start": rows["start"].to_numpy() + a, "length": b - a,
                        "ids_crc32": check.astype(np.int64), "doc_tokens": rows["doc_tokens"],
                        "sequence_id": sequences[place] + number[held] - firsts[place], "offset": offsets[place],
                    }
                )

    return pieces.mapInPandas(place, PLACED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Place the pieces of a written table. Collects the histogram of lengths (at most ``capacity`` rows)."""
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    counts = counts.withColumn("part", F.expr(f"task div {TASK_GROUP}"))
    within = Window.partitionBy("length", "part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("length", "part").agg(F.sum("n").alias("n"))
    parts = parts.select("length", "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    firsts = (
        counts.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(parts, ["length", "part"])
        .select("length", "task", (F.col("before") + F.col("inside")).alias("first"))
    )
    return place_pieces(pieces.join(firsts, ["length", "task"]), plan_slots(histogram, capacity, grain), grain)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Tokenize, cut and place whole documents."""
    return pack(land(token_pieces(docs, tokenizer, end_id, capacity, grain), "balanced-pieces"), capacity, grain)
