"""Removal of byte strings that repeat, by windows at content anchors.

No suffix array or longest-previous-factor array is built: a full one has a row per byte. Every window of
``LENGTH`` bytes has an anchor: the place in it whose ``GRAM``-byte hash is smallest. Equal windows have the same
anchor at the same place, so a repeated window has an anchor whose gram occurs twice (one row in about
``(LENGTH - GRAM) / 2`` bytes). Windows with one anchor form a cell. A cell whose whole span
occurs elsewhere repeats as a whole; of the other cells with a common gram the single windows are sorted
by gram hash, 64-bit hash of their bytes and position, and neighbours with equal hashes are repeats;
the bytes themselves are not compared. A gram with very many contents is split: there
a count and a first position per window content, both partial aggregates, say the same.

Defined cases: a null text is empty; a text shorter than ``LENGTH`` loses nothing; repeated rows are copies of each
other; null ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import id_and_text, land, mix, seeded

LENGTH = 200
GRAM = 64
#: Odd base of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = seeded(256, 3)
CELLS = "row long, first int, last int, gram long, span long, copy boolean, many boolean"
#: Contents of one gram that a task compares; grams with more are split by content.
GROUP_CELLS = 2_000


def powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count + 1, base % (1 << 64), np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class Rolling:
    """Hashes of all windows of a byte string, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        up = powers(BASE, len(data))
        np.cumsum(BYTE_VALUES[data] * up[:-1], out=self.sums[1:])
        self.down = powers(pow(BASE, -1, 1 << 64), len(data))

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        count = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:count]) * self.down[:count] + np.uint64(size))


def cells_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window start, gram hash and span hash of each cell of one text."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(data)
    hashes = rolling.windows(gram)
    bits = max(24, int(len(hashes)).bit_length())  # one mask for all but enormous texts
    mask = np.uint64((1 << bits) - 1)
    low = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    reach, width = 1, length - gram + 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    anchor = (low & mask).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    return first, last, hashes[anchor[first]], rolling.spans(first, last + length)


def text_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def packed_texts(texts: DataFrame) -> DataFrame:
    """The texts compressed, so that a shuffle moves less."""

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data = [squeeze(text.encode("utf-8", "surrogatepass")) for text in batch["text"]]
            frame = batch[["row"]].assign(doc_id=batch["doc_id"].astype("Int64"), data=data)
            yield frame

    return texts.mapInPandas(pack, "row long, doc_id long, data binary")


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def equal_windows(grams: np.ndarray, contents: np.ndarray, rows: np.ndarray, starts: np.ndarray, keep_first: bool) -> np.ndarray:
    """Which windows have an equal one (before them, in position order, for ``keep_first``)."""
    order = np.lexsort((starts, rows, contents, grams))
    same = (grams[order][1:] == grams[order][:-1]) & (contents[order][1:] == contents[order][:-1])
    previous, following = np.append(False, same), np.append(same, False)
    out = np.zeros(len(order), bool)
    out[order] = previous if keep_first else previous | following
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept text.

    ``docs`` is a stored table: its rows are numbered by their place in its files, the same in each
    scan. ``keep_first`` leaves a window alone where no equal one stands before it (by row, then place).
    """
    texts = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = texts.withColumn("row", F.monotonically_increasing_id())

    def find_cells(batches):
        for batch in batches:
            parts = []
            for row, text in zip(batch["row"], batch["text"], strict=True):
                first, last, grams, spans = cells_of(text_bytes(text), length, gram)
                if len(first):
                    parts.append((np.full(len(first), row), first, last, signed(grams), signed(spans)))
            if parts:
                columns = [np.concatenate(column) for column in zip(*parts, strict=True)]
                frame = pd.DataFrame(dict(zip(["row", "first", "last", "gram", "span"], columns, strict=True)))
                # Copies inside the batch are settled here; one of each goes on, as the first of its kind.
                again = frame.duplicated(["gram", "span"])
                many = frame.duplicated(["gram", "span"], keep=False)
                yield frame.assign(copy=again, many=many)

    def find_contexts(batches):
        for batch in batches:
            parts = []
            for row, data, cells in zip(batch["row"], batch["data"], batch["cells"], strict=True):
                text = unpacked(data)
                parts += [
                    (row, cell["first"], cell["last"], cell["gram"], text[cell["first"] : cell["last"] + length].tobytes())
                    for cell in cells
                ]
            yield pd.DataFrame(parts, columns=["row", "first", "last", "gram", "context"])

    def windows_of(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
        found = [Rolling(np.frombuffer(context, np.uint8)).windows(length) for context in frame["context"]]
        sizes = np.array([len(one) for one in found])
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = np.repeat(frame["first"].to_numpy(), sizes) + within
        return np.repeat(frame["gram"].to_numpy(), sizes), signed(np.concatenate(found)), np.repeat(frame["row"].to_numpy(), sizes), starts

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        grams, contents, rows, starts = windows_of(frame)
        hit = equal_windows(grams, contents, rows, starts, keep_first)
        rows, starts = rows[hit], starts[hit]
        order = np.lexsort((starts, rows))
        rows, starts = rows[order], starts[order]
        head = np.append(True, (np.diff(rows) != 0) | (np.diff(starts) > 1))[: len(rows)]
        tail = np.append(head[1:], True)[: len(rows)]
        return pd.DataFrame({"row": rows[head], "first": starts[head], "last": starts[tail]})

    def settle_small(batches):
        held = None
        for batch in batches:  # sorted by gram; a gram that may go on waits for the next batch
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            open_gram = held["gram"] == held["gram"].iloc[-1]
            if not open_gram.all():
                yield settle(held[~open_gram])
                held = held[open_gram]
        if held is not None and len(held):
            yield settle(held)

    def explode_windows(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame(dict(zip(["gram", "content", "row", "start"], windows_of(batch), strict=True)))

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, packed, spans in zip(batch["doc_id"], batch["data"], batch["spans"], strict=True):
                data = unpacked(packed)
                change = np.zeros(len(data) + 1, np.int32)
                for span in spans if spans is not None else ():
                    change[span["first"]] += 1
                    change[span["last"] + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = data[~gone].tobytes()
                runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                rows.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    cells = land(texts.select("row", "text").mapInPandas(find_cells, CELLS), "cells")
    by_gram, by_span = Window.partitionBy("gram"), Window.partitionBy("gram", "span")
    placed = land(
        cells.where("not copy")
        .drop("copy")
        .withColumn("nth", F.row_number().over(by_span.orderBy("row", "first")))
        .withColumn("copied", F.col("many") | (F.count("*").over(by_span) > 1))
        .withColumn("contents", F.sum(F.when(F.col("nth") == 1, 1)).over(by_gram))
        .where("copied or contents > 1")
        .select("row", "first", "last", "gram", "contents", "copied", (F.col("nth") == 1).alias("head")),
        "placed",
    )
    whole = placed.where(F.col("copied") & ~F.col("head") if keep_first else F.col("copied")).select("row", "first", "last")
    whole = whole.unionByName(cells.where("copy").select("row", "first", "last"))
    # One cell of each content decides the single windows of cells that do not repeat as a whole.
    wanted = placed.where("contents > 1 and head").groupBy("row").agg(
        F.collect_list(F.struct("first", "last", "gram")).alias("cells")
    )
    contexts = (
        packed_texts(texts)
        .join(wanted, "row")
        .select("row", "data", "cells")
        .mapInPandas(find_contexts, "row long, first int, last int, gram long, context binary")
    )
    hot = placed.where(F.col("contents") > GROUP_CELLS).select("gram").distinct().withColumn("hot", F.lit(True))
    contexts = land(contexts.join(hot, "gram", "left"), "contexts")
    small = (
        contexts.where("hot is null")
        .select("row", "first", "gram", "context")
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInPandas(settle_small, "row long, first int, last int")
    )
    # Grams with very many contents are split by the content of each window.
    windows = contexts.where("hot").mapInPandas(explode_windows, "gram long, content long, row long, start int")
    equal = windows.groupBy("gram", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("previous")
    ).where("n > 1")
    single = windows.join(equal, ["gram", "content"])
    if keep_first:
        single = single.where((F.col("previous.row") != F.col("row")) | (F.col("previous.start") != F.col("start")))
    single = single.select("row", F.col("start").alias("first"), F.col("start").alias("last"))
    spans = whole.unionByName(small).unionByName(single).groupBy("row").agg(
        F.collect_list(F.struct("first", "last")).alias("spans")
    )
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return packed_texts(texts).join(spans, "row", "left").mapInPandas(cut, result)
