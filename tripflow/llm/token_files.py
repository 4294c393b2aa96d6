"""Token ids in Simple-8b blocks, written and read through Spark.

A row of the format is a segment: whole documents in ascending id order, their ids cut
into blocks of ``BLOCK`` ids. Each 64-bit word holds a 4-bit selector and as many ids as
its 60 bits take (``COUNTS`` and ``WIDTHS``); selector 15 is an escape, the next word holds
one value of more than 60 bits. ``block_words`` gives the first word of each block, so
blocks decode on their own, and all words of one selector decode in one numpy step.

Defined cases: a null text is empty (only the end token); repeated rows and null ids are
kept, null ids first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripflow.llm.common import id_and_text, token_ids

BLOCK = 256
SEGMENT_IDS = 1 << 18
# Fixed values of the coding: ids and bits per id of the selectors 1 to 14.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = 15
SHORT_BITS = np.array([max(1, value.bit_length()) for value in range(1 << 16)], np.uint8)
SEGMENT_SCHEMA = (
    "shard int, segment int, first_id long, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
    "block_words binary, words binary"
)
DOCUMENT_SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned value, 1 at least."""
    if not len(values) or values.max() < 1 << 16:
        return SHORT_BITS[values]
    out = np.ones(len(values), np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        over = values >> np.uint64(shift)
        big = over > 0
        out[big] += np.uint8(shift)
        values = np.where(big, over, values)
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block."""
    values = np.asarray(values, np.uint64)
    count = len(values)
    blocks = -(-count // block)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    widest = int(COUNTS.max())
    grid = np.zeros((blocks, block + widest), np.uint64)
    flat = np.zeros(blocks * block, np.uint64)
    flat[:count] = values
    grid[:, :block] = flat.reshape(blocks, block)
    bits = np.ones(grid.shape, np.uint8)
    bits[:, :block] = bit_lengths(flat).reshape(blocks, block)
    # The selector of a word that starts at an id: the one that takes most ids from there. Where one fits, so do all above
    # it, which take fewer and wider ids; so it is the escape less the number that fit.
    selector = np.full((blocks, block), ESCAPE, np.uint8)
    reach, window = 1, bits.copy()
    for code in range(14, 0, -1):
        size = int(COUNTS[code])
        while reach < size:
            step = min(reach, size - reach)
            window = np.maximum(window[:, : window.shape[1] - step], window[:, step:])
            reach += step
        fits = window[:, :block] <= int(WIDTHS[code])
        if not fits.any():  # then no longer and narrower word fits either
            break
        selector -= fits.view(np.uint8)
    ends = np.full(blocks, block)
    ends[-1] = count - (blocks - 1) * block
    # All blocks go on word by word; ``taken`` holds the selector at each id where a word starts.
    chosen, taken = selector.reshape(-1), np.zeros(blocks * block, np.uint8)
    at, ends = np.arange(blocks) * block, np.arange(blocks) * block + ends
    while len(at):
        now = chosen[at]
        taken[at] = now
        at = at + COUNTS[now]
        stay = at < ends
        at, ends = at[stay], ends[stay]
    start = np.flatnonzero(taken)
    code = taken[start].astype(np.int64)
    row, source = start // block, grid.reshape(-1)
    start = start + row * widest
    length = 1 + (code == ESCAPE)
    place = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), np.uint64)
    for one in np.unique(code):
        mine = np.flatnonzero(code == one)
        if one == ESCAPE:
            words[place[mine]] = ESCAPE
            words[place[mine] + 1] = source[start[mine]]
            continue
        size, width = int(COUNTS[one]), int(WIDTHS[one])
        first, word = start[mine], np.full(len(mine), one, np.uint64)
        for k in range(size):
            word |= source[first + k] << np.uint64(4 + width * k)
        words[place[mine]] = word
    firsts = place[np.searchsorted(row, np.arange(blocks))]
    return words, firsts.astype(np.uint32)


def decode(words: np.ndarray, block_words: np.ndarray, count: int, block: int = BLOCK) -> np.ndarray:
    """Inverse of ``encode``."""
    blocks = len(block_words)
    if not blocks:
        return np.zeros(0, np.uint64)
    code = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(code == ESCAPE):  # an escaped value may itself look like an escape
        raw[at + 1 : at + 2] |= not raw[at]
    places = np.flatnonzero(~raw)
    code = code[places]
    owner = np.searchsorted(block_words, places, side="right") - 1
    total = np.cumsum(COUNTS[code]) - COUNTS[code]
    starts = np.searchsorted(owner, np.arange(blocks))
    start = total - total[starts][owner]
    out = np.zeros((blocks, block + int(COUNTS.max())), np.uint64)
    for one in np.unique(code):
        mine = np.flatnonzero(code == one)
        if one == ESCAPE:
            out[owner[mine], start[mine]] = words[places[mine] + 1]
            continue
        size, width = int(COUNTS[one]), int(WIDTHS[one])
        shifts = (4 + width * np.arange(size)).astype(np.uint64)
        ids = (words[places[mine]][:, None] >> shifts) & np.uint64((1 << width) - 1)
        out[owner[mine][:, None], start[mine][:, None] + np.arange(size)] = ids
    return out[:, :block].reshape(-1)[:count]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every document and write segments, sharded by ranges of ids."""
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches):
        ids_of, shard = token_ids(tokenizer), TaskContext.get().partitionId()
        state = {"first": 0, "segment": 0}
        doc_ids: list = []
        parts: list[bytes] = []

        def close():
            ids = np.frombuffer(b"".join(parts), "<u4")
            words, block_words = encode(ids)
            row = (
                shard, state["segment"], state["first"], len(ids), list(doc_ids), [len(part) // 4 for part in parts],
                block_words.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
            )
            state["first"] += len(ids)
            state["segment"] += 1
            doc_ids.clear()
            parts.clear()
            return pd.DataFrame([row], columns=[field.split()[0] for field in SEGMENT_SCHEMA.split(", ")])

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                parts.append(ids_of(text) + end)
                held += len(parts[-1])
                if held >= 4 * SEGMENT_IDS:
                    yield close()
                    held = 0
        if parts:
            yield close()

    (
        id_and_text(docs)
        .withColumn("doc_id", F.col("doc_id").cast("long"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInPandas(segments, SEGMENT_SCHEMA)
        .write.parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def documents(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                words = np.frombuffer(row.words, "<u8")
                ids = decode(words, np.frombuffer(row.block_words, "<u4"), row.n_ids).astype("<u4")
                lengths = np.asarray(row.doc_lengths, np.int64)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - lengths, ends, strict=True)]
                yield pd.DataFrame(
                    {
                        "shard": row.shard,
                        "doc_id": pd.array(list(row.doc_ids), "Int64"),
                        "local_start": row.first_id + ends - lengths,
                        "n_tokens": lengths,
                        "ids_crc32": sums,
                    }
                )

    segments = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard: as many as the write had tasks.
    firsts = (
        segments.groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    return (
        segments.mapInPandas(documents, DOCUMENT_SCHEMA)
        .join(F.broadcast(firsts), "shard")
        .select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
    )
