"""Quality rules: base counts of each text, and lines that recur over the documents of a host.

Lines are normalised (A-Z lower-cased, white space to one space) and hashed. A line goes if, within one
host, it stands in more than ``LINE_LIMIT`` documents. Documents count as different when any of
their normalised lines differ: copies of one document are the business of near-duplicate removal
and do not turn its lines into boilerplate. The lines that go are taken out of each text. A document is depleted, and rejected, if the lines that go hold more than
``DEPLETED`` per cent of its words.

Defined cases: a null or blank text has no words and fails; repeated rows are judged each on its own;
a null host is a host of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import TEXT_ROWS, drop, few_files, land, shingle_hashes, word_hashes

LINE_LIMIT = 20
DEPLETED = 80
MIN_WORDS = 10
REPEATED = 20
SYMBOLS = "#*$%&|<>"
SPACES = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LINES = "doc_id long, host string, text_key binary, whole binary, lines array<struct<line: string, words: long>>"
#: Bits of the map of rows that may lose lines, and bits in a row of it (what ``bitmap_construct_agg`` holds).
MAP_BITS, MAP_ROW = 1 << 23, 1 << 15


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    if len(words) < size + 1:
        return 0
    hashes = shingle_hashes(word_hashes(words), size)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:-size][twice] += 1
    np.subtract.at(cover, np.flatnonzero(twice) + size, 1)
    return int((np.cumsum(cover) > 0).sum())


def judge_text(text: str) -> tuple:
    """The base counts of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    filled = [line for line in raw.split(b"\n") if line.split(None, 1)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(filled) - len(set(filled)),
        repeat_words(words),
    )


def lines_of(text: str) -> tuple:
    """The hash of all normalised lines, and the distinct ones with their words, of one text."""
    seen: dict[bytes, int] = {}
    whole = hashlib.md5()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        parts = line.lower().split()
        if parts:
            key = b" ".join(parts)
            seen[key] = seen.get(key, 0) + len(parts)
            whole.update(key + b"\n")
    return whole.digest(), [(hashlib.md5(key).hexdigest()[:16], count) for key, count in seen.items()]


def base_counts(text: Column) -> Column:
    def rows(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge_text(text) for text in texts], columns=COUNTS)

    return F.pandas_udf(rows, ", ".join(f"{name} long" for name in COUNTS))(text)


def line_features(docs: DataFrame, host: str) -> DataFrame:
    def rows(batches):
        for batch in batches:
            frame = pd.DataFrame([lines_of(text) for text in batch["text"]], columns=["whole", "lines"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            frame.insert(1, "host", batch["host"].to_numpy())
            frame.insert(2, "text_key", batch["text_key"].to_numpy())
            yield frame

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.coalesce("text", F.lit("")).alias("text"),
        text_key().alias("text_key"),
    )
    return source.mapInPandas(rows, LINES)


def with_flag(docs: DataFrame, place: Column, of: DataFrame, of_place: Column) -> DataFrame:
    """``docs`` with ``flag``: true for every row whose place that of a row in ``of`` equals, and for a few others.

    The map of places has at most ``MAP_BITS`` bits, whatever the size of the tables, so every task can hold it.
    """
    bit, row = F.pmod(F.xxhash64(of_place), F.lit(MAP_BITS)), F.lit(MAP_ROW)
    bits = of.groupBy(F.floor(bit / row).alias("map_row")).agg(F.bitmap_construct_agg(bit % row).alias("map_bits"))
    bit = F.pmod(F.xxhash64(place), F.lit(MAP_BITS))
    byte = F.conv(F.hex(F.substring("map_bits", F.floor(bit % row / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1
    joined = docs.join(F.broadcast(bits), F.floor(bit / row) == F.col("map_row"), "left")
    return joined.withColumn("flag", F.coalesce(found, F.lit(False))).drop("map_row", "map_bits")


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose normalised form has its hash in ``gone``."""

    def stays(line: Column) -> Column:
        spaced = F.trim(F.regexp_replace(line, r"[\x20\t-\r]+", " "))
        return ~F.array_contains(gone, F.substring(F.md5(F.translate(spaced, ascii_uppercase, ascii_lowercase)), 1, 16))

    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def clean_documents(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT, depleted: int = DEPLETED) -> DataFrame:
    """The columns of each row, with the lines that go taken out of ``text``, and a struct ``quality`` of what was judged.

    ``n_chars`` follows a changed text. Whatever is judged depends on id, host and text alone, so equal rows share it.
    """
    judged = land(line_features(docs, host).withColumn("row", F.monotonically_increasing_id()), "lines")
    lines = judged.select("row", "host", "whole", F.explode("lines").alias("one")).select("row", "host", "whole", "one.*")
    frequent = (
        lines.select("host", "line", "whole")
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("documents"))
        .where(F.col("documents") > limit)
        .select(F.col("host").alias("of"), F.col("line").alias("found"))
    )
    lost = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("found")))
        .groupBy("row")
        .agg(F.sum("words").alias("lost"), F.collect_set("line").alias("gone"))
    )
    keys = ["doc_id", "host", "text_key"]
    changed = judged.select("row", *keys).join(lost, "row").dropDuplicates(keys)
    changed = changed.select(F.struct(*keys).alias("of"), F.col("lost").alias("n_removed_words"), "gone")
    number = judged.count()
    changed = land(few_files(changed, number, TEXT_ROWS), "changed")
    drop(judged)
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text_key().alias("text_key"))
    # Only texts that may lose lines travel.
    flagged = with_flag(docs, own, changed, F.col("of"))
    whole = flagged.where(~F.col("flag")).select(*docs.columns, F.lit(0).cast("long").alias("n_removed_words"), F.lit(None).cast("array<string>").alias("gone"))
    moved = flagged.where("flag").join(changed, F.col("of") == own, "left").select(*docs.columns, "n_removed_words", "gone")
    judged = whole.unionByName(few_files(moved, number, TEXT_ROWS)).withColumns(
        {"n_removed_words": F.coalesce("n_removed_words", F.lit(0).cast("long")), "counts": base_counts(F.coalesce("text", F.lit("")))}
    )
    count = {name: F.col(f"counts.{name}") for name in COUNTS}
    base_failed = (count["n_words"] < MIN_WORDS) | (100 * count["n_repeat_words"] > REPEATED * count["n_words"])
    kept = ~base_failed & (100 * F.col("n_removed_words") <= depleted * count["n_words"])
    verdict = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), *count.values(), "n_removed_words", base_failed.alias("base_failed"), kept.alias("kept")
    )
    changed = F.col("gone").isNotNull()
    joined = judged.withColumn("quality", verdict)
    joined = joined.withColumn("text", F.when(changed, without_lines(F.col("text"), F.col("gone"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns, "quality")


def judge_documents(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT, depleted: int = DEPLETED) -> DataFrame:
    """Per row: doc_id, the base counts, n_removed_words, base_failed, kept, the text without the lines that go."""
    return clean_documents(docs, host, limit, depleted).select("quality.*", "text")
