"""From raw documents to packed training sequences.

Each stage gets the documents its predecessor kept, decides on all of them, and its result is written
to the shared folder and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripflow.llm import decontamination, near_dup, packing, pii, quality
from tripflow.llm.common import TEXT_ROWS, few_files, land, read
from tripflow.llm.queries import tokenizer_file

#: Documents are copies from this similarity on, in per cent.
SIMILAR = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the quality rules reject; the others lose the lines frequent on their host."""
    return quality.clean_documents(docs).where("quality.kept").drop("quality")


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, that with the smallest id, of each near-duplicate group; null ids come last."""
    rows = land(docs.withColumn("near_dup_row", F.monotonically_increasing_id()), "rows")
    groups = near_dup.near_duplicates(rows.select(F.col("near_dup_row").alias("doc_id"), "text"), percent=SIMILAR)
    groups = groups.select(F.col("doc_id").alias("near_dup_row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "near_dup_row")
    first = rows.select("doc_id", "near_dup_row").join(groups, "near_dup_row").groupBy("component_id").agg(F.min(place).alias("first"))
    kept = first.select("first.near_dup_row")
    return few_files(rows.join(kept, "near_dup_row", "left_semi").select(docs.columns), rows.count(), TEXT_ROWS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    clean = decontamination.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))
    return few_files(clean, docs.count(), TEXT_ROWS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    return few_files(pii.redact(docs), docs.count(), TEXT_ROWS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the token pieces of all documents in sequences of 1024."""
    packed = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return few_files(packed, docs.count(), TEXT_ROWS)


STAGES = [
    ("quality", keep_good),
    ("near_dup", keep_first_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Token ids are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
