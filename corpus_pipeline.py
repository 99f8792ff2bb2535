"""The corpus pipeline: language identification, SimHash near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns of ``documents``. ``run`` writes
each stage's result to the shared scratch folder, reads it back for the next and then drops the one before, so a lost executor never
costs an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, packing, simhash, suffix_dedup
from ledgerloom.session import Scratch

#: The membership values of a text sum to about 1. A document goes when no language gets this part of an equal share.
MIN_SHARE = 0.8

#: SQL cannot express string-kernel regression or best-fit packing; tests/llm holds brute-force versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those that are in no learned language, go. Where nothing can be learned all with a letter stay."""
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    longest = 1 + max(map(len, docs.columns))
    label, score = "_" * longest, "_" * (longest + 1)  # names that no column has
    found = langid.identify(docs, model, label, score)
    return found.where((F.col(label) != "und") & (F.col(score) >= MIN_SHARE / len(model.languages))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the smallest doc_id; rows are told apart, so one doc_id may have several texts."""
    return simhash.first_of_groups(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occur earlier are cut out of the text."""
    return suffix_dedup.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its sequence and offset."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("best_fit_packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        own = Scratch(spark)
        docs = own.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        before.clear()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
