"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token ids.

Each stage reads what its predecessor wrote; all but the last return the columns
of ``documents``, and the last reports the id blocks that it wrote, as read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrasift.llm import _common as C
from terrasift.llm import curriculum, decontaminate, language_id, near_dedup, token_ids
from terrasift.llm.queries import held_out, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay."""
    return language_id.identified(docs, language_id.fit(docs, ~held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by training position."""
    return curriculum.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id blocks with Elias-Fano boundaries; doc_id, start, n_tokens, ids_crc32 as read back, and position.

    Files are in ascending doc_id; ``position`` ascends in the order in which the mixing stage wrote
    its rows, so a trainer takes the documents in that order by ``select``.
    """
    return token_ids.token_output(docs, tokenizer_path("byte_bpe_50k.json"), position=token_ids.row_order(docs))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]

#: SQL cannot express language ID or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = C.materialize(docs, f"stage{k}")
    return docs
