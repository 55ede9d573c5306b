"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

Defined results: rows are judged one by one, so repeated rows and ids that several texts share are fine;
null texts go in the first stage; a null doc_id is kept like any other until its group of near copies
has a row with an id; an empty table stays empty; extra columns, whatever their names, are carried
along up to packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, language_id, packing, secret_scan, simhash_dedup
from tidewright.llm.common import fold, table, written
from tidewright.llm.queries import vocabulary

#: No SQL: a trained model decides the first stage.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language (null text, no letter, or fewer known n-grams than the operator's bound asks for) go; a null ``lang`` gets the predicted one."""
    return language_id.with_language(docs, language_id.train(docs.where(fold(docs["doc_id"], 4) != 2)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id."""
    return simhash_dedup.without_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that passages of the benchmark cover to a twentieth or more go; the rest loses the passages."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked."""
    return secret_scan.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
