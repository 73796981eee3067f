"""Corpus pipeline: five stages over ``documents``, each written and read again.

Toxic documents go; of equal texts one stays; of each near-duplicate group one
stays; secrets are masked; what is left is packed into windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import lsm_dedup, neardup, packing, secrets_scan, toxicity
from tidegauge.llm._shared import settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, of any length; those without text
    stay. Repeated rows are judged alike.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space the longest, then first, stays.

    Rows are told apart by id and text: ids that repeat, clash or are missing do no
    harm, and of rows that repeat one stays. A null text is empty.
    """
    return lsm_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id stays, of a
    group without ids the longest. Documents without words all stay.
    """
    return neardup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced by a mark; every row stays, repeated ones too,
    and null texts stay null.
    """
    return secrets_scan.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and the windows that hold them; rows that repeat are
    packed each, and a null text has its end mark alone.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_windows),
]

# SQL can't express the classifier, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # what a stage stored on its way goes when its rows are written
        docs = settled(lambda: stage(spark, docs, sf_dir), f"stage-{name}")  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)
