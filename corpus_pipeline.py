"""The corpus pipeline: documents without toxic ones and near copies, free of personal data, mixed and packed.

Each stage is one of the operators in ``fareflow.llm`` and works on everything that its predecessor kept. Its result is
written as Parquet in the shared folder and read again, so a lost executor never costs more than the stage at hand; once the
next stage is written, it is removed.

Null texts count as empty throughout: they aren't toxic, are copies of each other, and are never mixed in. Rows without doc_id
pass the near-copy stage, having no identity to go by. Repeated rows are copies of each other. A null source is a source of its
own. Extra columns pass all stages but the last, whatever their names. Empty tables give an empty result; without labels nothing
is toxic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fareflow.llm import mixing, packing, pii, simhash, toxicity
from fareflow.llm.common import crc32_mod, removed, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring 0.7 or more go. The model learns from two thirds of the labels, so the rest can measure it."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), crc32_mod("doc_id", 3) != 1)
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id."""
    return simhash.without_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become marks such as ``<EMAIL>``; n_chars follows."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but the mixing's sizes can be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            removed(spark, f"{folder}/{i - 1}")
    return docs
