"""A training corpus from `documents`: good documents, one of each near-duplicate group, without repeated passages and
without benchmark passages, packed. Each stage reads what the one before wrote.

All stages take any table with doc_id and text, whatever other columns it has, and an empty one (no rows). A null text is a
text without words: the classifier scores it like any other, null and empty texts are one near-duplicate group, the other
stages leave it as it is, and it is packed as the end id alone. Rows without a doc_id are never near-duplicates or
repeats and stay. Repeated rows of a doc_id: one of each group stays. Texts of any length are taken whole."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import decontam, packing, pu, simhash, substring
from tallymark.llm.common import cut, remove, scratch, table, tidy

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the positive-unlabelled classifier accepts."""
    return pu.keep_good(docs, pu.fit(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words out that a 13-word window shares with a document of smaller id; documents left without words go."""
    return substring.strip(docs, batches=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a window with a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: a row for each piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, most=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing_stage),
]

#: A model trained on a sample, XXH64 and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table `documents`. Stages hand on Parquet in the session's shared folder."""
    return chained(spark, table(spark, sf_dir, "documents"), sf_dir)


def chained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stages applied to any documents. What a stage wrote is deleted when the next one has written its own; the last
    stage's rows are a checkpoint."""
    folder = scratch(spark, "pipeline")
    try:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i + 1 == len(STAGES):
                return cut(docs)
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
            tidy(spark)
        return docs
    finally:
        remove(spark, folder)
