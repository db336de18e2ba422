"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import line_dedup, packing, quality, simhash, substring_dedup
from basketry.llm.common import table
from basketry.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"


def with_text(docs: DataFrame, kept: str, changed: str) -> DataFrame:
    """The columns of documents, with the text that a stage kept where it changed something."""
    text = F.when(F.col(changed) > 0, F.col(kept)).otherwise(F.coalesce("text", F.lit("")))
    renewed = docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint"))
    return renewed.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the rules or come from a rejected host."""
    return quality.judge(docs).filter("kept").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that many documents share."""
    return with_text(line_dedup.drop_common_lines(docs), "kept_text", "n_dropped")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the passages that occur more than once."""
    return with_text(substring_dedup.drop_repeated(docs), "kept_text", "n_removed")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences; one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), carry=["doc_id"])


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", lines_stage),
    ("simhash near-dedup", near_duplicates_stage),
    ("substring dedup", passages_stage),
    ("packing", packing_stage),
]

# Fingerprints and tokens are beyond SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each one's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
