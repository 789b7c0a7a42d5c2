"""Conversion of conversation shards to JSON lines with an extracted answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.functions.answers import answer_of_messages
from rolltally.sources.datasets import read_shards
from rolltally.sources.sinks import write_jsonl_counted


def with_answer(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Add ``answer``: boxed, else after a cue phrase, else the last line of the last
    assistant message. All other columns stay."""
    return df.withColumn("answer", answer_of_messages(F.col(messages)))


def extraction_counts() -> dict:
    """Aggregates that tell how many rows got an answer."""
    total, extracted = F.count(F.lit(1)), F.count("answer")
    return {
        "total_rows": total,
        "extracted_rows": extracted,
        "missing_rows": total - extracted,
    }


def extraction_coverage(df: DataFrame) -> DataFrame:
    """The counts as one row."""
    return df.agg(*[value.alias(name) for name, value in extraction_counts().items()])


def convert_shards(spark: SparkSession, folder: str, output: str) -> dict:
    """Convert all shards of a folder in one narrow pass; returns the counts."""
    shards = read_shards(spark, folder).drop("shard", "row_in_shard")
    return write_jsonl_counted(with_answer(shards), output, extraction_counts())
