"""First rows, seeded samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.catalog import bindings as b
from rolltally.catalog.registry import query
from rolltally.functions.fixed_values import LOGGED_PROMPTS, RL_TEST_FRACTION, SFT_TEST_FRACTION
from rolltally.operators import sampling


@query("first_rows", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_rows(b.table(spark, sf_dir, "documents").select("doc_id", "text"), 50, "doc_id")


@query("all_rows_when_few", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 1000")
def all_rows_when_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = b.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return sampling.first_rows(nations, 1000, "n_nationkey")


def _split_sql(table: str, key: str, fraction: float) -> str:
    return f"""SELECT {key}, CASE WHEN row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR) || ':42'))
                                  <= ceil(count(*) OVER () * {fraction}::DOUBLE) THEN 'test' ELSE 'train' END AS split
               FROM {table}"""


@query("sft_split", _split_sql("documents", "doc_id", SFT_TEST_FRACTION))
def sft_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.seeded_split(documents, SFT_TEST_FRACTION, "doc_id")


@query("rl_split", _split_sql("orders", "o_orderkey", RL_TEST_FRACTION))
def rl_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey")
    # Two digits make buckets of several rows each, so that one of them is divided.
    return sampling.seeded_split(orders, RL_TEST_FRACTION, "o_orderkey", digits=2)


@query(
    "unique_prompt_sample",
    f"""SELECT doc_id, text AS prompt, source FROM (
          SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS seen FROM documents)
        WHERE seen = 1 ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42') LIMIT {LOGGED_PROMPTS}""",
)
def unique_prompt_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), "source")
    return sampling.sample_unique_prompts(documents, LOGGED_PROMPTS, "doc_id")


@query(
    "seeded_prompt_sample",
    f"""SELECT item_id, text FROM benchmark ORDER BY md5(CAST(item_id AS VARCHAR) || ':42') LIMIT {LOGGED_PROMPTS}""",
)
def seeded_prompt_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_sample(b.table(spark, sf_dir, "benchmark"), LOGGED_PROMPTS, "item_id")
