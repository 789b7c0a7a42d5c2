"""Joins of examples, responses, scores and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.catalog import bindings as b
from rolltally.catalog.registry import query
from rolltally.operators import joins
from rolltally.operators.rollouts import attach_scores, flatten_gathered


@query(
    "responses_by_index",
    f"WITH {b.CHOICES} SELECT row_index, prompt, response, missing FROM scored",
)
def responses_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = b.choice_examples(spark, sf_dir).select("row_index", "prompt")
    last = joins.last_per_key(b.choice_responses(spark, sf_dir), ["row_index"], "arrival")
    return joins.attach_responses_by_index(examples, last)


_LAST_ANSWER = """SELECT d.doc_id, {response} AS response{missing}
FROM documents d {how} JOIN (
  SELECT text, source || '/' || CAST(quality AS VARCHAR) AS response
  FROM documents JOIN labels USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1) a ON a.text = d.text"""


def _by_prompt(spark: SparkSession, sf_dir: str, keep_missing: bool) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), "source")
    labels = b.table(spark, sf_dir, "labels")
    responses = documents.join(labels, "doc_id").select(
        "prompt",
        F.concat("source", F.lit("/"), F.col("quality").cast("string")).alias("response"),
        F.col("doc_id").alias("key"),
    )
    return joins.attach_responses_by_prompt(
        documents.select("doc_id", "prompt"), responses, "key", ["doc_id"], keep_missing
    )


@query(
    "responses_by_prompt",
    _LAST_ANSWER.format(
        response="coalesce(a.response, '')", missing=", a.response IS NULL AS missing", how="LEFT"
    ),
)
def responses_by_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_prompt(spark, sf_dir, keep_missing=True).select("doc_id", "response", "missing")


@query(
    "answered_prompts_only",
    _LAST_ANSWER.format(response="a.response", missing="", how="INNER"),
)
def answered_prompts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_prompt(spark, sf_dir, keep_missing=False).select("doc_id", "response")


@query(
    "zipped_by_index",
    """SELECT doc_id AS idx, length(text) AS prompt_length, lang FROM documents""",
)
def zipped_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), F.length("text").cast("long").alias("prompt_length")
    )
    right = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang")
    return joins.zip_by_index(left, right, ["idx"])


@query(
    "zipped_within_row",
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS value,
              CAST(i % 3 AS INTEGER) AS flag
       FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""",
)
def zipped_within_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel lists of a row, flattened to one row per position."""
    vectors = b.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.arrays_zip(
            F.transform("embedding", lambda x, i: i).alias("pos"),
            F.col("embedding").cast("array<double>").alias("value"),
            F.transform("embedding", lambda x, i: F.pmod(i + 1, F.lit(3))).alias("flag"),
        ).alias("gathered"),
    )
    return flatten_gathered(vectors, "gathered", ["vec_id"]).withColumn("value", F.round("value", 6))


@query(
    "rollouts_with_scores",
    f"""WITH {b.ROLLOUTS},
        scores AS (SELECT run, step, idx, CAST(event_id AS DOUBLE) / 4 AS score FROM rollouts WHERE idx < 15)
        SELECT r.run, r.step, r.idx, r.prompt, r.completion, s.score
        FROM rollouts r LEFT JOIN scores s ON s.run = r.run AND s.step = r.step AND s.idx = r.idx""",
)
def rollouts_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer scores than rollouts: the rest stays without."""
    rollouts = b.rollouts(spark, sf_dir)
    scores = rollouts.where(F.col("idx") < 15).select("run", "step", "idx", (F.col("event_id") / 4).alias("score"))
    return attach_scores(rollouts.drop("event_id"), scores, ["run", "step", "idx"])
