"""Token-id sequences, made of the word lengths of conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.catalog import bindings as b
from rolltally.catalog.registry import query
from rolltally.functions import arrays
from rolltally.operators import sequences
from rolltally.operators.ordering import row_index

MAX_LENGTH = 48
MAX_COMPLETION = 32
PAD = 0


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completion ids of each turn and its successor, four conversations a batch."""
    return b.turn_pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        b.div("conv_id", 4).alias("batch"),
        b.ids("problem").alias("ids"),
        b.ids("solution").alias("reply_ids"),
    )


EXAMPLES = f"""WITH {b.TURN_PAIRS},
examples AS (
  SELECT conv_id, turn, conv_id // 4 AS batch,
         list_transform(string_split(problem, ' '), lambda w: length(w)) AS ids,
         list_transform(string_split(solution, ' '), lambda w: length(w)) AS reply_ids
  FROM pairs
),
sized AS (
  SELECT *, least(len(ids), {MAX_LENGTH}) AS prompt_length,
         max(least(len(ids), {MAX_LENGTH})) OVER (PARTITION BY batch) AS prompt_batch_length
  FROM examples
),
shaped AS (
  SELECT *, list_concat(ids[1:{MAX_LENGTH}], list_resize([]::BIGINT[], prompt_batch_length - prompt_length, {PAD}))
            AS prompt_ids,
         list_concat(list_resize([]::BIGINT[], prompt_length, 1),
                     list_resize([]::BIGINT[], prompt_batch_length - prompt_length, 0)) AS prompt_mask
  FROM sized
),
joined AS (
  SELECT *, list_concat(prompt_ids, list_resize(reply_ids[1:{MAX_COMPLETION}], {MAX_COMPLETION}, {PAD})) AS student_ids
  FROM shaped
),
trained AS (
  SELECT *, student_ids[prompt_batch_length + 1:] AS completion_ids,
         list_concat([7, 7], prompt_ids, student_ids[prompt_batch_length + 1:]) AS teacher_ids,
         list_transform(student_ids, lambda x, i: CASE WHEN i <= prompt_length OR x = {PAD} THEN -100 ELSE x END)
           AS labels
  FROM joined
)"""


def listed(name: str) -> str:
    return f"array_to_string({name}, ',') AS {name}"


def mask(name: str) -> str:
    return f"array_to_string(list_transform({name}, lambda x: CASE WHEN x = {PAD} THEN 0 ELSE 1 END), ',')"


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.shape_prompts(
        examples(spark, sf_dir), "ids", ["batch"], ["conv_id", "turn"], MAX_LENGTH, PAD
    )


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.join_completion(shaped(spark, sf_dir), "prompt_ids", "reply_ids", MAX_COMPLETION, PAD)


def as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: b.listed(F.col(name)) for name in names})


@query(
    "padded_prompts",
    EXAMPLES
    + f""" SELECT conv_id, turn, CAST(prompt_length AS INTEGER) AS prompt_length,
                  CAST(prompt_batch_length AS INTEGER) AS prompt_batch_length,
                  {listed("prompt_ids")}, {listed("prompt_mask")} FROM shaped""",
)
def padded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "prompt_length", "prompt_batch_length", "prompt_ids", "prompt_mask"]
    return as_text(shaped(spark, sf_dir).select(*columns), "prompt_ids", "prompt_mask")


@query(
    "joined_sequences",
    EXAMPLES
    + f""" SELECT conv_id, turn, {listed("student_ids")}, {mask("student_ids")} AS student_mask,
                  array_to_string(list_transform(student_ids, lambda x: CASE WHEN x = {PAD} THEN -100 ELSE x END), ',')
                    AS student_pad_labels
           FROM joined""",
)
def joined_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "student_ids", "student_mask", "student_pad_labels"]
    return as_text(joined(spark, sf_dir).select(*columns), *columns[2:])


@query(
    "teacher_sequences",
    EXAMPLES
    + f""" SELECT conv_id, turn, {listed("completion_ids")}, {listed("teacher_ids")},
                  {mask("teacher_ids")} AS teacher_mask, {listed("labels")} FROM trained""",
)
def teacher_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teacher's prompt is the student's with two ids in front."""
    privileged = joined(spark, sf_dir).withColumn(
        "teacher_prompt_ids", F.concat(F.array(F.lit(7), F.lit(7)), "prompt_ids")
    )
    trained = sequences.add_teacher_and_labels(
        privileged,
        "student_ids",
        "teacher_prompt_ids",
        F.col("prompt_batch_length"),
        F.col("prompt_length"),
        PAD,
    )
    columns = ["conv_id", "turn", "completion_ids", "teacher_ids", "teacher_mask", "labels"]
    return as_text(trained.select(*columns), *columns[2:])


@query(
    "reasoned_teacher_context",
    EXAMPLES
    + f""", contexts AS (
             SELECT conv_id, turn, list_concat(ids, reply_ids, [5, 0, 5]) AS teacher_prompt_ids FROM examples)
           SELECT conv_id, turn, {listed("teacher_prompt_ids")}, {mask("teacher_prompt_ids")} AS teacher_prompt_mask,
                  CAST(len(teacher_prompt_ids) AS INTEGER) AS teacher_prompt_length FROM contexts""",
)
def reasoned_teacher_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    transition = F.array(F.lit(5), F.lit(0), F.lit(5))
    context = sequences.reasoned_teacher_context(examples(spark, sf_dir), "ids", "reply_ids", transition, PAD)
    columns = ["conv_id", "turn", "teacher_prompt_ids", "teacher_prompt_mask", "teacher_prompt_length"]
    return as_text(context.select(*columns), *columns[2:4])


@query(
    "fitted_completions",
    f"""SELECT conv_id, turn,
               array_to_string(list_resize(list_transform(string_split(text, ' '), lambda w: length(w))[1:{MAX_COMPLETION}],
                                           {MAX_COMPLETION}, {PAD}), ',') AS completion
        FROM conversations""",
)
def fitted_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = arrays.fit(b.ids("text"), MAX_COMPLETION, PAD)
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", b.listed(fitted).alias("completion"))


@query(
    "budgeted_prompts",
    """SELECT conv_id, turn,
              array_to_string(list_transform(string_split(text, ' '), lambda w: length(w))[1:16], ',') AS prompt
       FROM conversations""",
)
def budgeted_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts cut to what a maximum of 48 leaves beside 32 completion tokens."""
    budget = arrays.prompt_budget(MAX_LENGTH, MAX_COMPLETION)
    cut = arrays.truncate(b.ids("text"), budget)
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", b.listed(cut).alias("prompt"))


@query(
    "next_token_alignment",
    EXAMPLES
    + """ SELECT conv_id, turn, CAST(p - 3 AS INTEGER) AS pos, CAST(ids[p] AS INTEGER) AS token_id,
                 CAST(ids[p - 1] * 10 AS INTEGER) AS logits_at
          FROM (SELECT *, unnest(generate_series(3, len(ids))) AS p FROM examples)""",
)
def next_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a prompt of two ids, each output meets the token that follows it."""
    table = examples(spark, sf_dir).select(
        "conv_id", "turn", "ids", F.transform("ids", lambda x: x * 10).alias("outputs")
    )
    return sequences.align_next_token(table, "outputs", "ids", F.lit(2))


@query(
    "workers_and_batches",
    """SELECT conv_id, turn, row_index, CAST(row_index % 3 AS INTEGER) AS worker, row_index // 3 // 16 AS batch
       FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id * 100 + turn) - 1 AS row_index
             FROM conversations)""",
)
def workers_and_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = b.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("at")
    )
    indexed = row_index(turns, "at").drop("at")
    return sequences.assign_batches(indexed, batch_size=16, workers=3)


@query(
    "row_index",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_index FROM orders",
)
def row_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return row_index(orders, "o_orderkey", ["o_custkey"])
