"""Shapes of post-training data made from the test tables, in Spark and in SQL.

Each function has a SQL twin of the same meaning, used as a common table expression by
the checks. ``div`` is written out because operands are never negative here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(column: str | Column, by: int) -> Column:
    """Integer quotient of a non-negative integer column."""
    value = F.col(column) if isinstance(column, str) else column
    return ((value - F.pmod(value, F.lit(by))) / by).cast("long")


# --- Generated samples --------------------------------------------------------------
# Five runs of each problem with eight samples each. The last box holds the answer in
# one of three spellings of equal value, or nothing; errors have no box at all.

VAL_N = 8


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    answer = F.pmod("user_id", F.lit(3))
    spelling = F.pmod("event_id", F.lit(3))
    written = (
        F.when((F.col("event_type") == "signup") & (F.pmod("user_id", F.lit(4)) == 0), F.lit(""))
        .when(spelling == 0, answer.cast("string"))
        .when(spelling == 1, F.concat(answer.cast("string"), F.lit(".0")))
        .otherwise(F.concat(F.lit("\\frac{"), (answer * 2).cast("string"), F.lit("}{2}")))
    )
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("No result: "), "props")).otherwise(
        F.concat(F.lit("First \\boxed{9}, then "), "props", F.lit(" so \\boxed{"), written, F.lit("}."))
    )
    problem = div("event_id", 40)
    return events.select(
        F.concat(
            F.lit("checkpoint-"), (F.pmod(div("event_id", 8), F.lit(5)) * 25).cast("string")
        ).alias("run"),
        problem.alias("problem_id"),
        F.pmod("event_id", F.lit(8)).cast("int").alias("sample_idx"),
        text.alias("text"),
        F.pmod(problem, F.lit(3)).cast("string").alias("gold"),
    )


SAMPLES = r"""
samples AS (
  SELECT 'checkpoint-' || CAST(((event_id // 8) % 5) * 25 AS VARCHAR) AS run,
         event_id // 40 AS problem_id,
         CAST(event_id % 8 AS INTEGER) AS sample_idx,
         CASE WHEN event_type = 'error' THEN 'No result: ' || props
              ELSE 'First \boxed{9}, then ' || props || ' so \boxed{' || written || '}.' END AS text,
         CAST((event_id // 40) % 3 AS VARCHAR) AS gold,
         event_type <> 'error' AS is_formatted,
         event_type <> 'error' AND written <> '' AND user_id % 3 = (event_id // 40) % 3 AS is_correct,
         CASE WHEN event_type = 'error' OR written = '' THEN '[No boxed answer found]'
              ELSE written END AS shown
  FROM (SELECT *, CASE WHEN event_type = 'signup' AND user_id % 4 = 0 THEN ''
                       WHEN event_id % 3 = 0 THEN CAST(user_id % 3 AS VARCHAR)
                       WHEN event_id % 3 = 1 THEN CAST(user_id % 3 AS VARCHAR) || '.0'
                       ELSE '\frac{' || CAST((user_id % 3) * 2 AS VARCHAR) || '}{2}' END AS written
        FROM events)
)"""

# One row per problem. The vote: most frequent shown answer among formatted samples, the
# first seen of equally frequent ones.
PROBLEMS = (
    SAMPLES
    + """,
votes AS (
  SELECT run, problem_id, shown, count(*) AS n, min(sample_idx) AS first, bool_or(is_correct) AS right_answer
  FROM samples WHERE is_formatted GROUP BY run, problem_id, shown
),
winners AS (
  SELECT run, problem_id, shown, right_answer FROM votes
  QUALIFY row_number() OVER (PARTITION BY run, problem_id ORDER BY n DESC, first) = 1
),
problems AS (
  SELECT s.run, s.problem_id, s.num_samples, s.num_correct, s.num_formatted, s.num_correct > 0 AS has_correct,
         w.shown AS majority_answer, coalesce(w.right_answer, false) AS majority_correct
  FROM (SELECT run, problem_id, count(*) AS num_samples,
               CAST(count(*) FILTER (is_correct) AS BIGINT) AS num_correct,
               CAST(count(*) FILTER (is_formatted) AS BIGINT) AS num_formatted
        FROM samples GROUP BY run, problem_id) s
  LEFT JOIN winners w ON w.run = s.run AND w.problem_id = s.problem_id
)"""
)


# --- Documents with composed answers ------------------------------------------------


def boxed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with boxes in different places, by ``doc_id`` modulo 6."""
    n = F.pmod("doc_id", F.lit(97)).cast("string")
    body, lit = F.col("text"), F.lit
    kind = F.pmod("doc_id", F.lit(6))
    text = (
        F.when(
            kind == 0,
            F.concat(body, lit("</think> So \\boxed{"), n, lit("} or \\boxed{\\frac{"), n, lit("}{2}}.")),
        )
        .when(
            kind == 1,
            F.concat(lit("\\boxed{7} "), body, lit("</think>It is \\boxed{ x_{"), n, lit("} }\n")),
        )
        .when(kind == 2, F.concat(body, lit(" \\boxed{"), n, lit("} and \\boxed")))
        .when(kind == 3, F.concat(body, lit(" \\boxed{"), n, lit("} and \\boxed{ open {"), n, lit("}")))
        .when(kind == 4, F.concat(body, lit(" \\boxed{}")))
        .otherwise(body)
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def cued_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents ending in different answer phrases, by ``doc_id`` modulo 7."""
    n = F.pmod("doc_id", F.lit(89)).cast("string")
    body, lit = F.col("text"), F.lit
    kind = F.pmod("doc_id", F.lit(7))
    text = (
        F.when(kind == 0, F.concat(body, lit("\n**Answer:** "), n, lit(".")))
        .when(kind == 1, F.concat(body, lit("\nanswer:  - "), n, lit(" .. ")))
        .when(kind == 2, F.concat(body, lit(" Thus, the CORRECT answer is: "), n, lit(". \n")))
        .when(kind == 3, F.concat(body, lit("\nAnswer: ...")))
        .when(kind == 4, F.concat(body, lit("\r\n  last line "), n, lit("  \n\n")))
        .when(kind == 5, F.concat(lit("<think>"), body, lit(" Answer: 5</think>\n \t\n")))
        .otherwise(body)
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


# --- Question and answer turns ------------------------------------------------------


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one that follows it in its conversation."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", "turn", F.col("role").alias("ask_role"), F.col("text").alias("problem"))
    told = turns.select(
        "conv_id",
        (F.col("turn") - 1).alias("turn"),
        F.col("role").alias("tell_role"),
        F.col("text").alias("solution"),
    )
    return asked.join(told, ["conv_id", "turn"])


TURN_PAIRS = """
pairs AS (
  SELECT a.conv_id, a.turn, a.role AS ask_role, a.text AS problem, b.role AS tell_role, b.text AS solution
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
)"""


# --- Multiple choice ----------------------------------------------------------------


def choice_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions: four options, or none given for urgent ones."""
    letter = F.substring(F.lit("ABCD"), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"), F.lit(1))
    form = F.pmod("o_custkey", F.lit(3))
    answer = (
        F.when(form == 0, letter).when(form == 1, F.lower(letter)).otherwise(F.concat(F.lit(" ("), letter, F.lit(")")))
    )
    options = F.when(
        F.col("o_orderpriority") != "1-URGENT", F.array(*[F.lit(x) for x in ("w", "x", "y", "z")])
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_index"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("prompt"),
        answer.alias("answer"),
        options.alias("options"),
        F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("question_id"),
        F.col("o_orderstatus").alias("category"),
        F.col("o_orderpriority").alias("source"),
    )


def choice_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses, two per index; later ones replace earlier ones."""
    letter = F.substring(F.lit("ABCDZ"), (F.pmod("user_id", F.lit(5)) + 1).cast("int"), F.lit(1))
    lit = F.lit
    text = (
        F.when(F.col("event_type") == "click", F.concat(lit("I pick \\boxed{ "), letter, lit(" }. Not (B)")))
        .when(F.col("event_type") == "view", F.concat(lit("Answer: A? no. Final answer: ("), letter, lit(").")))
        .when(F.col("event_type") == "purchase", F.concat(lit("<answer>"), F.lower(letter), lit("</answer>")))
        .when(F.col("event_type") == "signup", F.concat(lit("perhaps "), letter, lit(" it is")))
        .otherwise(lit("no idea"))
    )
    return table(spark, sf_dir, "events").select(
        div("event_id", 2).alias("row_index"),
        text.alias("response"),
        F.col("event_id").alias("arrival"),
    )


# Valid letters: ABCD with options, the whole alphabet without. "I" in "I pick" and the
# "A" in "Answer: A?" make fallbacks matter when the named letter (Z) is not valid.
CHOICES = r"""
examples AS (
  SELECT o_orderkey AS row_index, 'Order ' || CAST(o_orderkey AS VARCHAR) || '?' AS prompt,
         substr('ABCD', CAST(o_orderkey % 4 AS INTEGER) + 1, 1) AS gold_answer,
         o_orderpriority <> '1-URGENT' AS four,
         'q' || CAST(o_orderkey AS VARCHAR) AS question_id, o_orderstatus AS category, o_orderpriority AS source
  FROM orders
),
responses AS (
  SELECT row_index, event_type, letter,
         CASE event_type
           WHEN 'click' THEN 'I pick \boxed{ ' || letter || ' }. Not (B)'
           WHEN 'view' THEN 'Answer: A? no. Final answer: (' || letter || ').'
           WHEN 'purchase' THEN '<answer>' || lower(letter) || '</answer>'
           WHEN 'signup' THEN 'perhaps ' || letter || ' it is'
           ELSE 'no idea' END AS response
  FROM (SELECT event_id // 2 AS row_index, event_type, event_id,
               substr('ABCDZ', CAST(user_id % 5 AS INTEGER) + 1, 1) AS letter FROM events)
  QUALIFY row_number() OVER (PARTITION BY row_index ORDER BY event_id DESC) = 1
),
scored AS (
  SELECT e.row_index, e.question_id, e.category, e.source, e.gold_answer,
         CASE WHEN r.letter IS NULL OR r.event_type = 'error' THEN NULL
              WHEN r.letter <> 'Z' OR NOT e.four THEN r.letter
              WHEN r.event_type = 'click' THEN 'B'
              WHEN r.event_type = 'view' THEN 'A' END AS predicted_answer,
         coalesce(r.response, '') AS response, e.prompt, r.row_index IS NULL AS missing
  FROM examples e LEFT JOIN responses r ON r.row_index = e.row_index
)"""


# --- Logits -------------------------------------------------------------------------


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as logits of a 64-token vocabulary; the teacher is the next vector.

    Eight positions make an example. Every seventh position is ignored.
    """
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits")
    )
    teachers = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("logits").alias("teacher"))
    return vectors.join(teachers, "vec_id").select(
        div("vec_id", 8).alias("ex_id"),
        F.pmod("vec_id", F.lit(8)).cast("int").alias("pos"),
        F.pmod("vec_id", F.lit(64)).cast("int").alias("sampled_id"),
        F.when(F.pmod("vec_id", F.lit(7)) == 0, F.lit(-100))
        .otherwise(F.pmod("vec_id", F.lit(64)))
        .cast("int")
        .alias("label"),
        F.col("logits").alias("student"),
        "teacher",
    )


# ``cells`` has one row per vocabulary cell.
LOGITS = """
vectors AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 10) AS logits FROM embeddings
),
positions AS (
  SELECT a.vec_id // 8 AS ex_id, CAST(a.vec_id % 8 AS INTEGER) AS pos, CAST(a.vec_id % 64 AS INTEGER) AS sampled_id,
         CAST(CASE WHEN a.vec_id % 7 = 0 THEN -100 ELSE a.vec_id % 64 END AS INTEGER) AS label,
         a.logits AS student, b.logits AS teacher
  FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1
),
cells AS (
  SELECT ex_id, pos, sampled_id, label, token_id, student[token_id + 1] AS s, teacher[token_id + 1] AS t
  FROM (SELECT *, unnest(generate_series(0, len(student) - 1)) AS token_id FROM positions)
)"""


# --- Rollouts and metric logs -------------------------------------------------------


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rollout records: twenty per step, five steps in a hundred events."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.pmod(div("event_id", 20), F.lit(3)).cast("string")).alias("run"),
        div("event_id", 60).alias("step"),
        F.pmod("event_id", F.lit(20)).cast("int").alias("idx"),
        F.concat(F.lit("prompt of "), F.col("user_id").cast("string")).alias("prompt"),
        F.col("props").alias("completion"),
        F.col("event_id"),
    )


ROLLOUTS = """
rollouts AS (
  SELECT 'run' || CAST((event_id // 20) % 3 AS VARCHAR) AS run, event_id // 60 AS step,
         CAST(event_id % 20 AS INTEGER) AS idx, 'prompt of ' || CAST(user_id AS VARCHAR) AS prompt,
         props AS completion, event_id
  FROM events
)"""


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged metric values, three runs, steps from 1."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.pmod("user_id", F.lit(3)).cast("string")).alias("run"),
        F.when(F.col("event_type") == "error", F.lit("eval")).otherwise(F.lit("train")).alias("mode"),
        F.col("event_type").alias("key"),
        (div("event_id", 25) + 1).alias("step"),
        "value",
        (F.pmod("user_id", F.lit(2)) == 0).alias("on_policy"),
        "event_id",
        "user_id",
        "ts",
    )


METRIC_LOG = """
log AS (
  SELECT 'run' || CAST(user_id % 3 AS VARCHAR) AS run,
         CASE WHEN event_type = 'error' THEN 'eval' ELSE 'train' END AS mode, event_type AS key,
         event_id // 25 + 1 AS step, value, user_id % 2 = 0 AS on_policy, event_id, user_id, ts
  FROM events
)"""


def ids(text: str | Column) -> Column:
    """Token ids of a text: the lengths of its words between single blanks."""
    return F.transform(F.split(text, " "), lambda word: F.length(word))


def listed(values: Column) -> Column:
    """Array as text, for comparison across engines."""
    return F.array_join(values.cast("array<string>"), ",")
