"""Evaluation: maths results, multiple choice, instruction following."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.catalog import bindings as b
from rolltally.catalog.registry import query
from rolltally.operators import benchmarks, grading
from rolltally.operators.joins import last_per_key
from rolltally.operators.sampling import checkpoint_sweep, prefixed_metrics, union_named
from rolltally.plans.benchmark_eval import choice_benchmark, evaluate
from rolltally.plans.math_eval import evaluate_benchmark, evaluate_math


@query(
    "graded_samples",
    f"""WITH {b.SAMPLES}
        SELECT run, problem_id, sample_idx, shown, is_formatted, is_correct FROM samples""",
)
def graded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = grading.grade_samples(b.samples(spark, sf_dir), expressions=False)
    return graded.select("run", "problem_id", "sample_idx", "shown", "is_formatted", "is_correct")


@query(
    "formatted_samples",
    f"""WITH {b.SAMPLES}
        SELECT run, shown, count(*) AS n FROM samples WHERE is_formatted GROUP BY run, shown""",
)
def formatted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = grading.grade_samples(b.samples(spark, sf_dir), expressions=False)
    return graded.where("is_formatted").groupBy("run", "shown").agg(F.count(F.lit(1)).alias("n"))


@query(
    "problem_results",
    f"""WITH {b.PROBLEMS}
        SELECT run, problem_id, CAST(num_samples AS BIGINT) AS num_samples, num_correct, num_formatted,
               has_correct FROM problems""",
)
def problem_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = grading.problem_results(b.samples(spark, sf_dir), expressions=False)
    return results.drop("majority_answer", "majority_correct")


@query(
    "majority_vote",
    f"WITH {b.PROBLEMS} SELECT run, problem_id, majority_answer, majority_correct FROM problems",
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = grading.problem_results(b.samples(spark, sf_dir), expressions=False)
    return results.select("run", "problem_id", "majority_answer", "majority_correct")


_METRICS = f"""WITH {b.PROBLEMS},
metrics AS (
  SELECT run, count(*) AS num_problems,
         count(*) FILTER (has_correct) AS pass_at_n,
         CAST(sum(num_correct) AS BIGINT) AS average_at_n,
         count(*) FILTER (majority_correct) AS majority_vote_at_n,
         CAST(sum(num_formatted) AS BIGINT) AS formatted_count,
         count(*) * {b.VAL_N} AS total_solutions,
         round(count(*) FILTER (has_correct) / count(*) * 100, 6) AS pass_at_n_pct,
         round(sum(num_correct) / (count(*) * {b.VAL_N}) * 100, 6) AS average_at_n_pct,
         round(count(*) FILTER (majority_correct) / count(*) * 100, 6) AS majority_vote_at_n_pct,
         round(sum(num_formatted) / (count(*) * {b.VAL_N}) * 100, 6) AS format_rate
  FROM problems GROUP BY run
)"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


_RATES = ("pass_at_n_pct", "average_at_n_pct", "majority_vote_at_n_pct", "format_rate")


@query("math_run_metrics", _METRICS + " SELECT * FROM metrics")
def math_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate_math(b.samples(spark, sf_dir), b.VAL_N, expressions=False).metrics, *_RATES)


_STEPS = (0, 25, 50, 75, 100)


@query(
    "benchmark_run_metrics",
    f"""WITH {b.PROBLEMS},
bench AS (SELECT c_custkey - 1 AS problem_id FROM customer WHERE c_custkey % 10 <> 0),
runs AS (SELECT 'checkpoint-' || CAST(unnest([0, 25, 50, 75, 100]) AS VARCHAR) AS run),
complete AS (
  SELECT r.run, coalesce(num_correct, 0) AS num_correct, coalesce(num_formatted, 0) AS num_formatted,
         coalesce(has_correct, false) AS has_correct, coalesce(majority_correct, false) AS majority_correct
  FROM runs r CROSS JOIN bench LEFT JOIN problems p ON p.run = r.run AND p.problem_id = bench.problem_id
),
strays AS (
  SELECT run, count(*) AS num_without_gold FROM samples
  WHERE problem_id NOT IN (SELECT problem_id FROM bench) GROUP BY run
)
SELECT run, count(*) AS num_problems, count(*) FILTER (has_correct) AS pass_at_n,
       CAST(sum(num_correct) AS BIGINT) AS average_at_n, count(*) FILTER (majority_correct) AS majority_vote_at_n,
       CAST(sum(num_formatted) AS BIGINT) AS formatted_count, count(*) * {b.VAL_N} AS total_solutions,
       round(count(*) FILTER (has_correct) / count(*) * 100, 6) AS pass_at_n_pct,
       round(sum(num_correct) / (count(*) * {b.VAL_N}) * 100, 6) AS average_at_n_pct,
       round(count(*) FILTER (majority_correct) / count(*) * 100, 6) AS majority_vote_at_n_pct,
       round(sum(num_formatted) / (count(*) * {b.VAL_N}) * 100, 6) AS format_rate,
       coalesce(any_value(num_without_gold), 0) AS num_without_gold
FROM complete LEFT JOIN strays USING (run) GROUP BY run""",
)
def benchmark_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the problems of a benchmark: most have no samples, some samples no problem."""
    problem = F.col("c_custkey") - 1
    benchmark = (
        b.table(spark, sf_dir, "customer")
        .where(F.pmod("c_custkey", F.lit(10)) != 0)
        .select(problem.alias("problem_id"), F.pmod(problem, F.lit(3)).cast("string").alias("gt_answer"))
    )
    generations = b.samples(spark, sf_dir).drop("gold")
    metrics = evaluate_benchmark(generations, benchmark, [f"checkpoint-{step}" for step in _STEPS], b.VAL_N)
    return rounded(metrics, *_RATES)


_RUNNING = f"""WITH {b.PROBLEMS},
running AS (
  SELECT run, problem_id, count(*) OVER w AS seen,
         round(count(*) FILTER (has_correct) OVER w / count(*) OVER w * 100, 6) AS pass_at_n_pct,
         round(sum(num_correct) OVER w / (count(*) OVER w * {b.VAL_N}) * 100, 6) AS average_at_n_pct,
         round(sum(num_formatted) OVER w / (count(*) OVER w * {b.VAL_N}) * 100, 6) AS format_rate
  FROM problems
  WINDOW w AS (PARTITION BY run ORDER BY problem_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""
_RUNNING_COLUMNS = ("run", "problem_id", "seen", "pass_at_n_pct", "average_at_n_pct", "format_rate")


@query("running_metrics", _RUNNING + " SELECT * FROM running")
def running_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = grading.problem_results(b.samples(spark, sf_dir), expressions=False)
    running = grading.running_metrics(results, b.VAL_N)
    return rounded(running.select(*_RUNNING_COLUMNS), *_RUNNING_COLUMNS[3:])


@query("progress_rows", _RUNNING + " SELECT * FROM running WHERE (problem_id + 1) % 10 = 0")
def progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = evaluate_math(b.samples(spark, sf_dir), b.VAL_N, expressions=False).progress
    return rounded(progress.select(*_RUNNING_COLUMNS), *_RUNNING_COLUMNS[3:])


@query(
    "nested_results",
    f"""WITH {b.PROBLEMS}
        SELECT s.run, s.problem_id, CAST(s.sample_idx // 256 AS INTEGER) AS part, count(*) AS num_generations,
               string_agg(shown, '|' ORDER BY sample_idx) AS predicted_answers,
               string_agg(text, '|' ORDER BY sample_idx) AS full_generations,
               any_value(p.num_correct) AS num_correct, any_value(p.has_correct) AS pass_at_n,
               any_value(p.majority_correct) AS majority_vote_correct, {b.VAL_N} AS val_n, min(gold) AS ground_truth,
               CAST(s.problem_id AS VARCHAR) AS id,
               min_by(shown, sample_idx) AS predicted_answer, min_by(text, sample_idx) AS full_generation,
               min_by(is_correct, sample_idx) AS correct, min_by(is_formatted, sample_idx) AS formatted
        FROM samples s JOIN problems p ON p.run = s.run AND p.problem_id = s.problem_id
        GROUP BY s.run, s.problem_id, part""",
)
def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = evaluate_math(b.samples(spark, sf_dir), b.VAL_N, expressions=False).nested
    return nested.select(
        "run",
        "problem_id",
        "part",
        F.size("generations").cast("long").alias("num_generations"),
        F.array_join("generations.predicted_answer", "|").alias("predicted_answers"),
        F.array_join("generations.full_generation", "|").alias("full_generations"),
        "num_correct",
        "pass_at_n",
        "majority_vote_correct",
        "val_n",
        "ground_truth",
        "id",
        "predicted_answer",
        "full_generation",
        "correct",
        "formatted",
    )


@query(
    "result_ids",
    """SELECT doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'q' || CAST(doc_id AS VARCHAR) END,
                               CAST(doc_id AS VARCHAR)) AS problem_id
       FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def result_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").select("doc_id")
    joined = documents.join(b.table(spark, sf_dir, "labels"), "doc_id", "left")
    question = F.when(F.col("quality") == 1, F.concat(F.lit("q"), F.col("doc_id").cast("string")))
    return joined.select("doc_id", grading.result_id(question, F.col("doc_id")).alias("problem_id"))


@query(
    "gain_over_base",
    _METRICS
    + """,
scores AS (SELECT CAST(regexp_extract(run, '[0-9]+$') AS BIGINT) AS step, average_at_n_pct AS score FROM metrics)
SELECT 'bench' AS benchmark, step, score, round(score - first_value(score) OVER (ORDER BY step), 6) AS gain_over_base,
       round(score - lag(score) OVER (ORDER BY step), 6) AS gain_over_previous
FROM scores""",
)
def gain_over_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = evaluate_math(b.samples(spark, sf_dir), b.VAL_N, expressions=False).metrics
    scores = metrics.select(
        F.lit("bench").alias("benchmark"),
        F.regexp_extract("run", r"(\d+)$", 1).cast("long").alias("step"),
        F.round("average_at_n_pct", 6).alias("score"),
    )
    return rounded(grading.gain_over_base(scores), "gain_over_base", "gain_over_previous")


@query(
    "checkpoint_sweep",
    f"""WITH {b.SAMPLES}
        SELECT 'model' AS model, CASE WHEN run <> 'checkpoint-0' THEN run END AS checkpoint,
               round(avg(CAST(is_correct AS DOUBLE)), 6) AS score, count(*) AS num_rows,
               CASE WHEN run <> 'checkpoint-0' THEN CAST(regexp_extract(run, '[0-9]+$') AS BIGINT) END AS step
        FROM samples GROUP BY run""",
)
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = grading.grade_samples(b.samples(spark, sf_dir), expressions=False).select(
        F.lit("model").alias("model"),
        F.when(F.col("run") != "checkpoint-0", F.col("run")).alias("checkpoint"),
        "is_correct",
    )
    return checkpoint_sweep(graded, F.round(F.avg(F.col("is_correct").cast("double")), 6))


# --- Multiple choice ----------------------------------------------------------------


def _scored_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice_benchmark(b.choice_examples(spark, sf_dir), b.choice_responses(spark, sf_dir))


@query(
    "scored_choices",
    f"""WITH {b.CHOICES}
        SELECT row_index, question_id, category, source, gold_answer, predicted_answer,
               coalesce(predicted_answer = gold_answer, false) AS is_correct, response, prompt, missing
        FROM scored""",
)
def scored_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_choices(spark, sf_dir)


@query(
    "choice_metrics",
    f"""WITH {b.CHOICES}
        SELECT round(count(*) FILTER (predicted_answer = gold_answer) / count(*), 6) AS mc_accuracy,
               round(count(predicted_answer) / count(*), 6) AS mc_extraction_rate, count(*) AS mc_num_prompts,
               nullif(count(*) FILTER (missing), 0) AS mc_missing_prompts
        FROM scored""",
)
def choice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = benchmarks.choice_metrics(_scored_choices(spark, sf_dir))
    return rounded(metrics, "mc_accuracy", "mc_extraction_rate")


@query(
    "choice_report",
    f"""WITH {b.CHOICES}
        SELECT source, category, round(count(*) FILTER (predicted_answer = gold_answer) / count(*), 6) AS mc_accuracy,
               count(*) AS mc_num_prompts, CAST(grouping(source, category) AS INTEGER) AS level
        FROM scored GROUP BY ROLLUP (source, category)""",
)
def choice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(benchmarks.choice_report(_scored_choices(spark, sf_dir)), "mc_accuracy")


# --- Instruction following ----------------------------------------------------------


@query(
    "instruction_metrics",
    """SELECT l_returnflag, round(avg(CAST(a AND b AND c AS DOUBLE)), 6) AS prompt_level,
              round(sum(a::INT + b::INT + c::INT) / (3 * count(*)), 6) AS instruction_level,
              count(*) AS num_prompts, 3 * count(*) AS num_instructions
       FROM (SELECT l_returnflag, l_quantity > 10 AS a, l_discount < 0.08 AS b, l_tax > 0.01 AS c FROM lineitem)
       GROUP BY l_returnflag""",
)
def instruction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    followed = F.array(F.col("l_quantity") > 10, F.col("l_discount") < 0.08, F.col("l_tax") > 0.01)
    lines = b.table(spark, sf_dir, "lineitem").select("l_returnflag", followed.alias("follow_list"))
    metrics = benchmarks.instruction_metrics(lines, by=["l_returnflag"])
    return rounded(metrics, "prompt_level", "instruction_level")


def _instruction_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts with two instructions; some texts repeat."""
    return b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"),
        F.col("text").alias("prompt"),
        F.array(F.lit("length"), F.lit("language")).alias("instruction_id_list"),
        F.array(
            F.create_map(F.lit("max"), F.col("n_chars").cast("string")),
            F.create_map(F.lit("lang"), F.col("lang")),
        ).alias("kwargs"),
    )


def _instruction_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as responses to their own text."""
    documents = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = b.table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("key"),
        F.col("text").alias("prompt"),
        F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(" toxic "), F.col("toxic").cast("string")).alias(
            "response"
        ),
    )


def _strict(prompt: Column, response: Column, ids: Column, kwargs: Column) -> Column:
    return F.array(F.contains(response, F.lit("quality 1")), F.contains(response, F.lit("toxic 0")))


def _loose(prompt: Column, response: Column, ids: Column, kwargs: Column) -> Column:
    return F.array(response != "", F.contains(response, F.lit("toxic 0")))


# The last answer to a prompt text counts for every example with that text.
_ANSWERED = """answered AS (
  SELECT d.doc_id AS key, d.text, a.quality, a.toxic, a.doc_id IS NULL AS missing
  FROM documents d LEFT JOIN (
    SELECT text, doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1) a ON a.text = d.text
),
rules AS (
  SELECT coalesce(quality = 1, false) AS s1, coalesce(toxic = 0, false) AS s2, NOT missing AS l1, missing, text
  FROM answered
),
levels AS (
  SELECT avg(CAST(s1 AND s2 AS DOUBLE)) AS strict_prompt_level,
         sum(s1::INT + s2::INT) / (2 * count(*)) AS strict_instruction_level,
         avg(CAST(l1 AND s2 AS DOUBLE)) AS loose_prompt_level,
         sum(l1::INT + s2::INT) / (2 * count(*)) AS loose_instruction_level,
         count(*) AS num_prompts, 2 * count(*) AS num_instructions,
         nullif(count(DISTINCT text) FILTER (missing), 0) AS missing_prompts
  FROM rules
)"""


@query(
    "instruction_benchmark",
    f"""WITH {_ANSWERED},
        named AS (UNPIVOT (SELECT * REPLACE (CAST(num_prompts AS DOUBLE) AS num_prompts,
                           CAST(num_instructions AS DOUBLE) AS num_instructions,
                           CAST(missing_prompts AS DOUBLE) AS missing_prompts) FROM levels)
                  ON COLUMNS(*) INTO NAME name VALUE value)
        SELECT 'eval_' || name AS name, round(value, 6) AS value FROM named""",
)
def instruction_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate(
        _instruction_examples(spark, sf_dir), _instruction_responses(spark, sf_dir), _strict, _loose
    )
    return rounded(rows, "value")


@query(
    "evaluate_named_datasets",
    f"""WITH {b.CHOICES}, {_ANSWERED},
        metrics AS (
          SELECT 'eval_choice_mc_accuracy' AS name,
                 count(*) FILTER (predicted_answer = gold_answer) / count(*) AS value FROM scored
          UNION ALL SELECT 'eval_choice_mc_extraction_rate', count(predicted_answer) / count(*) FROM scored
          UNION ALL SELECT 'eval_choice_mc_num_prompts', count(*) FROM scored
          UNION ALL SELECT 'eval_choice_mc_missing_prompts', nullif(count(*) FILTER (missing), 0) FROM scored
          UNION ALL SELECT 'eval_rules_strict_prompt_level', strict_prompt_level FROM levels
          UNION ALL SELECT 'eval_rules_strict_instruction_level', strict_instruction_level FROM levels
          UNION ALL SELECT 'eval_rules_loose_prompt_level', loose_prompt_level FROM levels
          UNION ALL SELECT 'eval_rules_loose_instruction_level', loose_instruction_level FROM levels
          UNION ALL SELECT 'eval_rules_num_prompts', num_prompts FROM levels
          UNION ALL SELECT 'eval_rules_num_instructions', num_instructions FROM levels
          UNION ALL SELECT 'eval_rules_missing_prompts', missing_prompts FROM levels
          UNION ALL SELECT 'eval_events_loss', avg(value) FROM events)
        SELECT name, round(CAST(value AS DOUBLE), 9) AS value FROM metrics WHERE value IS NOT NULL""",
)
def evaluate_named_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three datasets, each routed by its columns: choice, instruction, generic."""
    datasets = {
        "choice": b.choice_examples(spark, sf_dir),
        "rules": _instruction_examples(spark, sf_dir),
        "events": b.table(spark, sf_dir, "events").select(F.col("value").alias("loss")),
    }
    responses = {
        "choice": b.choice_responses(spark, sf_dir),
        "rules": _instruction_responses(spark, sf_dir),
    }
    rows = evaluate(datasets, responses, _strict, _loose)
    return rows.withColumn("value", F.round("value", 9))


@query(
    "union_named_datasets",
    """SELECT 'eval_' || dataset || '_mean_length' AS name, round(avg(length(text)), 6) AS value
       FROM (SELECT 'documents' AS dataset, text FROM documents
             UNION ALL SELECT 'benchmark', text FROM benchmark
             UNION ALL SELECT 'conversations', text FROM conversations)
       GROUP BY dataset""",
)
def union_named_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of different columns in one pass, metrics under prefixed names."""
    names = ("documents", "benchmark", "conversations")
    united = union_named({name: b.table(spark, sf_dir, name) for name in names})
    metrics = united.groupBy("dataset").agg(F.avg(F.length("text")).alias("mean_length"))
    return rounded(prefixed_metrics(metrics, ["mean_length"]), "value")


@query(
    "custom_metrics",
    f"""WITH {b.SAMPLES}
        SELECT run, round(avg(CASE WHEN is_correct THEN 1.0 WHEN is_formatted THEN 0.25 ELSE 0.0 END), 6) AS partial_credit,
               CAST(max(length(text)) AS INTEGER) AS longest
        FROM samples GROUP BY run""",
)
def custom_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial credit for a box with a wrong answer, as a user may want it."""
    graded = grading.grade_samples(b.samples(spark, sf_dir), expressions=False)
    credit = F.when(F.col("is_correct"), 1.0).when(F.col("is_formatted"), 0.25).otherwise(0.0)
    return benchmarks.custom_metrics(
        graded,
        {"partial_credit": F.round(F.avg(credit), 6), "longest": F.max(F.length("text"))},
        ["run"],
    )


@query(
    "rule_scorer_hook",
    """SELECT event_type, round(avg(CAST(a AND b AS DOUBLE)), 6) AS prompt_level,
              round(sum(a::INT + b::INT) / (2 * count(*)), 6) AS instruction_level, count(*) AS num_prompts,
              2 * count(*) AS num_instructions
       FROM (SELECT event_type, length(props) <= 9 AS a, props LIKE '%5%' AS b FROM events)
       GROUP BY event_type""",
)
def rule_scorer_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's vectorised rule checker feeding the native metrics."""

    @F.pandas_udf("array<boolean>")
    def check(text):
        followed = np.column_stack([text.str.len() <= 9, text.str.contains("5", regex=False)])
        return pd.Series(list(followed))

    scored = benchmarks.apply_scorer(b.table(spark, sf_dir, "events"), check, "props")
    metrics = benchmarks.instruction_metrics(scored, by=["event_type"])
    return rounded(metrics, "prompt_level", "instruction_level")


@query(
    "instruction_scorer_hook",
    """SELECT lang, round(avg(CAST(a AND b AS DOUBLE)), 6) AS prompt_level,
              round(sum(a::INT + b::INT) / (2 * count(*)), 6) AS instruction_level, count(*) AS num_prompts,
              2 * count(*) AS num_instructions
       FROM (SELECT lang, length(text) + doc_id % 2 <= n_chars AS a, contains(text, lang) AS b FROM documents)
       GROUP BY lang""",
)
def instruction_scorer_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's rule checker over prompt, response, instruction ids and their arguments."""

    @F.pandas_udf("array<boolean>")
    def check(prompt, response, ids, kwargs):
        def holds(text, name, given):
            given = dict(given)
            return len(text) <= int(given["max"]) if name == "length" else given["lang"] in text

        rows = zip(response, ids, kwargs)
        return pd.Series([[holds(text, n, g) for n, g in zip(names, args)] for text, names, args in rows])

    odd = F.pmod("key", F.lit(2)) == 1
    answered = _instruction_examples(spark, sf_dir).withColumn(
        "response", F.when(odd, F.concat("prompt", F.lit("!"))).otherwise(F.col("prompt"))
    )
    scored = benchmarks.apply_scorer(answered, check, "prompt", "response", "instruction_id_list", "kwargs")
    by_lang = scored.withColumn("lang", F.get("kwargs", F.lit(1))["lang"])
    return rounded(benchmarks.instruction_metrics(by_lang, by=["lang"]), "prompt_level", "instruction_level")


@query(
    "reward_hook",
    """SELECT event_type, round(avg(CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) > 50 THEN 1.0
                                         ELSE 0.0 END), 6) AS mean_reward
       FROM events GROUP BY event_type""",
)
def reward_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's reward function over completions, in Arrow batches."""

    @F.pandas_udf("double")
    def reward(text):
        return (text.str.extract(r"(\d+)", expand=False).astype(int) > 50).astype(float)

    scored = benchmarks.apply_scorer(b.table(spark, sf_dir, "events"), reward, "props", name="reward")
    return scored.groupBy("event_type").agg(F.round(F.avg("reward"), 6).alias("mean_reward"))


@query(
    "batch_function_hook",
    "SELECT event_id, length(props) AS prompt_length FROM events",
)
def batch_function_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's batch function over iterators of pandas frames."""

    def measure(batches):
        for batch in batches:
            yield batch[["event_id"]].assign(prompt_length=batch["props"].str.len())

    events = b.table(spark, sf_dir, "events").select("event_id", "props")
    return benchmarks.apply_batches(events, measure, "event_id long, prompt_length long")


@query(
    "responses_last_wins",
    """SELECT event_id // 2 AS row_index, max(event_id) AS arrival,
              max_by(event_type, event_id) AS event_type
       FROM events GROUP BY 1""",
)
def responses_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gathered responses: the last one per index, in index order."""
    gathered = b.table(spark, sf_dir, "events").select(
        b.div("event_id", 2).alias("row_index"), F.col("event_id").alias("arrival"), "event_type"
    )
    return last_per_key(gathered, ["row_index"], "arrival").orderBy("row_index")
