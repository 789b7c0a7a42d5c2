"""Plans, not results: no Python in built-in operators, few shuffles, pruned scans."""

import re

import pytest

from conftest import SF_DIR
from rolltally.catalog import ORACLES, QUERIES
from rolltally.catalog.bindings import logits as distill_input

HOOKS = {"rule_scorer_hook", "instruction_scorer_hook", "reward_hook", "batch_function_hook"}
PYTHON = re.compile(r"ArrowEvalPython|BatchEvalPython|MapInPandas|PythonUDF")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """Shuffles of the executed plan, each reused one once."""
    df.collect()
    text = plan(df).split("+- == Initial Plan ==")[0]
    return len(re.findall(r"Exchange (?:hash|range|round|Single)", text)) - len(re.findall("ReusedExchange", text))


@pytest.fixture(scope="module")
def large_tables(spark):
    """Plan as if no side were small enough to be broadcast by size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HOOKS))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not PYTHON.search(text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name",
    [
        "boxed_first_after_thinking",
        "boxed_last_marker",
        "fallback_answer",
        "graded_samples",
        "correctness_reward",
        "mixed_format_prompts",
        "shared_prompts",
        "fitted_completions",
        "prompts_without_pad",
    ],
)
def test_row_work_does_not_shuffle(spark, name):
    assert shuffles(QUERIES[name](spark, SF_DIR)) == 0


@pytest.mark.parametrize(
    "name, most",
    [
        ("problem_results", 2),
        ("math_run_metrics", 3),
        ("nested_results", 9),
        ("metric_means", 1),
        ("policy_losses", 1),
        ("last_log_rows", 1),
        ("responses_last_wins", 2),
        ("running_metrics", 5),
        ("instruction_metrics", 1),
    ],
)
def test_shuffle_counts(spark, large_tables, name, most):
    assert shuffles(QUERIES[name](spark, SF_DIR)) <= most


@pytest.mark.parametrize(
    "name, columns",
    [
        ("math_run_metrics", {"event_id", "user_id", "event_type", "props"}),
        ("instruction_metrics", {"l_returnflag", "l_quantity", "l_discount", "l_tax"}),
        ("sft_split", {"doc_id"}),
        ("policy_losses", {"event_id", "user_id", "value"}),
        ("generation_stats", {"role", "text"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    text = plan(QUERIES[name](spark, SF_DIR))
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", text))))
    assert read == columns


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["read_registered_table"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[.*EqualTo\(lang,en\)", text)


@pytest.mark.parametrize(
    "name, most",
    [("divergence_losses", 1), ("divergence_reductions", 1), ("student_logits_at_teacher_top_k", 1)],
)
def test_logits_are_read_once(spark, name, most):
    one = plan(distill_input(spark, SF_DIR)).count("FileScan")
    assert plan(QUERIES[name](spark, SF_DIR)).count("FileScan") <= most * one


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES)
