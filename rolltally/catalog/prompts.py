"""Prompt building on conversation turns, benchmark items and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolltally.catalog import bindings as b
from rolltally.catalog.registry import query
from rolltally.functions import fixed_values as fixed
from rolltally.functions.conversation import render_chat
from rolltally.operators import contracts, prompts


def quoted(text: str) -> str:
    """A Python text as SQL literal."""
    return "'" + text.replace("'", "''") + "'"


_STEPS = quoted(fixed.STEP_BY_STEP)
_BREAKS = "chr(10) || chr(10)"


def chat(text: str, thinking: bool = True) -> str:
    """SQL text of one user message with the generation marker."""
    silent = "" if thinking else " || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)"
    return (
        f"'<|im_start|>user' || chr(10) || {text} || '<|im_end|>' || chr(10) || "
        f"'<|im_start|>assistant' || chr(10){silent}"
    )


_STUDENT = f"'Problem: ' || problem || {_BREAKS} || {_STEPS}"
_TEACHER = (
    f"'Problem: ' || problem || {_BREAKS} || {quoted(fixed.REFERENCE_SOLUTION_LEAD)} || "
    f"{quoted(fixed.REFERENCE_SOLUTION_BEGIN)} || solution || {quoted(fixed.REFERENCE_SOLUTION_END)} || "
    f"{quoted(fixed.TRANSITION)} || chr(10) || {_STEPS}"
)
_REASONING = (
    f"'Problem: ' || problem || {_BREAKS} || {quoted(fixed.REFERENCE_REASONING_LEAD)} || "
    f"{quoted(fixed.REFERENCE_REASONING_START)} || solution || {quoted(fixed.REFERENCE_REASONING_END)} || "
    f"{quoted(fixed.REASON_FIRST)}"
)


@query(
    "distillation_prompts",
    f"""WITH {b.TURN_PAIRS}
        SELECT conv_id, turn, {chat(_STUDENT, thinking=False)} AS student_prompt,
               {chat(_TEACHER)} AS teacher_prompt_text FROM pairs""",
)
def distillation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prompts.build_prompts(b.turn_pairs(spark, sf_dir))
    return built.select("conv_id", "turn", "student_prompt", "teacher_prompt_text")


@query(
    "reasoning_first_prompts",
    f"""WITH {b.TURN_PAIRS}
        SELECT conv_id, turn, {chat(_REASONING)} AS teacher_reasoning_prompt,
               chr(10) || {quoted(fixed.TRANSITION)} || chr(10) || {_STEPS} AS teacher_transition FROM pairs""",
)
def reasoning_first_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prompts.build_prompts(b.turn_pairs(spark, sf_dir), reason_first=True)
    return built.select("conv_id", "turn", "teacher_reasoning_prompt", "teacher_transition")


@query(
    "instruction_teacher_prompts",
    f"""SELECT doc_id, d.text AS student_prompt,
               CASE WHEN l.quality = 1 THEN 'Hint: ' || d.lang
                    ELSE d.text || {quoted(fixed.REFERENCE_ANSWER_INTRO)} || d.source ||
                         {quoted(fixed.REFERENCE_ANSWER_OUTRO)} END AS teacher_prompt_text
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def instruction_teacher_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher prompts where labelled good, blank where labelled bad, absent elsewhere."""
    joined = b.table(spark, sf_dir, "documents").join(b.table(spark, sf_dir, "labels"), "doc_id", "left")
    given = F.when(F.col("quality") == 1, F.concat(F.lit("Hint: "), "lang")).when(
        F.col("quality") == 0, F.lit(" \n\t　")
    )
    table = joined.select("doc_id", F.col("text").alias("prompt"), "source", given.alias("teacher_prompt"))
    built = prompts.build_prompts(
        table,
        fmt="prompt_teacher_prompt",
        prompt_column="prompt",
        teacher_reference_column="source",
        template=None,
    )
    return built.select("doc_id", "student_prompt", "teacher_prompt_text")


@query(
    "shared_prompts",
    f"""SELECT item_id, {chat(f"'Problem: ' || text || {_BREAKS} || {_STEPS}", thinking=False)} AS student_prompt,
               {chat(f"'Problem: ' || text || {_BREAKS} || {_STEPS}", thinking=False)} AS teacher_prompt_text
        FROM benchmark""",
)
def shared_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prompts.build_shared_prompts(b.table(spark, sf_dir, "benchmark"), prompt_column="text")
    return built.drop("text")


@query(
    "mixed_format_prompts",
    f"""SELECT doc_id, CASE WHEN lang = 'en' THEN 'Problem: ' || text || {_BREAKS} || {_STEPS} ELSE text END
               AS student_prompt FROM documents""",
)
def mixed_format_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that mixes dataset formats."""
    fmt = F.when(F.col("lang") == "en", F.lit("math")).otherwise(F.lit("instruction"))
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", prompts.student_text_mixed(fmt, F.col("text")).alias("student_prompt")
    )


@query(
    "sft_text",
    f"""WITH {b.TURN_PAIRS}
        SELECT conv_id, turn, '<|im_start|>user' || chr(10) || problem || {_BREAKS} || {_STEPS} || '<|im_end|>' ||
               chr(10) || '<|im_start|>assistant' || chr(10) || solution || '<|im_end|>' || chr(10) AS text
        FROM pairs""",
)
def sft_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prompts.build_sft_text(b.turn_pairs(spark, sf_dir))
    return built.select("conv_id", "turn", "text")


@query(
    "rl_prompts",
    f"""SELECT {chat(f"'Problem: ' || text || chr(10) || {_STEPS}")} AS prompt,
               CAST(item_id AS VARCHAR) AS "Answer" FROM benchmark""",
)
def rl_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = b.table(spark, sf_dir, "benchmark").select(
        F.col("text").alias("Question"), F.col("item_id").cast("string").alias("Answer"), "item_id"
    )
    return prompts.build_rl_prompts(questions)


@query(
    "eval_prompts",
    f"""SELECT item_id, {chat(f"text || {_BREAKS} || {_STEPS}")} AS prompt_text FROM benchmark""",
)
def eval_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.build_eval_prompts(b.table(spark, sf_dir, "benchmark"), "text").drop("text")


@query(
    "rendered_conversations",
    f"""WITH {b.TURN_PAIRS}
        SELECT conv_id, turn, '<|im_start|>' || ask_role || chr(10) || problem || '<|im_end|>' || chr(10) ||
               '<|im_start|>' || tell_role || chr(10) || solution || '<|im_end|>' || chr(10) ||
               '<|im_start|>assistant' || chr(10) AS rendered
        FROM pairs""",
)
def rendered_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = F.array(
        F.struct(F.col("ask_role").alias("role"), F.col("problem").alias("content")),
        F.struct(F.col("tell_role").alias("role"), F.col("solution").alias("content")),
    )
    return b.turn_pairs(spark, sf_dir).select(
        "conv_id", "turn", render_chat(messages, add_generation_marker=True).alias("rendered")
    )


@query(
    "prompts_without_pad",
    "SELECT conv_id, turn, replace(text, 'e', '') AS prompt FROM conversations",
)
def prompts_without_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded prompts in which pad tokens stand between all letters e."""
    padded = F.replace("text", F.lit("e"), F.lit("<|endoftext|>"))
    return b.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", prompts.without_pad(padded, "<|endoftext|>").alias("prompt")
    )


@query(
    "signature_columns",
    f"""WITH {b.TURN_PAIRS}
        SELECT problem, solution, conv_id FROM pairs""",
)
def signature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known columns first, then those named by parameters, each once."""
    return contracts.select_signature(b.turn_pairs(spark, sf_dir), "solution", "conv_id", "absent", None)


@query(
    "checked_columns",
    f"""WITH {b.TURN_PAIRS}
        SELECT conv_id, turn, length(problem) AS problem_length FROM pairs""",
)
def checked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column contract and text types checked before anything runs."""
    pairs = contracts.require_columns(b.turn_pairs(spark, sf_dir), "math", "problem", "solution")
    contracts.require_text_type(pairs, "problem", "solution")
    required = prompts.require_text(F.col("problem"), "problem")
    return pairs.select("conv_id", "turn", F.length(required).cast("long").alias("problem_length"))


@query(
    "single_message_text",
    """SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
       FROM conversations""",
)
def single_message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("role", F.col("text").alias("content"))
    return b.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", render_chat(F.array(turn)).alias("rendered")
    )
