"""Prompt building: the texts student, teacher, trainer and evaluator get to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolltally.functions import fixed_values as fixed
from rolltally.functions.conversation import CHATML, ChatTemplate, message, render_chat, render_user_prompt
from rolltally.functions.text import is_blank, require_text
from rolltally.operators.contracts import check_format, check_teacher_options, require_text_type


# --- Texts --------------------------------------------------------------------------


def student_text(fmt: str, prompt: Column) -> Column:
    """What the student is asked; instruction prompts pass unchanged."""
    check_format(fmt)
    if fmt != fixed.MATH_FORMAT:
        return prompt
    return F.concat(F.lit("Problem: "), prompt, F.lit("\n\n" + fixed.STEP_BY_STEP))


def student_text_mixed(fmt: Column, prompt: Column) -> Column:
    """As ``student_text`` for tables that mix formats in a column."""
    unknown = F.concat(F.lit("Unsupported format "), F.coalesce(fmt, F.lit("null")))
    return (
        F.when(fmt == fixed.MATH_FORMAT, student_text(fixed.MATH_FORMAT, prompt))
        .when(fmt.isin(*fixed.INSTRUCTION_FORMATS), prompt)
        .otherwise(F.raise_error(unknown).cast("string"))
    )


def teacher_math_text(problem: Column, solution: Column) -> Column:
    """Problem with its reference solution and the request to derive it anew."""
    return F.concat(
        F.lit("Problem: "),
        problem,
        F.lit("\n\n" + fixed.REFERENCE_SOLUTION_LEAD + fixed.REFERENCE_SOLUTION_BEGIN),
        solution,
        F.lit(fixed.REFERENCE_SOLUTION_END + fixed.TRANSITION + "\n" + fixed.STEP_BY_STEP),
    )


def reasoning_text(problem: Column, solution: Column) -> Column:
    """Request to explain a reference solution before teaching it."""
    return F.concat(
        F.lit("Problem: "),
        problem,
        F.lit("\n\n" + fixed.REFERENCE_REASONING_LEAD + fixed.REFERENCE_REASONING_START),
        solution,
        F.lit(fixed.REFERENCE_REASONING_END + fixed.REASON_FIRST),
    )


def transition_text() -> Column:
    """Text between a teacher's reasoning and its teaching; not a chat message."""
    return F.lit("\n" + fixed.TRANSITION + "\n" + fixed.STEP_BY_STEP)


def instruction_teacher_text(prompt: Column, reference: Column) -> Column:
    """Prompt together with a reference answer."""
    return F.concat(
        prompt, F.lit(fixed.REFERENCE_ANSWER_INTRO), reference, F.lit(fixed.REFERENCE_ANSWER_OUTRO)
    )


def eval_text(problem: Column) -> Column:
    """Problem as evaluated, and as trained on with its solution."""
    return F.concat(problem, F.lit("\n\n" + fixed.STEP_BY_STEP))


def rl_text(question: Column) -> Column:
    """Question as rewarded; one line break only."""
    return F.concat(F.lit("Problem: "), question, F.lit("\n" + fixed.STEP_BY_STEP))


def teacher_prompt_or_built(teacher_prompt: Column | None, built: Column | None) -> Column:
    """The given teacher prompt where it is not blank, else the built one; fails on neither."""
    failure = F.raise_error(
        F.lit("A teacher prompt or a reference answer is needed, and both are missing.")
    ).cast("string")
    choice = failure if built is None else F.when(built.isNotNull(), built).otherwise(failure)
    if teacher_prompt is None:
        return choice
    return F.when(~is_blank(teacher_prompt), teacher_prompt).otherwise(choice)


def without_pad(text: Column, pad_token: str) -> Column:
    """Decoded prompt without pad tokens."""
    return F.replace(text, F.lit(pad_token), F.lit(""))


# --- Tables -------------------------------------------------------------------------


def build_prompts(
    df: DataFrame,
    fmt: str = fixed.MATH_FORMAT,
    prompt_column: str = "problem",
    solution_column: str = "solution",
    teacher_prompt_column: str | None = "teacher_prompt",
    teacher_reference_column: str | None = None,
    reason_first: bool = False,
    template: ChatTemplate | None = CHATML,
    student_thinking: bool = False,
    teacher_thinking: bool = True,
) -> DataFrame:
    """Add student and teacher prompts for distillation.

    With ``reason_first`` the teacher columns are the reasoning prompt and the transition
    text instead of one teacher prompt. ``template=None`` leaves the texts bare.
    """
    check_teacher_options(fmt, reason_first)
    require_text_type(df, prompt_column)
    prompt = require_text(F.col(prompt_column), prompt_column)

    def chat(text: Column, thinking: bool) -> Column:
        return text if template is None else render_user_prompt(text, template, thinking)

    added = {"student_prompt": chat(student_text(fmt, prompt), student_thinking)}
    if fmt == fixed.MATH_FORMAT:
        require_text_type(df, solution_column)
        solution = require_text(F.col(solution_column), solution_column)
        if reason_first:
            added["teacher_reasoning_prompt"] = chat(reasoning_text(prompt, solution), teacher_thinking)
            added["teacher_transition"] = transition_text()
            return df.withColumns(added)
        teacher = teacher_math_text(prompt, solution)
    else:
        given = F.col(teacher_prompt_column) if teacher_prompt_column in df.columns else None
        built = None
        if teacher_reference_column is not None:
            # Only rows without a teacher prompt of their own need the reference.
            built = instruction_teacher_text(prompt, F.col(teacher_reference_column))
        teacher = teacher_prompt_or_built(given, built)
    added["teacher_prompt_text"] = chat(teacher, teacher_thinking)
    return df.withColumns(added)


def build_shared_prompts(
    df: DataFrame,
    fmt: str = fixed.MATH_FORMAT,
    prompt_column: str = "problem",
    template: ChatTemplate | None = CHATML,
    enable_thinking: bool = False,
) -> DataFrame:
    """Add one prompt that student and teacher share."""
    require_text_type(df, prompt_column)
    text = student_text(fmt, require_text(F.col(prompt_column), prompt_column))
    if template is not None:
        text = render_user_prompt(text, template, enable_thinking)
    return df.withColumn("student_prompt", text).withColumn("teacher_prompt_text", F.col("student_prompt"))


def build_sft_text(
    df: DataFrame,
    problem_column: str = "problem",
    solution_column: str = "solution",
    template: ChatTemplate = CHATML,
) -> DataFrame:
    """Add the training text: problem as user message, solution as assistant message."""
    messages = F.array(
        message("user", eval_text(F.col(problem_column))), message("assistant", F.col(solution_column))
    )
    return df.withColumn("text", render_chat(messages, template))


def build_rl_prompts(
    df: DataFrame,
    question_column: str = "Question",
    answer_column: str = "Answer",
    template: ChatTemplate = CHATML,
) -> DataFrame:
    """Replace all columns by the prompt and the gold answer."""
    return df.select(
        render_user_prompt(rl_text(F.col(question_column)), template).alias("prompt"),
        F.col(answer_column).alias("Answer"),
    )


def build_eval_prompts(
    df: DataFrame,
    problem_column: str = "problem",
    template: ChatTemplate = CHATML,
    enable_thinking: bool = True,
) -> DataFrame:
    """Add the evaluation prompt."""
    text = eval_text(F.col(problem_column))
    return df.withColumn("prompt_text", render_user_prompt(text, template, enable_thinking))
