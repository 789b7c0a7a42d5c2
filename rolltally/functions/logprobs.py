"""Log-probabilities and divergence cells over vocabulary-wide arrays.

Everything stays inside one row, so no vocabulary-sized shuffle is needed. Values used
inside a lambda are bound with ``let`` so that they are computed once per array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolltally.functions.fixed_values import MIN_PROBABILITY
from rolltally.functions.text import let


def scaled(x: Column, temperature: float) -> Column:
    return x if temperature == 1 else x / temperature


def log_sum_exp(logits: Column, temperature: float = 1.0) -> Column:
    """log(sum(exp(logits / temperature))), shifted by the maximum."""
    return let(
        F.array_max(logits),
        lambda top: scaled(top, temperature)
        + F.log(
            F.aggregate(
                logits, F.lit(0.0), lambda total, x: total + F.exp(scaled(x - top, temperature))
            )
        ),
    )


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    return let(
        log_sum_exp(logits, temperature),
        lambda norm: F.transform(logits, lambda x: scaled(x, temperature) - norm),
    )


def token_log_prob(logits: Column, token_id: Column, temperature: float = 1.0) -> Column:
    """Log-probability of one token, without building the whole distribution."""
    return scaled(F.get(logits, token_id), temperature) - log_sum_exp(logits, temperature)


def log_of_probabilities(probabilities: Column) -> Column:
    return F.transform(probabilities, lambda p: F.log(F.greatest(p, F.lit(MIN_PROBABILITY))))


def keep_top_k(student: Column, teacher: Column, k: int) -> Column:
    """Struct (token_id, student, teacher) arrays of the teacher's k highest logits.

    Ties go to the smaller token id.
    """
    cells = F.transform(
        F.arrays_zip(teacher.alias("t"), same_vocabulary(student, teacher).alias("s")),
        lambda cell, i: F.struct(
            (-cell["t"]).alias("order"), i.alias("token_id"), cell["s"].alias("s"), cell["t"].alias("t")
        ),
    )
    return let(
        F.slice(F.array_sort(cells), 1, k),
        lambda top: F.struct(
            F.transform(top, lambda c: c["token_id"]).alias("token_id"),
            F.transform(top, lambda c: c["s"]).alias("student"),
            F.transform(top, lambda c: c["t"]).alias("teacher"),
        ),
    )


def divergence_cell(student: Column, teacher: Column, beta: float) -> Column:
    """One vocabulary cell of the generalised Jensen-Shannon divergence.

    Arguments are log-probabilities. ``beta`` 0 is the forward KL divergence, 1 the
    reverse one, and values between interpolate by a mixture distribution.
    """
    if beta == 0:
        return F.exp(teacher) * (teacher - student)
    if beta == 1:
        return F.exp(student) * (student - teacher)
    one, other = student + math.log1p(-beta), teacher + math.log(beta)
    mixture = F.greatest(one, other) + F.log1p(F.exp(-F.abs(one - other)))
    # beta·e^t·(t - m) + (1-beta)·e^s·(s - m), ordered so that the mixture is computed once.
    of_teacher, of_student = F.exp(teacher) * beta, F.exp(student) * (1 - beta)
    return of_teacher * teacher + of_student * student - (of_teacher + of_student) * mixture


def divergence_cells(
    student: Column, teacher: Column, beta: float, clip: float | None = None
) -> Column:
    """Array of cells, each capped at ``clip`` (negative and null cells stay untouched)."""

    def cell(s: Column, t: Column) -> Column:
        return capped(divergence_cell(s, t, beta), clip)

    return F.zip_with(same_vocabulary(student, teacher), teacher, cell)


def capped(value: Column, clip: float | None) -> Column:
    """``value``, at most ``clip``; null stays null."""
    if clip is None:
        return value
    return F.when(value > float(clip), F.lit(float(clip))).otherwise(value)


def same_vocabulary(student: Column, teacher: Column) -> Column:
    """The student's array; fails the job where the teacher's has another length."""
    message = F.concat(
        F.lit("Vocabularies differ in size: "), F.size(student).cast("string"), F.lit(" and "), F.size(teacher).cast("string")
    )
    differ = F.size(student) != F.size(teacher)
    return F.when(differ, F.raise_error(message).cast("array<double>")).otherwise(student)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)
