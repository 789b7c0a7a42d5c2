"""Distillation report: the loss of a table of logits under either objective."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rolltally.operators import distill


def distill_report(
    logits: DataFrame,
    by: Sequence[str] = (),
    sampled_tokens_only: bool = False,
    beta: float = 0.5,
    temperature: float = 1.0,
    top_k: int | None = None,
    clip: float | None = None,
    reduction: str = "batchmean",
    label: str | None = "label",
) -> DataFrame:
    """Loss per group: full-vocabulary divergence, or the sampled-token objective.

    Logits are reduced to a few numbers inside their row before anything is shuffled.
    """
    if sampled_tokens_only:
        sampled = distill.sampled_log_probs(logits, temperature=temperature)
        return distill.sampled_token_objective(sampled, by, label).select(*by, "loss", "num_tokens")
    return distill.divergence_loss(
        logits,
        by,
        beta=beta,
        temperature=temperature,
        top_k=top_k,
        clip=clip,
        reduction=reduction,
        label=label,
    )
