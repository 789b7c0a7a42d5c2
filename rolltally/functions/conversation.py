"""Rendering of conversations to text; the chat template is an argument."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolltally.functions.text import require_text


@dataclass(frozen=True)
class ChatTemplate:
    """How a tokenizer writes a conversation. ``{role}`` in the prefix is replaced."""

    prefix: str = "<|im_start|>{role}\n"
    suffix: str = "<|im_end|>\n"
    generation_marker: str = "<|im_start|>assistant\n"
    no_thinking_marker: str = "<think>\n\n</think>\n\n"


CHATML = ChatTemplate()


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def render_chat(
    messages: Column,
    template: ChatTemplate = CHATML,
    add_generation_marker: bool = False,
    enable_thinking: bool = True,
) -> Column:
    """Text of a conversation, optionally ending with the marker that asks for a reply.

    A message without content fails the job: leaving out its turn would change who said what.
    """
    before, _, after = template.prefix.partition("{role}")
    turns = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(before),
            m["role"],
            F.lit(after),
            require_text(m["content"], "content"),
            F.lit(template.suffix),
        ),
    )
    text = F.array_join(turns, "")
    if add_generation_marker:
        text = F.concat(text, F.lit(template.generation_marker))
        if not enable_thinking:
            text = F.concat(text, F.lit(template.no_thinking_marker))
    return text


def render_user_prompt(
    prompt: Column, template: ChatTemplate = CHATML, enable_thinking: bool = True
) -> Column:
    """One user message followed by the generation marker."""
    return render_chat(
        F.array(message("user", prompt)),
        template,
        add_generation_marker=True,
        enable_thinking=enable_thinking,
    )
