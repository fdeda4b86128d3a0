"""Prompts of generative models, and what their windows add up to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before and after the user's message, by family of models without a chat template (fixed values).
FAMILIES = {"llama": ("<s>[INST] ", " [/INST]"), "qwen": ("<|im_start|>user\n", "\n<|im_start|>assistant\n")}


def prompt(instruction: Column, text: Column, family: str = "llama", template: Callable[[Column], Column] | None = None) -> Column:
    """Instruction, an empty line and the text, in the signs of a family; a model's own chat template, as a function of the message, goes first."""
    user = F.concat(instruction, F.lit("\n\n"), text)
    if template is not None:
        return template(user)
    before, after = FAMILIES.get(family, FAMILIES["llama"])
    return F.concat(F.lit(before), user, F.lit(after))


def token_stats(windows: Column, chars: Column, cutoff: int, positions: int | None = None) -> Column:
    """struct<num_windows, prompt_tokens, output_tokens, longest, remaining, cropped> of array<struct<chars, prompt, output>>.

    longest: the most tokens of prompt and output in one window; remaining: the least room after a prompt, of the smaller of cutoff and the model's
    positions; cropped: whether a window has fewer than all `chars` characters. Without a window: zeros and the whole room."""
    room = min(cutoff, positions or cutoff)
    total = lambda f: F.aggregate(windows, F.lit(0).cast("long"), lambda s, w: s + f(w))
    most = F.coalesce(F.array_max(F.transform(windows, lambda w: w["prompt"] + w["output"])).cast("long"), F.lit(0).cast("long"))
    least = F.coalesce(F.array_min(F.transform(windows, lambda w: F.lit(room) - w["prompt"])).cast("long"), F.lit(room).cast("long"))
    return F.struct(F.size(windows).cast("long").alias("num_windows"), total(lambda w: w["prompt"]).alias("prompt_tokens"), total(lambda w: w["output"]).alias("output_tokens"), most.alias("longest"), least.alias("remaining"), F.exists(windows, lambda w: w["chars"] < chars).alias("cropped"))
