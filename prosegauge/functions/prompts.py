"""Prompts as Columns: what the judge is asked, and how a chain goes on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import fixed as X

#: What a condition adds to a prompt.
CONDITIONS = {"default": "", "brief": "\n\nAnswer in 50 words or less.", "short": "\n\nGive a short answer."}
_LABELS = "\n".join(f'- "{name}": {", ".join(labels)}; with "{name}_quote": the words that show it' for name, labels in X.JUDGE_LABELS.items())


def numbered(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def with_condition(prompt: Column, condition: str = "default") -> Column:
    """The prompt with the condition's instruction; ValueError if the condition is unknown."""
    if condition not in CONDITIONS:
        raise ValueError(f"unknown condition {condition!r}; known: {', '.join(CONDITIONS)}")
    return F.concat(prompt, F.lit(CONDITIONS[condition]))


def judge_prompt(audience: Column, prompt: Column, asks: Column, response: Column) -> Column:
    """The question to the judge about one answer."""
    parts = (
        F.lit("Judge an answer written for this reader: "), audience, F.lit("\n\nThe reader asked:\n"), prompt,
        F.lit("\n\nThe answer should deliver these facts:\n"), numbered(asks), F.lit("\n\nThe answer:\n"), response,
        F.lit(f'\n\nReply with one JSON object: "facts_delivered", a list with true or false for each fact in order, and these labels:\n{_LABELS}\n- "imagery_suggestion": an image that would have helped'),
    )
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def extend_prompt(prior: Column, specs: Column) -> Column:
    """What the model is asked next, given its last document (null in the first step) and all specifications so far."""
    last, before = F.element_at(specs, -1), F.slice(specs, F.lit(1), F.size(specs) - 1)
    parts = F.lit("This is the document so far:\n\n"), prior, F.lit("\n\nIt must go on to cover:\n"), numbered(before), F.lit("\n\nIt must now also meet this: "), last, F.lit("\n\nWrite the whole document anew and nothing else.")
    return F.when(prior.isNull(), last).otherwise(F.concat(*parts))


def judged_prompt(specs: Column) -> Column:
    """What the judge is told that the document answers: all specifications so far."""
    return F.when(F.size(specs) == 1, F.element_at(specs, 1)).otherwise(numbered(specs))
