"""Answers by a text generator that the user passes in.

A generator gets a block of prompts at once and is loaded once for each task. A prompt that fails is tried again, so often
as `retries` says; what fails then has no answer and an error, and the run goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between the excerpts of a prompt, each under its number.
GAP = "\n\n"


def prompt(question: Column, excerpts: Column) -> Column:
    """A question under its excerpts, numbered from 1 as answers cite them; `excerpts` is an array of strings."""
    numbered = F.transform(F.coalesce(excerpts, F.array().cast("array<string>")), lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(e, F.lit(""))))
    return F.concat(F.array_join(numbered, GAP), F.when(F.size(numbered) > 0, F.lit(GAP)).otherwise(F.lit("")), F.coalesce(question, F.lit("")))


def generate_with(load: Callable[[], Callable[[str], str]], retries: int = 1):
    """A vectorised function from prompt to (text, error)."""

    @F.pandas_udf("text string, error string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        answer = load()

        def attempt(text: str | None) -> tuple[str | None, str | None]:
            error = None
            for _ in range(retries + 1):
                try:
                    return answer(text or ""), None
                except Exception as e:  # whatever the user's generator raises
                    error = f"{type(e).__name__}: {e}"
            return None, error

        for prompts in batches:
            yield pd.DataFrame([attempt(p) for p in prompts], columns=["text", "error"])

    return generate
