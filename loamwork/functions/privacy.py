"""Masking of personal data by patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and what stands in their place, in order.
MASKS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"(\+?[0-9]{1,2}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "[PHONE]"),
    (r"\b[0-9]{7,9}\b", "[ID]"),
]
REMAINING = r"@[A-Za-z0-9-]+\.|[0-9]{7,}"


def redacted(text: Column, names: Column | None = None) -> Column:
    """The text with what the patterns find masked. `names`: an array of the names in it, as a recogniser of the user's
    finds them; each stands for itself, wherever it is a word of its own, the longest first."""
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, pattern, mask)
    if names is None:
        return text
    quoted = F.transform(F.array_compact(F.coalesce(names, F.array().cast("array<string>"))), lambda n: F.regexp_replace(n, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    known = F.array_sort(F.filter(quoted, lambda n: F.length(n) > 0), lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(known) > 0, F.regexp_replace(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(known, "|"), F.lit(r")(?![\p{L}\p{N}])")), F.lit("[NAME]"))).otherwise(text)


def pii_remaining(text: Column) -> Column:
    return F.coalesce(text.rlike(REMAINING), F.lit(False))
