"""Text scalars: cleaning, Markdown blocks and tables, sentences, hashes, tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every kind, the information separators too.
SPACE = r"(?U)[\s\x1C-\x1F]"
_EDGES = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z"


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, _EDGES, "")


def clean_text(text: Column) -> Column:
    """Every run of white space, no-break spaces too, as one space; none at the ends; null as empty."""
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def tidy(markdown: Column) -> Column:
    """At most one blank line in a row, and one line end at the end, or nothing at all."""
    body = stripped(F.regexp_replace(markdown, r"\n{3,}", "\n\n"))
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def blocks(markdown: Column) -> Column:
    """The non-empty blocks between blank lines."""
    return F.filter(F.transform(F.split(markdown, r"(?U)\n[\s\x1C-\x1F]*\n"), stripped), lambda b: b != "")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])[\s\x1C-\x1F]+")


def snippet(text: Column, length: int = 220) -> Column:
    """The cleaned text's first characters; 60, 70 and 120 serve for titles."""
    return F.substring(clean_text(text), 1, length)


def content_hash(title: Column, markdown: Column) -> Column:
    """SHA-256 of title, line end, Markdown; what tells whether a document has changed."""
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(markdown, F.lit(""))), 256)


def markdown_table(header: Column, rows: Column) -> Column:
    """A Markdown table from an array of cells and an array of such arrays: cells cleaned, pipes escaped, rows padded
    to the widest; empty if there is no column."""
    cell = lambda c: F.replace(clean_text(c), F.lit("|"), F.lit("\\|"))
    width = F.greatest(F.size(header), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(width == 0, "").otherwise(F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n"))


def joined_lines(lines: Column) -> Column:
    """Wrapped lines as one text; a hyphen at a line's end goes where the next line begins in lower case."""
    add = lambda s, x: F.when(s.endswith("-") & x.rlike(r"^\p{Ll}"), F.concat(F.substring(s, F.lit(1), F.length(s) - 1), x)).otherwise(F.concat(s, F.lit(" "), x))
    return F.when(F.size(lines) > 0, F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.element_at(lines, 1), add)).otherwise("")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def options(text: Column) -> Column:
    """A comma-separated list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ","), stripped), lambda x: x != "")


def camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(t.capitalize() for t in tail)


def api_json(names: Iterable[str]) -> Column:
    """The named columns as a JSON record whose keys are in camel case; nulls are written."""
    return F.to_json(F.struct(*(F.col(n).alias(camel(n)) for n in names)), {"ignoreNullFields": "false"})


# --- the same rules for Python code that walks trees -------------------------------------------------------------------


def py_clean(text: str | None) -> str:
    return " ".join((text or "").split())


def py_tidy(markdown: str) -> str:
    body = re.sub(r"\n{3,}", "\n\n", markdown).strip()
    return f"{body}\n" if body else ""


def py_table(header: list[str], rows: list[list[str]]) -> str:
    width = max(map(len, [header, *rows]))
    if not width:
        return ""
    padded = [[py_clean(c).replace("|", r"\|") for c in r] + [""] * (width - len(r)) for r in [header, *rows]]
    padded.insert(1, ["---"] * width)
    return "\n".join(f"| {' | '.join(r)} |" for r in padded)
