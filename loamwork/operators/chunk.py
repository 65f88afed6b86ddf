"""Heading-aware chunking of Markdown that never cuts a table row.

A document is cut into blocks at blank lines. A one-line heading starts a section; the section's heading path, under
the title, stands before each of its chunks. Blocks are packed up to a budget of characters; a table that is too long is
dealt out by rows under its own head, a text that is too long by sentences. The budget is soft: a row, a sentence or a
heading path that is longer than it stays whole. Chunks that hold rows of a table carry the whole table as context.

Defined results: a null or blank text, and one of headings alone, has no chunk; a null title is empty; repeated rows
give repeated chunks; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_CHARS, LEAST_BUDGET = 1200, 200
_BLANK = re.compile(r"\n\s*\n")
_HEADING = re.compile(r"(#{1,6})\s+(.*)\Z")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
Piece = tuple[str, str | None]


class _Path:
    """The headings that are open at a place of the document."""

    def __init__(self, title: str):
        self.title, self.open = title, []

    def enter(self, level: int, text: str) -> None:
        self.open = [(n, t) for n, t in self.open if n < level] + [(level, text)]

    def label(self) -> str:
        parts: list[str] = [self.title] if self.title else []
        for _, text in self.open:
            if not parts or parts[-1].casefold() != text.casefold():
                parts.append(text)
        return " > ".join(parts)


def sections(markdown: str, title: str) -> Iterator[tuple[str, list[str]]]:
    """(heading path, blocks) of every section that has a block."""
    path, held = _Path(title), []
    for block in filter(None, map(str.strip, _BLANK.split(markdown))):
        heading = None if "\n" in block else _HEADING.match(block)
        if heading is None:
            held.append(block)
            continue
        if held:
            yield path.label(), held
            held = []
        path.enter(len(heading[1]), heading[2].strip())
    if held:
        yield path.label(), held


def _fill(parts: list[str], gap: int, room: int) -> Iterator[list[str]]:
    """Runs of parts whose lengths, with `gap` characters between, stay within `room` if more than one."""
    run, size = [], 0
    for part in parts:
        if run and size + gap + len(part) > room:
            yield run
            run, size = [], 0
        size += len(part) + (gap if run else 0)
        run.append(part)
    if run:
        yield run


def pieces(block: str, budget: int) -> list[Piece]:
    """What a block is packed as: (piece, the table it is from)."""
    lines = block.splitlines()
    is_table = len(lines) > 1 and all(x[0:1] == "|" for x in lines)
    if len(block) <= budget:
        return [(block, block if is_table else None)]
    if not is_table:
        return [(" ".join(run), None) for run in _fill(_SENTENCE_END.split(block), 1, budget)]
    head = "\n".join(lines[:2])
    if not lines[2:]:
        return [(head, block)]
    return [("\n".join([head, *run]), block) for run in _fill(lines[2:], 1, budget - len(head) - 1)]


def chunk_markdown(markdown: str | None, title: str | None, max_chars: int = MAX_CHARS) -> Iterator[tuple[str, str | None]]:
    """(text, context) of each chunk, in order."""
    for label, blocks in sections(markdown or "", title or ""):
        budget = max(max_chars - len(label) - 2, LEAST_BUDGET)
        packed = [p for b in blocks for p in pieces(b, budget)]
        at = 0
        for run in _fill([p for p, _ in packed], 2, budget):
            tables = dict.fromkeys(t for _, t in packed[at : at + len(run)] if t)
            at += len(run)
            yield "\n\n".join([label, "\n\n".join(run)]), "\n\n".join([label, *tables]) if tables else None


def chunks(docs: DataFrame, keep: list[str], title: str = "title", markdown: str = "markdown", max_chars: int = MAX_CHARS) -> DataFrame:
    """The columns `keep`, chunk_index, chunk_text, context_text: a row for each chunk. Nothing is shuffled."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                rows = [(i, k, *c) for i, (t, m) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)) for k, c in enumerate(chunk_markdown(m, t, max_chars))]
                at, index, text, context = zip(*rows, strict=True) if rows else ((), (), (), ())
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in part.columns[2:]), pa.array(index, pa.int32()), pa.array(text, pa.string()), pa.array(context, pa.string())],
                    names=[*keep, "chunk_index", "chunk_text", "context_text"],
                )

    return docs.select(title, markdown, *keep).mapInArrow(run, f"{fields}, chunk_index int, chunk_text string, context_text string")
