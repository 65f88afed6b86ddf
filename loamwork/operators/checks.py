"""The store's declared invariants as queries for the rows that break them; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import answer_violations, is_valid_term
from ..schemas import (
    CONTACT_CAMPUSES, CONTENT_TYPES, DOCUMENT_CAMPUSES, DOCUMENT_LEVELS, EMBEDDING_DIM, RETENTION_DAYS, ROLES, STATUSES,
)

UNIQUE = {"source_documents": ["source_url"], "department_contacts": ["name"], "document_chunks": ["doc_id", "chunk_index"], "answers": ["message_id"], "retained_transcripts": ["conversation_ref"]}
ENUMS = {
    "source_documents": {"campus": DOCUMENT_CAMPUSES, "academic_level": DOCUMENT_LEVELS, "content_type": CONTENT_TYPES},
    "department_contacts": {"campus": [*CONTACT_CAMPUSES, None]}, "conversations": {"status": STATUSES}, "messages": {"role": ROLES},
}
#: (child, column, parent, column, what a delete does to the child)
REFERENCES = [
    ("document_chunks", "doc_id", "source_documents", "doc_id", "cascade"), ("source_documents", "parent_doc_id", "source_documents", "doc_id", "set null"),
    ("messages", "conversation_id", "conversations", "conversation_id", "cascade"), ("answers", "message_id", "messages", "message_id", "cascade"),
    ("messages", "answer_id", "answers", "answer_id", "set null"), ("answers", "department", "department_contacts", "name", "none"),
]


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def wrong_values(rows: DataFrame, enums: dict[str, list]) -> DataFrame:
    """Rows with a value outside its enumeration; null only where it is listed."""
    bad: Column = F.lit(False)
    for c, values in enums.items():
        named = F.col(c).isin([v for v in values if v is not None])
        bad = bad | ~F.coalesce(named, F.lit(None in values))
    return rows.filter(bad)


def wrong_terms(documents: DataFrame) -> DataFrame:
    return documents.filter(~F.coalesce(is_valid_term(F.col("term")), F.lit(False)))


def kept_too_long(rows: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    return rows.filter(F.col("purge_after") > F.col("created_at") + F.expr(f"INTERVAL '{days}' DAY"))


def not_an_array(answers: DataFrame, column: str = "citations_json") -> DataFrame:
    """Rows whose JSON text is not an array."""
    return answers.filter(~F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("ARRAY"), F.lit(False)))


def wrong_vectors(chunks: DataFrame, dim: int = EMBEDDING_DIM) -> DataFrame:
    return chunks.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dim)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows that refer to nothing."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("p_key")), F.col(column) == F.col("p_key"), "left_anti")


def after_delete(child: DataFrame, column: str, parent: DataFrame, key: str, action: str) -> DataFrame:
    """The child table once what it refers to is gone from `parent`."""
    there = parent.select(F.col(key).alias("p_key")).distinct()
    if action == "cascade":
        return child.join(there, F.col(column) == F.col("p_key"), "left_semi")
    if action == "set null":
        return child.join(there, F.col(column) == F.col("p_key"), "left").select(*(F.col("p_key").alias(column) if c == column else F.col(c) for c in child.columns))
    return child


def unequal_counts(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents with another number of vectors than of chunks."""
    a, b = (x.groupBy("doc_id").agg(F.count("*").alias(n)) for x, n in ((chunks, "n_chunks"), (vectors, "n_vectors")))
    return a.join(b, "doc_id", "full_outer").filter(~F.col("n_chunks").eqNullSafe(F.col("n_vectors")))


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): how many rows break each rule, for the tables given; rules of tables that are not there are left out."""
    found: list[tuple[str, DataFrame]] = []
    for t, key in UNIQUE.items():
        found += [(f"unique {t}", duplicates(tables[t], key))] if t in tables else []
    for t, enums in ENUMS.items():
        found += [(f"values {t}", wrong_values(tables[t], enums))] if t in tables else []
    for t, c, p, k, _ in REFERENCES:
        found += [(f"reference {t}.{c}", orphans(tables[t], c, tables[p], k))] if t in tables and p in tables else []
    for t, rule, f in (("source_documents", "term", wrong_terms), ("document_chunks", "dimension", wrong_vectors), ("answers", "cited or escalated", answer_violations), ("retained_transcripts", "retention", kept_too_long), ("transcript_review_queue", "retention", kept_too_long)):
        found += [(f"{rule} {t}", f(tables[t]))] if t in tables else []
    out = None
    for rule, rows in found:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out
