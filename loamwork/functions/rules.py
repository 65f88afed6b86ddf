"""Retrieval and record rules: terms, attribute filters, vectors, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEASONS = ["Winter", "Spring", "Summer", "Fall"]
TERM = r"^(Winter|Spring|Summer|Fall) ([0-9]{4})$"


def parse_term(term: Column) -> Column:
    """struct(year, season) of `Season YYYY`, which sorts in time order; null for anything else."""
    t = F.trim(term)
    return F.when(t.rlike(TERM), F.struct(F.regexp_extract(t, TERM, 2).try_cast("int").alias("year"), (F.array_position(F.array(*map(F.lit, SEASONS)), F.regexp_extract(t, TERM, 1)) - 1).cast("int").alias("season")))


def is_valid_term(term: Column) -> Column:
    return (term == "evergreen") | term.rlike(TERM)


def is_current(term: Column, current: Column) -> Column:
    """Evergreen, or not before the current term."""
    return (term == "evergreen") | (parse_term(term) >= parse_term(current))


def matches(attribute: Column, wanted: Column) -> Column:
    """Equal, or one of the values that hold for all."""
    return (attribute == wanted) | attribute.isin("Both", "N/A")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def answer_violations(answers: DataFrame) -> DataFrame:
    """`answers(citations, escalated, department, ...)`: those that break the rule that an answer either cites or is
    escalated to a department, never both, never neither, and no escalation without a department. Nulls count as no
    citation and not escalated."""
    cited, escalated = F.coalesce(F.size("citations"), F.lit(0)) > 0, F.coalesce("escalated", F.lit(False))
    sent = escalated & F.col("department").isNotNull()
    kind = F.when(escalated & F.col("department").isNull(), "escalated_without_department").when(cited & sent, "both").when(~cited & ~sent, "neither")
    return answers.withColumn("violation", kind).filter("violation is not null")
