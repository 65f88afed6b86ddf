"""De-identified transcripts and their retention. Patterns are those of `functions.privacy`; recognising names takes a
model, which can be passed in as an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import pii_remaining, redacted
from ..schemas import RETENTION_DAYS


def retained(transcripts: DataFrame, salt: str, names: Callable[[Column], Column] = lambda c: c, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """`transcripts(conversation_id, text, created_at)` to the rows to keep and those to review: a reference that cannot
    be turned back without the salt, the masked text, and the day it goes. Days over 90 raise."""
    if not 1 <= days <= RETENTION_DAYS:
        raise ValueError(f"days must be 1 to {RETENTION_DAYS}")
    ref = F.sha2(F.concat(F.lit(salt), F.lit(":"), F.col("conversation_id").cast("string")), 256)
    a = transcripts.select(ref.alias("conversation_ref"), redacted(names(F.coalesce("text", F.lit("")))).alias("masked"), "created_at", (F.col("created_at") + F.expr(f"INTERVAL '{days}' DAY")).alias("purge_after"))
    left = pii_remaining(F.col("masked"))
    keep = a.filter(~left).select("conversation_ref", F.col("masked").alias("deidentified_text"), "created_at", "purge_after")
    review = a.filter(left).select("conversation_ref", F.col("masked").alias("held_text"), F.lit("pii_remaining").alias("reason"), "created_at", "purge_after")
    return keep, review


def purged(rows: DataFrame, as_of: Column, column: str = "purge_after") -> DataFrame:
    """What is left after a purge at `as_of`; rows without a day to go stay."""
    return rows.filter(F.col(column).isNull() | (F.col(column) > as_of))


def recent(conversations: DataFrame, as_of: Column, days: int, column: str = "started_at") -> DataFrame:
    """Raw conversations not older than `days`."""
    return conversations.filter(F.col(column) >= as_of - F.expr(f"INTERVAL '{days}' DAY"))
