"""The corpus store: upserts by key, replacement of chunks, inventory.

Every function takes tables and returns tables, so a run writes new versions beside the old ones and swaps them. Nothing
is ever deleted because it vanished at its source.

Defined results: of rows with one key in a run the last (by `place`, then by hash) wins; rows with a null key are left
out; empty inputs give the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..schemas import document_id

OVERWRITTEN = ["title", "content_type", "parsed_content", "content_hash", "campus", "academic_level", "term", "parent_doc_id", "last_ingested_at"]


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the last in order: an aggregate of structs, so that most of it happens before the shuffle."""
    names = [c for c in rows.columns if c != key]
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in names))


def _last(rows: DataFrame) -> list[Column]:
    """What orders rows with one key: `place` where there is one, then a hash."""
    return [*([F.col("place")] if "place" in rows.columns else []), F.xxhash64(*(F.col(c) for c in rows.columns))]


def incoming_documents(found: DataFrame, seeds: DataFrame, as_of: Column) -> DataFrame:
    """Crawled documents as rows to store: attributes are those of the seed, the parent is the document of the same
    seed whose URL is the parent's."""
    parents = found.select(F.col("seed").alias("p_seed"), F.col("url").alias("p_url")).distinct()
    a = found.join(parents, (F.col("seed") == F.col("p_seed")) & (F.col("parent_url") == F.col("p_url")), "left").join(seeds.select(F.col("name").alias("seed"), "campus", "academic_level", "term"), "seed")
    return latest(a, "url", [F.col("place")]).select(
        document_id(F.col("url")).alias("doc_id"), F.col("url").alias("source_url"), "title", "content_type", F.col("markdown").alias("parsed_content"),
        content_hash(F.col("title"), F.col("markdown")).alias("content_hash"), "campus", "academic_level", "term",
        F.when(F.col("p_url").isNotNull(), document_id(F.col("p_url"))).alias("parent_doc_id"), as_of.cast("timestamp").alias("last_ingested_at"),
        F.lit(None).cast("timestamp").alias("last_verified_at"), "place", "seed", "depth",
    )


def upsert_documents(existing: DataFrame, incoming: DataFrame, key: str = "source_url", overwritten: list[str] | None = None) -> DataFrame:
    """The store after the run, with `status`: new, changed (another content hash), touched (only attributes may
    differ), or kept (not in the run). What is not overwritten, ids among it, stays as it was."""
    fields = OVERWRITTEN if overwritten is None else overwritten
    names = existing.columns
    old, new = existing.alias("old"), latest(incoming, key, _last(incoming)).alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    is_in, was_in = F.col(f"new.{key}").isNotNull(), F.col(f"old.{key}").isNotNull()
    value = lambda c: F.when(is_in, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in fields else F.when(was_in, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    status = F.when(~is_in, "kept").when(~was_in, "new").when(~F.col("old.content_hash").eqNullSafe(F.col("new.content_hash")), "changed").otherwise("touched")
    return both.select(*(value(c).alias(c) for c in names), status.alias("status"))


def upsert_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All columns of rows with a known key overwritten, new keys added."""
    rows = latest(incoming, key, _last(incoming))
    return existing.join(rows.select(key), key, "left_anti").select(existing.columns).unionByName(rows.select(existing.columns))


def to_embed(status: DataFrame, new_chunks: DataFrame, old_chunks: DataFrame, force: bool = False) -> DataFrame:
    """The chunks of documents that are new or changed, or of which another number of chunks is stored; only these meet
    the model."""
    counts = old_chunks.groupBy("doc_id").agg(F.count("*").alias("stored"))
    made = new_chunks.groupBy("doc_id").agg(F.count("*").alias("made"))
    a = status.select("doc_id", "status").join(made, "doc_id", "left").join(counts, "doc_id", "left")
    stale = F.lit(force) | F.col("status").isin("new", "changed") | (F.coalesce("stored", F.lit(0)) != F.coalesce("made", F.lit(0)))
    return new_chunks.join(a.filter((F.col("status") != "kept") & stale).select("doc_id"), "doc_id", "left_semi")


def replace_chunks(old_chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """The chunk table with the documents of `embedded` replaced."""
    return old_chunks.join(embedded.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(embedded.select(old_chunks.columns))


def inventory(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each document with its chunks counted, in order of ingestion. Chunks are counted before the join."""
    per = chunks.groupBy("doc_id").agg(F.count("chunk_index").alias("n_chunks"), F.max(F.size("embedding")).alias("dims"))
    a = documents.join(per, "doc_id", "left")
    return a.select("title", "content_type", "source_url", "campus", "term", F.col("parent_doc_id").isNotNull().alias("is_child"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "dims", "last_ingested_at").orderBy("last_ingested_at", "source_url")


def totals(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(documents, chunks): two counts in one row."""
    return documents.agg(F.count("*").alias("documents")).crossJoin(chunks.agg(F.count("*").alias("chunks")))


def resolve_conflicts(values: DataFrame) -> DataFrame:
    """`values(topic, value, last_verified_at, is_current, doc_id)` to (topic, value, conflict): the value of the most
    recently verified current source, and whether current sources still disagree at that time. Of several sources the one
    with the least doc_id holds, of several values of one doc_id the least; nulls of either are no value."""
    w = Window.partitionBy("topic").orderBy(F.desc_nulls_last("last_verified_at"))
    top = values.filter("is_current").withColumn("nth", F.rank().over(w)).filter("nth = 1")
    return top.groupBy("topic").agg(F.min_by("value", F.when(F.col("doc_id").isNotNull() & F.col("value").isNotNull(), F.struct("doc_id", "value"))).alias("value"), (F.count_distinct("value") > 1).alias("conflict"))
