"""Incremental ingestion: a stream of extracted pages, chunked and merged into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..durable import written
from ..functions.text import content_hash
from ..operators import chunk, store
from ..schemas import document_id
from ..sources.warehouse import Warehouse

PAGES = "url string, title string, markdown string, content_type string, fetched_at timestamp"


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of extracted pages as they land."""
    return spark.readStream.schema(PAGES).parquet(path)


def merge_batch(warehouse: Warehouse, batch: DataFrame, embed) -> None:
    """One batch into the store. A batch that is run again gives the same store: ids depend on URLs, chunks are replaced
    by document, and unchanged documents are not embedded again."""
    rows = store.latest(batch, "url", [F.col("fetched_at"), F.xxhash64("title", "markdown")])
    none = F.lit(None).cast("string")
    incoming = written(rows.select(
        document_id(F.col("url")).alias("doc_id"), F.col("url").alias("source_url"), "title", "content_type", F.col("markdown").alias("parsed_content"),
        content_hash(F.col("title"), F.col("markdown")).alias("content_hash"), F.lit("N/A").alias("campus"), F.lit("N/A").alias("academic_level"),
        F.lit("evergreen").alias("term"), none.alias("parent_doc_id"), F.col("fetched_at").alias("last_ingested_at"), F.lit(None).cast("timestamp").alias("last_verified_at"),
    ), "incoming")
    chunks = written(chunk.chunks(incoming, ["doc_id"], "title", "parsed_content"), "chunks")
    old_chunks = warehouse.read("document_chunks")
    after = written(store.upsert_documents(warehouse.read("source_documents"), incoming), "after")
    embedded = written(store.to_embed(after, chunks, old_chunks).withColumn("embedding", embed(F.col("chunk_text"))), "embedded")
    warehouse.write("document_chunks", store.replace_chunks(old_chunks, embedded))
    warehouse.write("source_documents", after)


def start(pages: DataFrame, warehouse: Warehouse, embed, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs the stream; `trigger` is passed on, such as availableNow=True."""
    writer = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: merge_batch(warehouse, batch, embed))
    return (writer.trigger(**trigger) if trigger else writer).start()
