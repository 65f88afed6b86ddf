"""The batch run: fetch results to documents, chunks and vectors in the store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import written
from ..operators import chunk, crawl, store
from ..sources.config import as_table
from ..sources.warehouse import Warehouse


@dataclass
class Run:
    """What a run did: a row for each document, and totals in one row."""

    summary: DataFrame
    totals: DataFrame


def ingest(
    spark: SparkSession, warehouse: Warehouse | None, seeds: list[dict], fetched: DataFrame, embed, as_of: Column,
    pdfs: DataFrame | None = None, force: bool = False, robots: bool = True, max_chars: int = chunk.MAX_CHARS,
) -> Run:
    """Crawls `fetched` from the seeds, chunks what is found, and writes documents and chunks to the warehouse; only
    chunks of new or changed documents meet `embed`, a function of a text column. Without a warehouse nothing is stored
    (a dry run)."""
    rules = written(crawl.robots_rules(fetched), "robots") if robots else False
    found = written(crawl.crawl(spark, seeds, fetched, lambda reached: crawl.pages_of(reached, pdfs, rules)), "found")
    made = store.incoming_documents(found, as_table(spark, seeds, "seeds"), as_of)
    incoming = written(made, "incoming")
    chunks = written(chunk.chunks(incoming, ["doc_id"], "title", "parsed_content", max_chars), "chunks")
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    if warehouse is None:
        status, n_embedded = incoming.select("doc_id", F.lit("parsed").alias("status")), F.lit(0).cast("long")
    else:
        old_documents, old_chunks = warehouse.read("source_documents"), warehouse.read("document_chunks")
        after = written(store.upsert_documents(old_documents, incoming), "after")
        stale = store.to_embed(after, chunks, old_chunks, force)
        embedded = written(stale.withColumn("embedding", embed(F.col("chunk_text"))), "embedded")
        new_chunks = written(store.replace_chunks(old_chunks, embedded), "new_chunks")
        warehouse.write("document_chunks", new_chunks)  # before the hashes that say that they are there
        warehouse.write("source_documents", after)
        stored = embedded.select("doc_id").distinct().withColumn("stored", F.lit(True))
        status = incoming.select("doc_id").join(stored, "doc_id", "left").select("doc_id", F.when(F.col("stored"), "stored").otherwise("unchanged").alias("status"))
        n_embedded = F.lit(embedded.count()).cast("long")
    summary = incoming.join(counts, "doc_id", "left").join(status, "doc_id").select("place", "seed", "depth", "content_type", "title", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "status").orderBy("place")
    totals = summary.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks")).withColumn("embedded", n_embedded)
    return Run(summary, totals)
