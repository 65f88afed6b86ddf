"""The read path: nearest chunks with their documents, filtered by term and attributes, widened to families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import written
from ..functions.rules import is_current, matches
from ..functions.text import snippet
from ..operators.crawl import family
from ..operators.vector import top_k


def eligible(documents: DataFrame, current_term: str | None = None, campus: str | None = None, level: str | None = None) -> DataFrame:
    """Documents of no past term that hold for the campus and level, where these are given."""
    if current_term:
        documents = documents.filter(is_current(F.col("term"), F.lit(current_term)))
    for column, value in (("campus", campus), ("academic_level", level)):
        if value:
            documents = documents.filter(matches(F.col(column), F.lit(value)))
    return documents


def search(documents: DataFrame, chunks: DataFrame, query: list[float], k: int = 3, **filters) -> DataFrame:
    """(distance, title, source_url, snippet, doc_id, chunk_index) of the k nearest chunks, nearest first. Filters come
    before the distance; the join is by document, and a bounded heap in each task keeps the k best."""
    wanted = eligible(documents, **filters).select("doc_id", "title", "source_url")
    near = top_k(chunks.join(wanted, "doc_id").withColumn("id", F.struct("doc_id", "chunk_index")), query, k, "id")
    return near.select("distance", "title", "source_url", snippet(F.col("chunk_text")).alias("snippet"), "doc_id", "chunk_index")


def with_family(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """(hit, doc_id): the documents of each hit's family; `hits` are the few that a search returns. For all documents at
    once, `family` gives every one's top."""
    members = written(family(documents.select("doc_id", F.col("parent_doc_id").alias("parent"))), "families")
    tops = members.join(hits.select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias("hit"), "top")
    return tops.join(members, "top").select("hit", "doc_id")
