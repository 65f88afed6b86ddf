"""Helpers shared by the training-data operators: table access, durable intermediate tables, graph components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import passing, shared_path, written  # noqa: F401 - the operators take them from here

#: Space, tab, line feed, vertical tab, form feed, carriage return: the only characters that end a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of `df`'s, compared without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def runs(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Where runs of about `limit` bytes of text begin and how many texts they have, one at least."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")) - at)
        yield at, n
        at += n


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of `edges(a, b)`: one row (node, root) for each node that has an edge, root the least
    node reachable. Alternates large-star and small-star steps (Kiveris et al., "Connected components in MapReduce
    and beyond"), each a minimum per node with map-side combination and a join, until the edges no longer change.
    Every node keeps at most one edge per neighbour; nothing is collected but a count and a checksum."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a")
        if large:
            return out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = written(edges.filter("a <> b").select("a", "b").distinct(), name)
    seen = state(now)
    while seen[0]:
        step = stars(stars(now, True), False).filter("a <> b").distinct()
        now = written(step, name)
        then = state(now)
        if then == seen:
            break
        seen = then
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
