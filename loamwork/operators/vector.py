"""Exact nearest neighbours by cosine distance.

One query is an expression and a top-k sort, which Spark plans as a bounded heap in each task. Many queries go in
blocks: each task multiplies its batches with a block of query vectors and passes on its k best for each query, so what
is shuffled is queries x tasks x k rows, whatever the table's size. A block has BLOCK_BYTES of vectors at most, and the
table is read once for each. Keys may be of any type that has an order. `index` and `search_index` look at the nearest
parts of a table alone.

Defined results: a null or zero vector has no distance and comes last (single query) or is left out (many); ties go by
id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.rules import cosine_distance

#: Bytes of query vectors that travel with a function, and distances that are worked out at once.
BLOCK_BYTES, CELLS = 32 << 20, 2_000_000


def top_k(items: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to the query, with `distance`, nearest first."""
    point = F.array(*(F.lit(float(x)) for x in query))
    return items.withColumn("distance", cosine_distance(F.col(vector), point)).orderBy(F.asc_nulls_last("distance"), key).limit(k)


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are vectors of some length, and these divided by it."""
    at = [i for i, v in enumerate(rows) if v is not None and all(x is not None for x in v)]
    if not at:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    m = np.array([rows[i] for i in at], dtype=np.float64)
    length = np.sqrt((m * m).sum(axis=1))
    some = length > 0
    return np.array(at, dtype=np.int64)[some], m[some] / length[some, None]


def _kept(distance: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k least of each row of `distance` (queries x candidates), ties by `place`."""
    if distance.shape[1] <= k:
        return np.broadcast_to(np.arange(distance.shape[1]), distance.shape)
    bound = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
    # all below the bound, and of those that equal it the first by place
    rank = np.where(distance < bound, -1, np.where(distance == bound, place, np.iinfo(np.int64).max))
    return np.argpartition(rank, k - 1, axis=1)[:, :k]


def top_k_each(items: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", least: float | None = None, probe: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(query_key, key, distance, rank): for each row of `queries(query_key, vector)` its k nearest rows of `items`, all
    items compared with all queries block by block. `least`: a distance below which nothing is returned, for queries
    that are rows of the table themselves leave it out. `probe`: centres and a number; a query then looks at the items whose
    `part` is one of that many nearest centres."""
    dim = queries.select(F.max(F.size(vector))).first()[0] or 0
    n = queries.count()
    blocks = max(1, -(-n * max(dim, 1) * 8 // BLOCK_BYTES))
    dealt = queries.select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    kinds = items.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    schema = to_arrow_schema(StructType([StructField("q", queries.schema[query_key].dataType), StructField("i", items.schema[key].dataType), StructField("distance", DoubleType())]))
    found = None
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).orderBy("q").collect()  # one block
        at, unit = _unit([r["v"] for r in rows])
        names = [rows[i]["q"] for i in at]
        looks = None  # queries x parts
        if probe is not None:
            looks = np.zeros((len(names), len(probe[0])), dtype=bool)
            if len(names) and len(probe[0]):
                take = min(probe[1], len(probe[0]))
                np.put_along_axis(looks, np.argpartition(-(unit @ probe[0].T), take - 1, axis=1)[:, :take], True, axis=1)

        def nearest(batches: Iterator[pa.RecordBatch], unit=unit, names=names, looks=looks) -> Iterator[pa.RecordBatch]:
            best, ids = np.zeros((len(names), 0)), pa.nulls(0, schema.field("i").type)
            held = np.zeros((len(names), 0), dtype=np.int64)  # where in `ids` each candidate is
            step = max(64, CELLS // max(1, len(names)))
            for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
                mine, m = _unit(b.column(1).to_pylist())
                if not len(mine) or not names:
                    continue
                if looks is None:
                    distance = 1.0 - unit @ m.T
                else:
                    distance, parts = np.full((len(names), len(mine)), np.inf), b.column(2).to_numpy()[mine]
                    for part in np.unique(parts).tolist():
                        q, at = np.flatnonzero(looks[:, part]), np.flatnonzero(parts == part)
                        distance[np.ix_(q, at)] = 1.0 - unit[q] @ m[at].T
                distance = np.round(distance, 12)  # equal vectors are equally far, however they were multiplied
                if least is not None:
                    distance[distance < least] = np.inf
                ids = pa.concat_arrays([ids, b.column(0).take(pa.array(mine)).cast(ids.type)])
                held = np.concatenate([held, np.broadcast_to(np.arange(len(ids) - len(mine), len(ids)), distance.shape)], axis=1)
                best = np.concatenate([best, distance], axis=1)
                place = pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64)
                at = _kept(best, place[held], k)
                best, held = np.take_along_axis(best, at, axis=1), np.take_along_axis(held, at, axis=1)
                used, held = np.unique(held, return_inverse=True)
                ids, held = ids.take(pa.array(used)), held.reshape(best.shape)
            real = np.isfinite(best)
            q = np.repeat(np.arange(len(names)), real.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()], schema.field("q").type), ids.take(pa.array(held[real])), pa.array(best[real])], schema=schema)

        part = items.select(key, vector, *(["part"] if probe is not None else [])).mapInArrow(nearest, f"q {kinds[1]}, i {kinds[0]}, distance double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("q").orderBy("distance", "i")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("i").alias(key), "distance", "rank")


def wrong_dimensions(items: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    return items.filter(F.coalesce(F.size(vector), F.lit(-1)) != dim)


def search_text(sparse: DataFrame, query: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k documents nearest to a text, both as sparse counts `(key, bucket, n)` and `(bucket, n)`. The query has a row
    for each bucket at most, so it is broadcast; lengths and products come from one pass over the counts. Documents that
    share no word with the query are left out."""
    q = query.groupBy("bucket").agg(F.sum("n").alias("qn"))
    length = query.agg(F.sqrt(F.sum(F.col("n") * F.col("n")))).first()[0] or 0.0
    both = sparse.join(F.broadcast(q), "bucket", "left").groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.sum(F.col("n") * F.col("qn")).alias("dot"))
    distance = 1 - F.try_divide(F.col("dot"), F.col("norm") * F.lit(length))
    return both.filter("dot is not null").select(key, distance.alias("distance")).orderBy("distance", key).limit(k)


def index(items: DataFrame, parts: int, key: str = "vec_id", vector: str = "embedding", sample: int = 20_000, steps: int = 8, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """An approximate index in place of exact search: (items with their unit vector and `part`, the parts' centres).
    Centres come from spherical k-means over `sample` vectors, those of the least hash of their keys; every row of the
    table with a vector of some length goes to the part of the nearest centre. Write the table partitioned by `part`, and
    a search reads no other parts."""
    chosen = items.filter(F.col(vector).isNotNull()).select(key, vector).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).collect()
    _, unit = _unit([list(map(float, r[vector])) for r in chosen])
    rng = np.random.default_rng(seed)
    centres = unit[np.sort(rng.choice(len(unit), min(parts, len(unit)), replace=False))] if len(unit) else np.zeros((0, 0))
    for _ in range(steps if len(unit) else 0):
        to = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, to, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine, m = _unit(b.column(1).to_pylist())
            part = (m @ centres.T).argmax(axis=1) if len(mine) and len(centres) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(mine)), pa.array(list(m) if len(mine) else [], pa.list_(pa.float64())), pa.array(part, pa.int32())], names=[key, vector, "part"])

    return items.select(key, vector).mapInArrow(place, f"`{key}` {items.schema[key].dataType.simpleString()}, `{vector}` array<double>, part int"), centres


def search_index(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query_key, key, distance, rank): the k nearest rows of each query among the `probes` parts nearest to it, each row
    compared with the queries that look at its part and with no others."""
    return top_k_each(indexed, queries, k, key, vector, query_key, probe=(centres, probes))
