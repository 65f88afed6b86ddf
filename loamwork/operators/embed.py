"""Embeddings: a pluggable model, and a hash embedder.

The hash embedder counts a text's words by bucket, the word's SHA-256 as a number modulo the dimension, and divides by
the length of the vector; a text without words is the zero vector. A null text has no words. Words are counted in Python
where the texts are read, so no word is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EMBEDDING_DIM

#: What stands before a query for models of the family named; documents get nothing.
QUERY_PREFIXES = {"bge": "Represent this sentence for searching relevant passages: "}

_WORD = re.compile("[a-z0-9]+")
#: Rows counted at a time, numbers of dense vectors made at a time, characters of a text whose words are not listed at
#: once, and words whose buckets a task keeps.
ROWS, CELLS, LONG, KNOWN = 4096, 1 << 20, 1 << 20, 1 << 18


class Embedder(Protocol):
    """What a model has to offer; vectors have length one."""

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...


def query_text(query: str, model: str) -> str:
    return next((p for name, p in QUERY_PREFIXES.items() if name in model.lower()), "") + query


def embed_with(load: Callable[[], Embedder], dim: int = EMBEDDING_DIM):
    """A vectorised function from text to vector. `load` runs once for each Python worker task; batches go through the
    model whole; vectors of another dimension raise."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = model.embed_documents([t or "" for t in texts])
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"the model does not make vectors of {dim} numbers")
            yield pd.Series(list(vectors), dtype=object)

    return embed


def bucket(word: Column, dim: int = EMBEDDING_DIM) -> Column:
    """The word's SHA-256, read as one number, modulo `dim`. For 256 times 3: the last byte, and the digits' sum modulo 3
    (16 leaves 1), put together; otherwise Horner's rule over eight digits of 32 bits."""
    digest = F.sha2(word, 256)
    if dim == 768:
        twos = F.length(F.translate(digest, "0369cf147ad", ""))
        ones = F.length(F.translate(digest, "0369cf258be", ""))
        last = F.conv(F.substring(digest, 63, 2), 16, 10).cast("int")
        return (last + 256 * F.pmod(ones + 2 * twos - last, F.lit(3))).cast("int")
    digit = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    out = F.pmod(digit(0), F.lit(dim))
    for k in range(1, 8):
        out = F.pmod(out * F.lit(1 << 32) + digit(k), F.lit(dim).cast("long"))
    return out.cast("int")


class _Buckets(dict):
    """Words' buckets, as they are asked for; it starts anew when it holds KNOWN words."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = at = int.from_bytes(hashlib.sha256(word.encode()).digest(), "big") % self.dim
        return at


def _words(text: str) -> Iterable[str]:
    return _WORD.findall(text) if len(text) < LONG else (m[0] for m in _WORD.finditer(text))


def _numbered(keys: pa.Array) -> tuple[list[int], pa.Array]:
    """Each row's number among the different keys, and these; nested keys are not compared."""
    try:
        coded = pc.dictionary_encode(keys, null_encoding="encode")
    except pa.ArrowNotImplementedError:
        return list(range(len(keys))), keys
    return coded.indices.to_pylist(), coded.dictionary


def _counted(docs: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, counts): one row for each distinct key, an array of n * dim + bucket in which a bucket may come more than
    once. Texts are counted where they are read, rows with one key together; what is shuffled is a short array for each key
    and task's ROWS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(dim)
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows, keys = _numbered(b.column(0))
            counts = [Counter() for _ in range(len(keys))]
            for row, t in zip(rows, b.column(1).cast(pa.binary()), strict=True):
                if t.is_valid:
                    counts[row].update(map(known.__getitem__, _words(t.as_py().decode(errors="replace").lower())))
            ends = np.cumsum([0, *map(len, counts)])
            packed = np.fromiter((n * dim + at for c in counts for at, n in c.items()), np.int64, ends[-1])
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(packed))], names=[key, "counts"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("counts", T.ArrayType(T.LongType()))])
    return docs.select(key, text).mapInArrow(count, schema).groupBy(key).agg(F.flatten(F.collect_list("counts")).alias("counts"))


def _unpacked(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every entry of a batch of counts its place, row * dim + bucket, and its n."""
    packed, ends = b.column(1).flatten().to_numpy(), np.diff(b.column(1).offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), ends) * dim + packed % dim, packed // dim


def hash_embed_sparse(docs: DataFrame, key: str, text: str = "text", dim: int = EMBEDDING_DIM) -> DataFrame:
    """(key, bucket, n): a document's counts; rows with one key are one document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            places, ns = _unpacked(b, dim)
            places, back = np.unique(places, return_inverse=True)
            sums = np.zeros(len(places), dtype=np.int64)
            np.add.at(sums, back, ns)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places // dim)), pa.array((places % dim).astype(np.int32)), pa.array(sums)], names=[key, "bucket", "n"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    return _counted(docs, key, text, dim).mapInArrow(rows, schema)


def hash_vectors(docs: DataFrame, key: str, text: str = "text", dim: int = EMBEDDING_DIM) -> DataFrame:
    """(key, embedding): dense unit vectors, zero where there is no word; one row for each distinct key."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // dim)
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            places, ns = _unpacked(b, dim)
            m = np.bincount(places, ns, b.num_rows * dim).reshape(b.num_rows, dim)
            length = np.sqrt((m * m).sum(axis=1, keepdims=True))
            vectors = pa.array((m / np.where(length > 0, length, 1)).astype(np.float32).reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), vectors)], names=[key, "embedding"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return _counted(docs, key, text, dim).mapInArrow(dense, schema)


class HashEmbedder:
    """The same embedding behind the model's interface, for tests and small runs."""

    def __init__(self, dim: int = EMBEDDING_DIM):
        self.dim = dim

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            counts = Counter(int.from_bytes(hashlib.sha256(w.encode()).digest(), "big") % self.dim for w in _WORD.findall(text.lower()))
            length = sum(n * n for n in counts.values()) ** 0.5 or 1.0
            out.append([counts[i] / length for i in range(self.dim)])
        return out

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]
