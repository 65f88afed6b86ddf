"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; two texts are linked when their fingerprints differ in `radius` bits or fewer. Every bit
gets a vector of radius + 1 random binary digits, and each of the 2^(radius + 1) - 1 non-zero vectors v is a table
whose mask holds the bits whose vector has an odd product with v. The vectors of at most `radius` differing bits span
less than the whole space, so some v is orthogonal to all of them: every linked pair agrees on at least one mask
(Pagh, "Locality-sensitive hashing without false negatives"). Tables hold distinct fingerprints only.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; nulls in doc_id are
ignored when the least doc_id is sought, so a component of nulls alone has component_id null; repeated rows have one
fingerprint and one component; a text of any length is read whole; an empty table gives an empty result; extra columns
are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, fresh, table, written

BITS, SEED, SHINGLE, RADIUS = 64, 42, 3, 2
#: A bucket of up to so many distinct fingerprints is compared pair by pair; larger ones take the exact way of `_hot`.
PAIRWISE = 256


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the words' shingles: lower-case A-Z, words by ASCII white space, XXH64 with seed 42."""
    words = text.lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return hashed(b" ".join(words), SEED)
    h = np.array([hashed(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))], dtype=np.uint64)
    return of_hashes(h)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x or b"", shingle) for x in b.column(0).cast(pa.binary()).to_pylist()]
            signed = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], signed], names=[*b.schema.names[1:], "fp"])

    return run


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns `keep` and fp, the fingerprint as a signed 64-bit number."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select("text", *keep).mapInArrow(_fingerprints(shingle), f"{fields}, fp long")


def masks(radius: int = RADIUS, seed: int = 20240601) -> list[int]:
    """The tables' masks. Each vector gets its even share of the bits, in a seeded order, so no mask is short."""
    vectors = np.random.default_rng(seed).permutation(np.arange(BITS) % (1 << (radius + 1)))
    return [sum(1 << i for i, m in enumerate(vectors) if bin(int(m) & v).count("1") & 1) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs(radius: int):
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def spanning(groups: pd.Series) -> pd.Series:
        """A spanning forest of each bucket's links: as many edges as members at most."""
        out = []
        for g in groups:
            fps = np.sort(np.asarray(g, dtype=np.int64))
            left, edges = np.ones(len(fps), dtype=bool), []
            while left.any():
                queue = [int(np.flatnonzero(left)[0])]
                left[queue[0]] = False
                while queue:
                    i = queue.pop()
                    near = np.flatnonzero(left & (np.bitwise_count((fps ^ fps[i]).view(np.uint64)) <= radius))
                    left[near] = False
                    queue.extend(near.tolist())
                    edges.extend({"a": int(fps[i]), "b": int(fps[j])} for j in near)
            out.append(edges)
        return pd.Series(out)

    return spanning


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fps(fp)` that connect just what pairs within `radius` connect."""
    tables = masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in tables))).alias("t", "k"))
    sized = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(keyed.join(sized, ["t", "k"]), "buckets")
    cold = shared.filter(F.col("n") <= PAIRWISE).groupBy("t", "k").agg(F.collect_list("fp").alias("g"))
    edges = cold.select(F.explode(_pairs(radius)("g")).alias("e")).select("e.a", "e.b")
    # A large bucket: all of a table's pairs differ outside its mask only. Each member is keyed by itself without
    # every choice of `radius` of those bits; who shares a key differs in those bits alone, and all are linked to the least.
    for t, m in enumerate(tables):
        outside = [i for i in range(BITS) if not m >> i & 1]
        holes = [_signed(~sum(1 << i for i in c) & (1 << 64) - 1) for c in combinations(outside, radius)]
        hot = shared.filter((F.col("n") > PAIRWISE) & (F.col("t") == t)).select("fp")
        near = hot.select("fp", F.explode(F.array(*map(F.lit, holes))).alias("hole")).withColumn("key", F.col("fp").bitwiseAND(F.col("hole")))
        star = near.groupBy("hole", "key").agg(F.min("fp").alias("a"), F.count("*").alias("n"), F.collect_list("fp").alias("g")).filter("n > 1")
        edges = edges.union(star.select("a", F.explode("g").alias("b")))
    return edges.filter("a <> b").distinct()


def _grouped(slim: DataFrame, key: str, radius: int) -> DataFrame:
    """`slim(fp, key, ...)` with fp_root, the least fingerprint of the component, and component_id, its least key."""
    least = written(slim.groupBy("fp").agg(F.min(key).alias("least")), "distinct_fingerprints")
    roots = components(links(least.select("fp"), radius))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("fp_root"))
    ids = named.groupBy("fp_root").agg(F.min("least").alias("component_id"))
    by_fp = written(named.join(ids, "fp_root").select("fp", "fp_root", "component_id"), "fingerprint_components")
    return slim.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of `docs`: key, fp, component_id (the least key reachable)."""
    return _grouped(written(fingerprints(docs, [key], shingle), "fingerprints"), key, radius).drop("fp_root")


def keep_one(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group, with the columns of `docs`: that of the least key (null last), ties by a hash of the row's
    key and text. The texts are shuffled once, by that hash."""
    names = docs.columns
    row, nth = fresh(docs, "row_hash", "nth")
    hashed = docs.withColumn(row, F.xxhash64(F.col(key).isNull(), F.col(key), F.coalesce("text", F.lit(""))))
    groups = _grouped(written(fingerprints(hashed, [key, row], shingle), "fingerprints"), key, radius)
    kept = groups.groupBy("fp_root").agg(F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col(row).alias("row"))).alias("r")).select(F.col("r.row").alias(row)).distinct()
    w = Window.partitionBy(row).orderBy(row)  # rows alike in key and text
    return hashed.join(written(kept, "kept_rows"), row).withColumn(nth, F.row_number().over(w)).filter(F.col(nth) == 1).select(*names)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
