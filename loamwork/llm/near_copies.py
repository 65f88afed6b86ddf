"""Near-duplicates by SimHash, verified by the Jaccard likeness of word shingles and completed by prefix filtering.

Two texts are linked when the sets of their five-word shingles have a likeness of 4/5 or more. SimHash comes first: sets
have 64-bit fingerprints, covering locality-sensitive hashing (`simhash.links`) finds those that differ in two bits or
fewer, and the sets that are linked so are compared in full. Sets of a likeness of 4/5 may have fingerprints ten bits
apart, which no affordable number of tables finds for sure, so what SimHash leaves apart is searched in an exact way, by
prefix filtering: pairs that are already in one component are not looked at again. All shingles have one
order, rarer ones first; linked sets share at least 4/5 of the larger one, so each of them has a shared shingle among its
first floor(n / 5) + 1 ("prefix filtering", Chaudhuri et al.; Vernica et al., "Efficient parallel set-similarity joins
using MapReduce"). Sets that share such a shingle are candidates; sizes and the parity bits of the sets (no two sets
differ in fewer shingles than their bits do, Sandes et al., "Bitmap filter") leave out only pairs that cannot be linked,
and the rest are compared in full. The order uses counts of shingles by BUCKETS hash buckets: it bears on speed only.

A group of candidates is first compared with its least member; after that, round by round, each member outside the
group's largest component with the closest by parities that is of another component and that the group has not given
before, in each round with MORE times as many, until a group has no such pairs. So a group of near copies takes about as
many comparisons as it has members, and one of m members is through after log m rounds. Texts are not shuffled for comparisons;
a set is shuffled once for each set that it is compared with, and one that is compared with many is so in several tasks.

Defined results: words are lower-case A-Z, split by ASCII white space; a text of fewer than five words is one shingle; a
null or wordless text is one like any other. Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import components, fresh, written

SHINGLE, SEED = 5, 42
#: The likeness as a fraction: PART of WHOLE.
PART, WHOLE = 4, 5
#: Counters of shingles, parity bits of a set (long sets have more), and comparisons of one set that a task makes.
BUCKETS, PARITY, TOGETHER = 1 << 18, 1024, 1000
#: Bits of the filter that tells which rows are compared; with more rows it lets others through, which a join takes out.
FILTER = 1 << 21
#: By how much the comparisons of a member grow from round to round.
MORE = 32
#: Rows that Python hands back at once.
ROWS = 256


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    words = text.lower().split()
    n = max(1, len(words) - size + 1)
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(b" ".join(words[i : i + size]), SEED) for i in range(n)), dtype=np.uint64, count=n)).view(np.int64)


def _id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches, and the shingles of their first column's texts."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part, [shingles(x or b"", size) for x in part.column(0).cast(pa.binary()).to_pylist()]


def _parities(s: np.ndarray) -> bytes:
    """The parity bits of a set: a power of two of them, no fewer than it has shingles, so that those of long sets tell."""
    size = max(PARITY, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount(s & (size - 1), minlength=size) & 1).astype(np.uint8)).tobytes()


class _Parities:
    """The parity bits of a group's sets, compared at the shorter's length. Sets of which one may be linked with the other
    have as many bits, or twice as many; halves laid on each other are the parities of half the length."""

    def __init__(self, bits: list[bytes]):
        self.size, self.by = np.array([len(b) for b in bits]), {}
        for size in np.unique(self.size).tolist():
            has = np.flatnonzero((self.size == size) | (self.size == 2 * size))
            place = np.full(len(bits), -1)
            place[has] = np.arange(len(has))
            read = (np.frombuffer(bits[j], dtype=np.uint64) for j in has)
            self.by[size] = place, np.stack([x if 8 * len(x) == size else x[: len(x) // 2] ^ x[len(x) // 2 :] for x in read])

    def apart(self, i: int, at: np.ndarray) -> np.ndarray:
        """In how many bits set i differs from each set of `at`."""
        out, least = np.zeros(len(at), dtype=np.int64), np.minimum(self.size[at], self.size[i])
        for size in np.unique(least).tolist():
            place, rows = self.by[size]
            some = least == size
            out[some] = np.bitwise_count(rows[place[at[some]]] ^ rows[place[i]]).sum(axis=1, dtype=np.int64)
        return out


def _columns(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)


def slim(docs: DataFrame, keep: list[str], size: int) -> DataFrame:
    """The columns `keep`, set_id, n (shingles), bits (their parities) and fp (SimHash, signed) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, size):
            bits = [_parities(s) for s in sets]
            more = [pa.array([_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, pa.binary())]
            fps = np.array([simhash.of_hashes(s.view(np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *more, pa.array(fps)], names=[*part.schema.names[1:], "set_id", "n", "bits", "fp"])

    return docs.select("text", *keep).mapInArrow(run, f"{_columns(docs, keep)}, set_id long, n long, bits binary, fp long")


def commonness(docs: DataFrame, size: int) -> np.ndarray:
    """A class of how common the shingles of each hash bucket are: BUCKETS bytes, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for _, sets in _sets(batches, size):
            counts += np.bincount(np.concatenate(sets) & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["at", "n"])

    total = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.uint8)
    out[total["at"].to_numpy()] = np.minimum(255, 1 + 6 * np.log2(total["n"].to_numpy())).astype(np.uint8)
    return out


def prefixes(docs: DataFrame, size: int) -> DataFrame:
    """(token, set_id): the first shingles of each set, rarer ones first."""
    common = commonness(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, size):
            firsts = [s[np.lexsort((s, common[s & (BUCKETS - 1)]))[: len(s) * (WHOLE - PART) // WHOLE + 1]] for s in sets]
            ids = np.repeat(np.array([_id(s) for s in sets], dtype=np.int64), [len(f) for f in firsts])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts), pa.int64()), pa.array(ids, pa.int64())], names=["token", "set_id"])

    return docs.select("text").mapInArrow(run, "token long, set_id long")


def _pairs(times: int):
    @F.pandas_udf("array<struct<a:long,b:long,more:boolean>>")
    def likely(ids: pd.Series, ns: pd.Series, bits: pd.Series, roots: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        """Of the pairs of each group that can be linked, are of two components and were not tried (low, high) yet: those
        with its least member if `times` is 0, or else the `times` closest of each member outside its largest component.
        more: the group may have other pairs."""
        out = []
        for g, n, p, root, low, high in zip(ids, ns, bits, roots, lows, highs, strict=True):
            g, n, root = (np.asarray(x, dtype=np.int64) for x in (g, n, root))
            order = np.argsort(g)
            g, n, p, root = g[order], n[order], _Parities([p[i] for i in order]), root[order]
            tried = defaultdict(list)
            if low is not None:
                for i, j in np.searchsorted(g, np.stack([low, high], axis=1)).tolist():
                    tried[i].append(j)
                    tried[j].append(i)
            _, part, sizes = np.unique(root, return_inverse=True, return_counts=True)
            found, more = set(), not times
            for i in np.flatnonzero(part != sizes.argmax()).tolist() if times else range(1):
                can = (WHOLE * np.minimum(n, n[i]) >= PART * np.maximum(n, n[i])) & (part != part[i])
                can[tried[i]] = False
                at = np.flatnonzero(can)
                apart, both = p.apart(i, at), n[at] + n[i]
                near = (PART + WHOLE) * apart <= (WHOLE - PART) * both
                at = at[near][np.argsort((apart / both)[near], kind="stable")]
                if times:
                    more |= len(at) > times
                    at = at[:times]
                found.update((min(i, j), max(i, j)) for j in at.tolist())
            out.append([{"a": int(g[i]), "b": int(g[j]), "more": more} for i, j in sorted(found)])
        return pd.Series(out)

    return likely


def _candidates(groups: DataFrame, sets: DataFrame, roots: DataFrame, tried: DataFrame | None, times: int) -> DataFrame:
    """Pairs (group, a, b, more) out of `groups(group, ids)`. `tried(group, a, b)`: what they gave before, if anything."""
    known = sets.join(roots, sets["set_id"] == roots["node"], "left").select("set_id", "n", "bits", F.coalesce("root", "set_id").alias("root"))
    full = groups.select("group", F.explode("ids").alias("set_id")).join(known, "set_id").groupBy("group").agg(F.collect_list(F.struct("set_id", "n", "bits", "root")).alias("g"))
    if tried is None:
        full = full.withColumn("t", F.lit(None).cast("array<struct<a:long,b:long>>"))
    else:
        full = full.join(tried.groupBy("group").agg(F.collect_list(F.struct("a", "b")).alias("t")), "group", "left")
    pairs = _pairs(times)("g.set_id", "g.n", "g.bits", "g.root", "t.a", "t.b")
    return full.select("group", F.explode(pairs).alias("p")).select("group", "p.a", "p.b", "p.more")


def _compared(docs: DataFrame, wanted: DataFrame, row: str, size: int) -> DataFrame:
    """`wanted(row, ...)` with s, the shingles of each row's text. Texts stay where they are read: a filter of bounded size
    says which of them may be wanted."""
    at = wanted.select(F.col(row).bitwiseAND(F.lit(FILTER - 1)).alias("at")).distinct().toArrow()["at"].to_numpy()
    bits = np.zeros(FILTER, dtype=bool)
    bits[at] = True
    packed = np.packbits(bits).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
        some = (b.filter(pa.array(may[b.column(1).to_numpy() & (FILTER - 1)])) for b in batches)
        for part, sets in _sets(some, size):
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=[row, "s"])

    return docs.select("text", row).mapInArrow(run, f"`{row}` long, s binary").join(wanted, row)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links among rows (home, deal, set_id, own, s), of which each home's and deal's own set comes first."""
    at, mine = None, None
    for batch in batches:
        found = []
        for home, deal, set_id, own, s in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
            z = np.frombuffer(s.as_buffer(), dtype=np.int64)
            if own:
                at, mine = (home, deal), z.copy()
            elif at == (home, deal):
                shared = len(np.intersect1d(mine, z, assume_unique=True))
                if (PART + WHOLE) * shared >= PART * (len(mine) + len(z)):
                    found.append((home, set_id))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _linked(pairs: DataFrame, docs: DataFrame, rows: DataFrame, row: str, size: int) -> DataFrame:
    """The `pairs`, a written table, whose sets are alike enough, compared in full. `rows(set_id, row)`: a row that has each
    set. A set is shuffled to each set that it is compared with, which for its part goes to as many tasks as its comparisons
    take."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("deals"))
    others = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "deals").alias("deal"), "b", F.lit(False).alias("own"))
    own = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.col("a").alias("b"), F.lit(True).alias("own"))
    wanted = others.union(own).toDF("home", "deal", "set_id", "own").join(rows, "set_id")
    sets = _compared(docs, written(wanted, "near_wanted"), row, size).select("home", "deal", "set_id", "own", "s")
    dealt = sets.repartition("home", "deal").sortWithinPartitions("home", "deal", F.desc("own"))
    return written(dealt.mapInArrow(_alike, "a long, b long").distinct(), "near_links")


def simhash_pairs(sets: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """Pairs (a, b) of `sets(set_id, fp)` that connect just those whose fingerprints links of `radius` bits connect: each set
    with the least one of its fingerprint, and those of linked fingerprints."""
    least = written(sets.groupBy("fp").agg(F.min("set_id").alias("least")), "near_fingerprints")
    same = sets.select("set_id", "fp").join(least, "fp").filter("set_id <> least").select(F.col("least").alias("a"), F.col("set_id").alias("b"))
    linked = simhash.links(least.select("fp"), radius).join(least.toDF("a", "one"), "a").join(least.toDF("b", "other"), "b")
    return same.union(linked.select(F.least("one", "other"), F.greatest("one", "other"))).distinct()


def roots(docs: DataFrame, table: DataFrame, row: str, size: int = SHINGLE) -> DataFrame:
    """(node, root) of every set that is linked with another. `table`: slim() of `docs`, written."""
    first = prefixes(docs, size).repartition("token")  # shuffled once, and not aggregated before: few shingles repeat in a task
    groups = first.groupBy("token").agg(F.sort_array(F.collect_set("set_id")).alias("ids")).filter(F.size("ids") > 1).select("ids").distinct()
    groups = written(groups.withColumn("group", F.monotonically_increasing_id()), "near_groups")
    sets = written(table.groupBy("set_id").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("fp").alias("fp"), F.min(row).alias(row)), "near_slim")
    rows = sets.select("set_id", row)
    compared = written(simhash_pairs(sets), "near_pairs")
    edges = _linked(compared, docs, rows, row, size)
    found, tried, times = components(edges), None, 0
    while True:  # what fingerprints leave apart
        likely = written(_candidates(groups, sets, found, tried, times), "near_likely")
        if likely.isEmpty() and times:
            return found
        pairs = written(likely.select("a", "b").distinct().join(compared, ["a", "b"], "left_anti"), "near_pairs")
        compared, given = compared.union(pairs), likely.select("group", "a", "b")
        tried = tried.union(given) if tried else given
        if not pairs.isEmpty() and not (links := _linked(pairs, docs, rows, row, size)).isEmpty():
            edges = edges.union(links)
            found = components(edges)
        if times:
            groups = groups.join(likely.filter("more").select("group").distinct(), "group", "left_semi")
        members = groups.filter(F.size("ids") > 2).select("group", F.explode("ids").alias("node")).join(found, "node", "left")
        apart = members.groupBy("group").agg(F.min(F.coalesce("root", "node")).alias("low"), F.max(F.coalesce("root", "node")).alias("high")).filter("low <> high").select("group")
        groups = written(groups.join(apart, "group", "left_semi"), "near_rest")
        if groups.isEmpty():
            return found
        times = max(1, times * MORE)


def keep_one(docs: DataFrame, key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """One row of each group, with the columns of `docs`: that of the least key (null last), ties by a hash of the row's
    key and text."""
    names = docs.columns
    row, nth = fresh(docs, "row_hash", "nth")
    hashed = docs.withColumn(row, F.xxhash64(F.col(key).isNull(), F.col(key), F.coalesce("text", F.lit(""))))
    table = written(slim(hashed.select(F.col(key).alias("key_"), F.col(row).alias("row_"), "text"), ["key_", "row_"], size), "near_table")
    found = roots(hashed.select(F.col(row).alias("row_"), "text"), table, "row_", size)
    groups = table.join(found, table["set_id"] == found["node"], "left").select("key_", "row_", F.coalesce("root", "set_id").alias("root"))
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("key_").isNull().alias("last"), F.col("key_").alias("key"), F.col("row_").alias("row"))).alias("r")).select(F.col("r.row").alias(row)).distinct()
    w = Window.partitionBy(row).orderBy(row)  # rows alike in key and text
    return hashed.join(written(kept, "kept_rows"), row).withColumn(nth, F.row_number().over(w)).filter(F.col(nth) == 1).select(*names)
