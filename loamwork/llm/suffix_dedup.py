"""Removal of long repeated substrings by suffix order.

A suffix whose first `length` bytes also start earlier has a longest previous factor of `length` or more: the longer of
its common prefixes with the previous and with the next suffix, in suffix order, that is smaller in text order (Crochemore
and Ilie). Sorting all
suffixes of a corpus in one place does not scale, so the suffixes are bucketed first, by something that equal
substrings share: the least hash of the 32-byte grams in the first `length` bytes (winnowing, Schleimer, Wilkerson and
Aiken). A gram that is least in a run of neighbouring windows is their anchor; the bytes those windows cover are the
anchor's context. Only anchors whose gram occurs twice can hold repeats. Copies of one context are counted, not
compared (they share the gram and a 64-bit hash of the whole context), and the suffixes of different contexts of one gram
are put in suffix order in the gram's bucket, to depth `length`, where the arrays of common prefixes, of previous and next
smaller positions and of longest previous factors are computed. A suffix with any match, earlier or later, has a common
prefix of `length` with a neighbour in suffix order.

A bucket with over `bucket` different contexts is not sorted in one task: its windows are dealt out by their own hash
and counted with map-side combination, an exact way for the rest that finds the same repeats.

Text order is that of doc_id (null last), a hash of the text, and the offset. `keep_first` removes later copies and
keeps the first; without it every copy goes, the first included.

Long texts are anchored in segments that overlap by `length` - 1 bytes, so that no arrays of a whole text are made.

Defined results: a null text is empty; texts shorter than `length` are kept whole; a row that occurs twice repeats all
its bytes; rows are told apart by doc_id and a hash of their text, nulls too; an empty table gives an empty result;
columns that clash with internal names do no harm, since only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, written

LENGTH, GRAM, BUCKET = 200, 32, 7000
#: Bytes of text worked on at once; a bucket of BUCKET contexts holds about twice as many.
BLOCK = 1_000_000

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_MULT = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes, by doubling."""
    h, size, level = _BYTE[buf], 1, 0
    while size < GRAM:
        h = h[:-size] * _MULT[level] + h[size:]
        size, level = 2 * size, level + 1
    h ^= h >> np.uint64(32)
    h *= _MULT[7]
    return h ^ h >> np.uint64(29)


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all windows of `length` bytes within texts: (the texts end to end, each text's start, then for each anchor its text, hash, and
    the first and last window it stands for). Ties go to the first gram, so equal windows choose alike."""
    joined = b"".join(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    none = np.zeros(0, dtype=np.int64)
    if len(joined) < length:
        return joined, starts, none, none.astype(np.uint64), none, none
    h = gram_hashes(np.frombuffer(joined, dtype=np.uint8))
    span = length - GRAM + 1
    value, at, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < span:
        step = min(have, span - have)
        right = value[step:] < value[: len(value) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        value = np.where(right, value[step:], value[: len(value) - step])
        have += step
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    ok = np.flatnonzero(doc[: len(at)] == doc[length - 1 : length - 1 + len(at)])
    if not len(ok):
        return joined, starts, none, none.astype(np.uint64), none, none
    own, of = at[ok], doc[ok]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])])
    last = np.r_[first[1:], len(ok)] - 1
    return joined, starts, of[first], h[own[first]], ok[first], ok[last]


def _text_blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Blocks of segments of texts: each one's text, where in it the segment begins, and its bytes. Every window of
    `length` bytes lies in one segment."""
    of, at, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for start in range(0, max(1, len(t) - length + 1), BLOCK):
            part = t[start : start + BLOCK + length - 1]
            if held and size + len(part) > BLOCK:
                yield np.array(of), np.array(at), held
                of, at, held, size = [], [], [], 0
            of.append(i)
            at.append(start)
            held.append(part)
            size += len(part)
    if held:
        yield np.array(of), np.array(at), held


def suffix_order(windows: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of at least `length` bytes, the suffixes of that length or more, numbered in text order: (the place
    in `windows` of each, the suffixes in suffix order to that depth, the length of what each one there has in common with
    the one before it, `length` at most)."""
    sizes = np.array([len(w) for w in windows], dtype=np.int64)
    buf = np.frombuffer(b"".join(windows) + bytes(8), dtype=np.uint8)
    n = len(buf) - 8
    word = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | buf[i : i + n]
    ranks, have, by = {}, 8, np.unique(word, return_inverse=True)[1].astype(np.int64)
    ranks[8] = by
    while 2 * have <= length:
        by = np.unique(by[: len(by) - have] << 32 | by[have:], return_inverse=True)[1].astype(np.int64)
        have *= 2
        ranks[have] = by
    owner = np.repeat(np.arange(len(windows)), sizes - length + 1)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1) + begin[owner]
    key, done = ranks[have][place], have
    for size in sorted(ranks, reverse=True):  # the rest of the depth in pieces of powers of two
        while done + size <= length:
            key = np.unique(key << 32 | ranks[size][place + done], return_inverse=True)[1].astype(np.int64)
            done += size
    if done < length:  # the last piece overlaps
        key = np.unique(key << 32 | ranks[8][place + length - 8], return_inverse=True)[1].astype(np.int64)
    at = np.argsort(key, kind="stable")
    lcp = np.zeros(len(at), dtype=np.int32)
    same = key[at[1:]] == key[at[:-1]]
    lcp[1:][same] = length
    other = np.flatnonzero(~same) + 1
    x, y = place[at[other - 1]], place[at[other]]
    depth = np.zeros(len(other), dtype=np.int64)
    for size in sorted(ranks, reverse=True):
        fits = np.flatnonzero(depth + size <= length)
        equal = ranks[size][x[fits] + depth[fits]] == ranks[size][y[fits] + depth[fits]]
        depth[fits[equal]] += size
    going = np.arange(len(other))
    for _ in range(7):  # less than the least piece is left
        going = going[(depth[going] < length) & (buf[x[going] + depth[going]] == buf[y[going] + depth[going]])]
        depth[going] += 1
    lcp[other] = depth
    return owner, at, lcp


def longest_previous(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, from the suffixes in suffix order and their common prefixes: what it
    has in common with the nearest one before or after it there that is smaller in text order. Pointers to the nearest
    smaller position jump over each other, all at once, each with the least common prefix on its way."""

    def side(at: np.ndarray, common: np.ndarray) -> np.ndarray:
        to, least = np.arange(len(at)) - 1, common.copy()
        todo = np.arange(1, len(at))
        todo = todo[at[todo - 1] > at[todo]]
        while len(todo):
            over = to[todo]
            further, shorter = to[over], least[over]
            to[todo], least[todo] = further, np.minimum(least[todo], shorter)
            todo = todo[(further >= 0) & (least[todo] > 0)]
            todo = todo[at[to[todo]] > at[todo]]
        least[to < 0] = 0
        return least

    both = np.maximum(side(at, lcp), side(at[::-1], np.r_[0, lcp[:0:-1]].astype(lcp.dtype))[::-1])
    out = np.empty(len(at), dtype=lcp.dtype)
    out[at] = both
    return out


def _runs(flags: np.ndarray) -> list[int]:
    """Begin and end (inclusive) of each run of True, one after the other."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).reshape(-1).tolist()


def repeats(windows: list[bytes], length: int = LENGTH) -> tuple[list[list[int]], list[list[int]]]:
    """For each context, in text order: the runs of its windows that occur in another context, and of those that occur in
    an earlier one."""
    owner, at, lcp = suffix_order(windows, length)
    shared = np.empty(len(at), dtype=bool)
    shared[at] = np.maximum(lcp, np.r_[lcp[1:], 0]) >= length
    later = longest_previous(at, lcp) >= length
    cuts = np.searchsorted(owner, np.arange(1, len(windows)))
    return [_runs(x) for x in np.split(shared, cuts)], [_runs(x) for x in np.split(later, cuts)]


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows are (doc_id, sd_hash, text); spans are (doc_id, sd_hash, sd_spans), byte runs to remove."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("sd_hash"), "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, block in _text_blocks([t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()], length):
                h, n = np.unique(anchors(block, length)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["gram", "n"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, at, block in _text_blocks([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()], length):
                joined, starts, of, h, first, last = anchors(block, length)
                digest = xxhash.xxh3_64_intdigest
                c = np.array([digest(joined[x:y]) for x, y in zip(first.tolist(), (last + length).tolist(), strict=True)], dtype=np.uint64)
                rows_at = pa.array(text[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), b.column(0).take(rows_at), b.column(1).take(rows_at), pa.array(first - starts[of] + at[of]), pa.array((last - first).astype(np.int32))],
                    names=["gram", "context", "doc_id", "sd_hash", "first", "more"],
                )

    # grams that occur once hold no repeats
    twice = written(rows.select("text").mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"), "grams")
    found = rows.mapInArrow(contexts, f"gram long, context long, doc_id {kind}, sd_hash long, first long, more int")
    found = written(found.join(twice, "gram", "left_semi"), "anchors")
    # one row for each context: how often it occurs, and where first
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sd_hash", "first", "more")
    each = found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    each = written(each, "contexts")
    many = each.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = each.join(many, "gram").select("gram", "context", "kinds", "at.*").drop("last")
    wanted = mixed.groupBy("doc_id", "sd_hash").agg(F.collect_list(F.struct("gram", "context", "kinds", "first", "more")).alias("sd_want"))
    wanted = wanted.withColumnsRenamed({"doc_id": "w_id", "sd_hash": "w_hash"})
    bodies = rows.join(wanted, (F.col("sd_hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("doc_id", "sd_hash", "text", "sd_want")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            for i, t in enumerate(texts):
                want = b.column(3)[i].as_py()
                n = len(want)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["gram"] for w in want], pa.int64()), pa.array([w["context"] for w in want], pa.int64()), pa.array([w["kinds"] for w in want], pa.int64()), b.column(0).take(pa.array([i] * n)), b.column(1).take(pa.array([i] * n)),
                     pa.array([w["first"] for w in want], pa.int64()), pa.array([t[w["first"] : w["first"] + w["more"] + length] for w in want], pa.binary())],
                    names=["gram", "context", "kinds", "doc_id", "sd_hash", "first", "bytes"],
                )

    bytes_of = bodies.mapInArrow(cut, f"gram long, context long, kinds long, doc_id {kind}, sd_hash long, first long, bytes binary")
    bytes_of = written(bytes_of, "context_bytes")
    order = [F.asc_nulls_last("doc_id"), F.asc("sd_hash"), F.asc("first")]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def solve(part: list[tuple]) -> pa.RecordBatch:
            seen: dict[tuple, int] = {}
            for i, r in enumerate(part):
                seen.setdefault(r[:2], i)  # rows alike in doc_id and text give a context more than once
            part = [part[i] for i in seen.values()]
            shared, later = repeats([r[3] for r in part], length)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array(shared, pa.list_(pa.int32())), pa.array(later, pa.list_(pa.int32()))],
                names=["gram", "context", "shared", "later"],
            )

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if size > BLOCK and r[0] != held[-1][0]:  # whole buckets only
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield solve(held)

    sorted_ = bytes_of.filter(F.col("kinds") <= bucket).repartition("gram").sortWithinPartitions("gram", *order).select("gram", "context", "kinds", "bytes")
    small = sorted_.mapInArrow(sort, "gram long, context long, shared array<int>, later array<int>")

    # large buckets: windows by their own hash
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w in enumerate(b.column(6).to_pylist()):
                n = len(w) - length + 1
                hashes = np.array([xxhash.xxh3_64_intdigest(w[k : k + length]) for k in range(n)], dtype=np.uint64).view(np.int64)
                same = pa.array([i] * n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(same), b.column(1).take(same), pa.array(np.arange(n, dtype=np.int32)), pa.array(hashes), b.column(3).take(same), b.column(4).take(same), b.column(5).take(same)],
                    names=["gram", "context", "k", "window", "doc_id", "sd_hash", "first"],
                )

    large = bytes_of.filter(F.col("kinds") > bucket).mapInArrow(deal, f"gram long, context long, k int, window long, doc_id {kind}, sd_hash long, first long")
    large = written(large, "windows")
    first_at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sd_hash", "first")
    classes = large.groupBy("gram", "window").agg(F.min("context").alias("c0"), F.max("context").alias("c1"), F.min(first_at).alias("least")).filter("c0 <> c1").drop("c0", "c1")
    hits = large.join(classes, ["gram", "window"]).select("gram", "context", "k", (first_at != F.col("least")).alias("is_later"))
    ks = lambda flag: F.flatten(F.transform(F.array_sort(F.array_distinct(F.collect_list(F.when(flag, F.col("k"))))), lambda k: F.array(k, k)))
    big = hits.groupBy("gram", "context").agg(ks(F.lit(True)).alias("shared"), ks(F.col("is_later")).alias("later"))

    result = written(each.join(small.union(big), ["gram", "context"], "left"), "repeats").filter("n > 1 or size(shared) > 0")
    whole = F.array(F.lit(0), F.col("more"))
    nothing = F.array().cast("array<int>")
    here = found.join(result, ["gram", "context"])
    if keep_first:
        is_first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sd_hash", "first", "more") == F.col("at")
        windows = F.when(is_first, F.coalesce("later", nothing)).otherwise(whole)
    else:
        windows = F.when(F.col("n") > 1, whole).otherwise(F.coalesce("shared", nothing))
    spans = here.select("doc_id", "sd_hash", F.struct("first", windows.alias("w")).alias("s")).filter(F.size("s.w") > 0)
    spans = spans.groupBy("doc_id", "sd_hash").agg(F.collect_list("s").alias("sd_spans"))
    return rows, spans


def removed_runs(spans: list[dict] | None, length: int = LENGTH) -> np.ndarray:
    """Maximal byte runs [begin, end) that the windows cover."""
    pairs = [(s["first"] + a, s["first"] + b + length) for s in spans or [] for a, b in zip(s["w"][::2], s["w"][1::2], strict=True)]
    if not pairs:
        return np.zeros((0, 2), dtype=np.int64)
    p = np.array(sorted(pairs), dtype=np.int64)
    top = np.maximum.accumulate(p[:, 1])
    new = np.flatnonzero(np.r_[True, p[1:, 0] > top[:-1]])
    return np.stack([p[new, 0], top[np.r_[new[1:] - 1, len(p) - 1]]], axis=1)


def _kept(text: bytes, runs: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in runs.tolist():
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def _joined(docs: DataFrame, rows: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.withColumnsRenamed({"doc_id": "s_id", "sd_hash": "s_hash"})
    return rows.join(s, (F.col("sd_hash") == F.col("s_hash")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left")


def removal_report(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, spans = repeated_spans(docs, length, keep_first, bucket)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = t or b""
                runs = removed_runs(s, length)
                out.append((len(t), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(_kept(t, runs)).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _joined(docs, rows, spans).select("doc_id", "text", "sd_spans").mapInArrow(report, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, bucket: int = BUCKET) -> DataFrame:
    """`docs` with the repeated bytes gone from `text` (a character that is cut goes whole) and n_chars, if there, brought up to date."""
    _, spans = repeated_spans(docs, length, keep_first, bucket)
    names = docs.columns
    h, runs_col, s_id, s_hash = fresh(docs, "sd_hash", "sd_spans", "s_id", "s_hash")
    s = spans.select(F.col("doc_id").alias(s_id), F.col("sd_hash").alias(s_hash), F.col("sd_spans").alias(runs_col))
    full = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    full = full.join(s, (F.col(h) == F.col(s_hash)) & F.col("doc_id").eqNullSafe(F.col(s_id)), "left").select(*names, runs_col)
    at = names.index("text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            new = [None if t is None else t if not s else _kept(t, removed_runs(s, length)) for t, s in zip(texts, b.column(len(names)).to_pylist(), strict=True)]
            cols = b.columns[: len(names)]
            cols[at] = pa.array([None if t is None else t.decode("utf-8", "ignore") for t in new], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = full.mapInArrow(strip, fields)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))
