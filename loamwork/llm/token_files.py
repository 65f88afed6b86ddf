"""Token ids in compact files: canonical length-limited Huffman coding in independent blocks.

File format: a folder with two Parquet tables. `codebook` holds (symbol, bits): the code lengths, from which the
canonical code follows (codes ascend by length, then symbol). `blocks` holds one row for each block of whole documents
in ascending order of (part, block): the documents' ids and token counts, the coded bits, the number of bits, and one
checkpoint for each STEP symbols, the bit offset at which decoding can begin. Blocks depend on nothing but the
codebook, so any block can be read by itself, and within a block all checkpoints are decoded side by side.

Defined results: a null or empty text is the end id alone; null doc_ids come last; rows with equal doc_ids are ordered
by their ids, and rows equal in both by nothing, since they are alike; a text of any length is one document of one block;
an empty table makes an empty file; extra columns are not read, whatever they are called.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _WS, odd, pieces, portable, unit_words
from .common import passing, runs, shared_path, table, written

#: The longest code, unless there are so many symbols that it would be a bad one; 2^MAX_BITS entries make the decoding table.
MAX_BITS = 16
#: Symbols between checkpoints, and symbols a block has at least (its last document may pass that).
STEP, BLOCK_IDS = 256, 1 << 18
#: Bytes of text that are encoded together, and words and units kept in a worker's caches (some 200 and 50 bytes each).
BLOCK, CACHE, UNITS = 24_000_000, 200_000, 2_000_000
#: A space next to other white space or at an end of the text: such a text is not cut at its spaces.
_STRANGE = f"^ | $| [{_WS}\x1c-\x1f]|[{_WS}\x1c-\x1f] "


# --- the code ---------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Lengths of an optimal prefix code with none over `limit` bits (MAX_BITS, or two more than all symbols need), 0
    for symbols that never occur (package-merge, with the packages kept as counts of how many of the cheapest leaves each
    level takes)."""
    used = np.flatnonzero(counts)
    limit = limit or max(MAX_BITS, len(used).bit_length() + 2)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    is_leaf, level = [np.ones(n, dtype=bool)], weights
    for _ in range(limit - 1):
        m = len(level) // 2
        packed = level[: 2 * m : 2] + level[1 : 2 * m : 2]
        merged = np.concatenate([weights, packed])
        by = np.argsort(merged, kind="stable")
        is_leaf.append(by < n)
        level = merged[by]
    take = 2 * (n - 1)
    lengths = np.zeros(n, dtype=np.int64)
    # a list for each bit, the first of leaves alone; from the last one back
    for leaf in reversed(is_leaf):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
        if take == 0:
            break
    out[order] = lengths
    return out


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.bits = int(lengths.max()) if len(used) else 0
        code, before = 0, 0
        if len(lengths) > 1 << 26:
            raise ValueError("more symbols than the table can name")
        self.table = np.zeros(1 << self.bits, dtype=np.int32)  # for each beginning of a code, the symbol and its size
        for s in order.tolist():
            n = int(lengths[s])
            code <<= n - before
            self.codes[s] = code
            at = code << (self.bits - n)
            self.table[at : at + (1 << (self.bits - n))] = s << 5 | n
            code, before = code + 1, n

    def encode(self, ids: np.ndarray) -> tuple[bytes, int, np.ndarray]:
        """The coded bits in big-endian 32-bit words, their number, and a bit offset for each STEP symbols."""
        size = self.lengths[ids].astype(np.int64)
        if len(ids) and int(size.min()) == 0:
            raise ValueError("a symbol has no code")
        end = np.cumsum(size)
        total = int(end[-1]) if len(ids) else 0
        at = end - size
        word, off = at >> 5, (at & 31).astype(np.uint64)
        value = self.codes[ids] << (np.uint64(64) - off - size.astype(np.uint64))
        out = np.zeros((total >> 5) + 2, dtype=np.uint64)
        if len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            where = word[starts]
            out[where] |= np.bitwise_or.reduceat(value >> np.uint64(32), starts)
            out[where + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), starts)
        return out.astype(">u4").tobytes(), total, at[::STEP]

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The `n` symbols: one lane for each checkpoint, all lanes a symbol at a time, by table."""
        words = np.r_[np.frombuffer(data, dtype=">u4"), np.zeros(STEP * self.bits // 32 + 2, dtype=np.uint32)].astype(np.int64)
        pairs = words[:-1] << 32 | words[1:]  # 64 bits from every 32nd on; the last lane may run on into zeros
        out = np.zeros((STEP, len(checkpoints)), dtype=np.int32)
        at = np.array(checkpoints, dtype=np.int64)
        mask, width = (1 << self.bits) - 1, 64 - self.bits
        for i in range(min(STEP, n)):
            window = pairs.take(at >> 5)
            window >>= width - (at & 31)
            window &= mask
            out[i] = self.table.take(window)
            at += out[i] & 31
        return (out.T.reshape(-1)[:n] >> 5).astype("<u4")


@lru_cache(maxsize=2)
def _code(book: bytes) -> Code:
    return Code(np.frombuffer(book, dtype=np.uint8))


# --- tokens -----------------------------------------------------------------------------------------------------------


#: How the library's byte-level pre-tokenizer splits text before merges.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """The tokenizers library behind caches. A text is cut at single spaces into units that no match can cross; a
    byte-level BPE is asked for the words of new units, and for the whole of a text that holds one of its added tokens.
    Any other kind of tokenizer is asked for whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_words = (
            spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.find = regex.compile(portable(_BYTE_LEVEL)).findall
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.words: dict[str, bytes] = {}
        self._forget()

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Of the units that follow a space, those at the places `keep` stay in the cache; place 0 is nobody's."""
        if keep is None:
            self.units, self.ids = pa.array([None], pa.large_string()), pa.array([b""], pa.large_binary())
        else:
            self.units, self.ids = self.units.take(pa.array(keep)), self.ids.take(pa.array(keep))

    def _ids(self, word: str) -> bytes:
        letters = word.replace(" ", self.letters[32]) if word.isascii() and word[-1:].isalpha() else word.encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, [t.id for t in self.model.tokenize(letters)])
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def _words(self, words: list[str]) -> bytes:
        known, out = self.words, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = known[w] = self._ids(w)
            out.append(ids)
        return b"".join(out)

    def _places(self, units: pa.Array, skip: np.ndarray) -> np.ndarray:
        """The place of each unit in the cache, those that are new learnt; 0 at the places `skip`."""
        at = pc.index_in(units, value_set=self.units)
        lost = np.array(at.is_null())
        lost[skip] = False
        if lost.any():
            new = units.filter(pa.array(lost)).unique()
            coded = [self._words(unit_words(f" {u}", self.find)) for u in new.to_pylist()]
            before = len(self.units)
            self.units, self.ids = pa.concat_arrays([self.units, new]), pa.concat_arrays([self.ids, pa.array(coded, pa.large_binary())])
            out = at.fill_null(0).to_numpy().astype(np.int64)
            out[lost] = before + pc.index_in(units.filter(pa.array(lost)), value_set=new).to_numpy()
        else:
            out = at.fill_null(0).to_numpy().astype(np.int64)
        out[skip] = 0
        return out

    def _odd(self, text: str) -> bytes:
        """The ids of a text with an added token or an odd space."""
        if any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        return b"".join([self._words(self.find(p)) if odd(p) else self._plain(pa.array([p], pa.large_string()))[0] for p in pieces(text)])

    def _plain(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts whose spaces all stand between other characters."""
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        units = cut.flatten()
        heads = units.take(pa.array(starts[:-1])).to_pylist()
        at = self._places(units, starts[:-1])
        taken = self.ids.take(pa.array(at))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset :][starts].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        out = [self._words(unit_words(h, self.find) if h else []) + data[a:b] for h, a, b in zip(heads, ends, ends[1:], strict=False)]
        if len(self.units) > UNITS:
            self._forget(np.unique(np.r_[0, at]))
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a large_string array without nulls. Texts are cut and their units looked up outside
        Python, which sees units that are new only."""
        if not self.by_words:
            return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        strange = pc.match_substring_regex(texts, _STRANGE)
        for a in self.added:
            strange = pc.or_(strange, pc.match_substring(texts, a))
        at = np.array(strange)
        if not at.any():
            return self._plain(texts)
        plain, rest = iter(self._plain(texts.filter(pc.invert(strange)))), iter([self._odd(t) for t in texts.filter(strange).to_pylist()])
        return [next(rest if x else plain) for x in at.tolist()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def tokenized(docs: DataFrame, path: str, end_id: int, wide: bool) -> DataFrame:
    """(doc_id, ids, head, tally): each text's ids and the end id, in little-endian 16 bits, or 32 bits if `wide`, and the
    first 16 bytes of them; and for each block of texts a row that has nothing but the counts of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        to = np.dtype("<u4" if wide else "<u2")
        end = np.array([end_id], dtype=to).tobytes()
        counted = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            for at, n in runs(texts, BLOCK):
                ids = [(x if enc.dtype == to else np.frombuffer(x, dtype=enc.dtype).astype(to).tobytes()) + end for x in enc.encode(pa.concat_arrays([texts.slice(at, n)]))]
                total = np.bincount(np.frombuffer(b"".join(ids), dtype=to))
                some = np.flatnonzero(total)
                pairs = pa.StructArray.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["id", "n"])
                tally = pa.ListArray.from_arrays(pa.array([*[0] * (n + 1), len(some)], pa.int32()), pairs)
                whole = pa.array([*ids, None], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0).slice(at, n), pa.nulls(1, b.column(0).type)]), whole, pc.binary_slice(whole, 0, 16), tally.cast(counted)], names=["doc_id", "ids", "head", "tally"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, head binary, tally array<struct<id:int,n:long>>")


# --- the files --------------------------------------------------------------------------------------------------------


def write_files(docs: DataFrame, tokenizer: str, end_id: int, where: str) -> None:
    """Encodes the texts of `docs` and writes the file at `where` in ascending doc_id order."""
    spark = docs.sparkSession
    size = encoder(tokenizer).size
    size = max(size, end_id + 1)
    wide = size > 1 << 16
    width = np.dtype("<u4" if wide else "<u2")
    ids = written(tokenized(docs, tokenizer, end_id, wide), "token_ids")
    # one row for each id of the vocabulary reaches the driver
    counts = np.zeros(size, dtype=np.int64)
    for i, n in ids.filter("size(tally) > 0").select(F.explode("tally").alias("t")).groupBy("t.id").agg(F.sum("t.n")).collect():
        counts[i] = n
    lengths = code_lengths(counts)
    book = lengths.tobytes()
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "symbol int, bits int").coalesce(1).write.parquet(f"{where}/codebook")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, block = _code(book), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, names, held
            data, bits, marks = code.encode(np.concatenate(held))
            row = [[part], [block], [names], [[len(x) for x in held]], [sum(len(x) for x in held)], [marks], [bits], [data]]
            block, names, held = block + 1, [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=heads)

        doc_type = None
        for b in batches:
            doc_type = b.schema.field(0).type
            types = [pa.int32(), pa.int64(), pa.list_(doc_type), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            heads = ["part", "block", "doc_ids", "n_tokens", "block_tokens", "checkpoints", "n_bits", "bits"]
            n = sum(len(x) for x in held)
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names.append(d)
                held.append(np.frombuffer(x, dtype=width))
                n += len(held[-1])
                if n >= BLOCK_IDS:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.asc_nulls_last("doc_id"), F.asc("ids")]
    # the bounds of the ranges come from a sample on the driver: a beginning of the ids orders them alike, in 16 bytes
    sorted_ids = ids.filter("ids is not null").select("doc_id", "ids", "head").repartitionByRange(parts, by[0], F.asc("head")).select("doc_id", "ids").sortWithinPartitions(*by)
    out = sorted_ids.mapInArrow(pack, f"part int, block long, doc_ids array<{kind}>, n_tokens array<long>, block_tokens long, checkpoints array<long>, n_bits long, bits binary")
    out.write.option("compression", "none").parquet(f"{where}/blocks")


def read_files(spark: SparkSession, where: str) -> DataFrame:
    """The documents of the file at `where`, decoded: (doc_id, start, n_tokens, ids_crc32)."""
    found = spark.read.parquet(f"{where}/codebook").collect()  # a row for each id of the vocabulary at most
    lengths = np.zeros(max((r["symbol"] for r in found), default=0) + 1, dtype=np.uint8)
    for r in found:
        lengths[r["symbol"]] = r["bits"]
    book = lengths.tobytes()
    rows = spark.read.parquet(f"{where}/blocks")
    # where each part begins: a row for each part of the sort on the driver; within a part, a running sum over its blocks
    before, starts = 0, []
    for p, n in sorted(map(tuple, rows.groupBy("part").agg(F.sum("block_tokens")).collect())):
        starts.append((p, before))
        before += n
    parts = F.broadcast(spark.createDataFrame(starts, "part int, part_start long"))
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.select("part", "block", "block_tokens").withColumn("inner", F.coalesce(F.sum("block_tokens").over(w), F.lit(0)))
        .join(parts, "part").select("part", "block", (F.col("part_start") + F.col("inner")).alias("first"))
    )
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(book)
        for b in batches:
            for i in range(b.num_rows):
                _, _, names, sizes, marks, data = (c[i].as_py() for c in b.columns)
                ids = code.decode(data, np.array(marks), sum(sizes))
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes, strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[i].as_py()] * n, pa.int32()), pa.array([b.column(1)[i].as_py()] * n, pa.int64()), pa.array(names, b.schema.field(2).type.value_type), pa.array(ends - np.array(sizes)), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "block", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    docs = rows.select("part", "block", "doc_ids", "n_tokens", "checkpoints", "bits").mapInArrow(unpack, f"part int, block long, doc_id {kind}, inner long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "block"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    where = shared_path(spark, "token-files")
    write_files(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), 2, where)
    passing(spark, where)
    return read_files(spark, where)
