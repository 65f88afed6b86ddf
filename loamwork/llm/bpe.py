"""Byte-level BPE encoding and decoding by merge replay.

The words of a block of documents are laid end to end, an inverted index takes each mergeable token to the places where
its two halves stand side by side, and merges are applied to all words at once in rank order; each merge looks at its
two neighbours only. A merge can make a pair of a lower rank than its own; the queue of ranks then goes back to it
first, so every word sees the merges that it would see alone. Words are cached, so a word costs one replay for each
worker, and blocks need no shuffle: how a word merges depends on nothing but the word.

Defined results: a null or empty text has no tokens; any bytes of valid UTF-8 are encoded and decoded exactly; very
long texts are cut where no match can cross; repeated rows give repeated results; an empty table gives an empty
result; input columns of the same name as a result column are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import table

#: Unicode White_Space; a library's \s may hold more.
_WS = r"\t-\r \x85\xa0  -     　"
#: A space next to other white space, or at an end of the text: such texts are not cut at spaces.
_ODD = re.compile(r" (?:\s|$)|\s |^ ")
_RARE = re.compile(r"[^\S \n]")
#: Words kept in each generation of a worker's three caches, some 200 bytes each, and pairs of tokens that are known.
CACHE, PAIRS = 120_000, 300_000
#: A block of documents whose words are replayed together, in characters.
BLOCK = 2_000_000
#: Texts longer than this are encoded in pieces.
LONG = 1_000_000


def portable(pattern: str) -> str:
    """The pattern with white space written out as a class."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WS}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{_WS}]").replace(r"\s", f"[{_WS}]")


def pieces(text: str) -> Iterable[str]:
    """`text` cut before single spaces between other characters, where every match of a pattern of the kind
    `| ?class+|` ends; only long texts are cut."""
    start = 0
    while len(text) - start > LONG:
        at = start + LONG
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                at = -1
                break
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                break
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def odd(text: str) -> bool:
    """Whether a space stands next to other white space or at an end."""
    return "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or bool(_RARE.search(text) and _ODD.search(text))


def unit_words(unit: str, find) -> list[str]:
    """The pattern's matches in a unit: letters, letters and a mark, or else what the pattern finds."""
    bare = unit[1:] if unit[:1] == " " else unit
    if bare.isalpha():
        return [unit]
    if bare[-1:] in (".", ",") and bare[:-1].isalpha():
        return [unit[:-1], unit[-1]]
    return find(unit)


class Cache:
    """What has been worked out, in two generations: when the young one is full it becomes the old one, and what is
    asked for again comes back from there."""

    def __init__(self, limit: int = CACHE):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: Iterable) -> list:
        """The keys that are new; all others are in `young` from now on."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = []
        for k in keys:
            if k not in young:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    young[k] = v
        return out


class Ranks:
    """Token ranks and the replay of merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(portable(pattern)).findall
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.single = np.array([ranks.get(bytes([i]), 0) for i in range(256)], dtype=np.int64)
        self.joined: dict[int, int] = {}
        self.known, self.spaced, self.words = Cache(), Cache(), Cache()

    @classmethod
    def read(cls, path: str, pattern: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _join(self, a: int, b: int) -> int:
        """The rank of two tokens' bytes as one token, or -1."""
        key = a << 32 | b
        r = self.joined.get(key)
        if r is None:
            if len(self.joined) >= PAIRS:
                self.joined.clear()
            r = self.joined[key] = self.ranks.get(self.bytes[a] + self.bytes[b], -1)
        return r

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(flat)
        if not n:
            return [b""] * len(words)
        word = np.repeat(np.arange(len(words)), sizes)
        ids = self.single[flat]
        inside = word[1:] == word[:-1]  # a place and the next one are of one word
        left, right, pair = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        left[1:][inside], right[:-1][inside] = np.flatnonzero(inside), np.flatnonzero(inside) + 1
        pair[:-1][inside] = self._ranks(ids[:-1][inside], ids[1:][inside])
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Places whose pairs are new go to the index under their ranks."""
            rank = pair[places]
            places, rank = places[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for r, chunk in zip(rank[starts].tolist() if len(rank) else [], np.split(places, starts[1:]) if len(rank) else [], strict=True):
                if r in index:
                    index[r].append(chunk)
                else:
                    index[r] = [chunk]
                    heapq.heappush(queue, r)

        def merge(p: np.ndarray, r: int) -> None:
            q = right[p]
            after = right[q]
            ids[p], alive[q], pair[q], right[p] = r, False, -1, after
            has = after >= 0
            left[after[has]] = p[has]
            before = left[p]
            before = before[before >= 0]
            pair[p] = -1
            pair[p[has]] = self._ranks(ids[p[has]], ids[after[has]])
            pair[before] = self._ranks(ids[before], ids[right[before]])
            enter(np.unique(np.concatenate([p, before])))

        enter(np.flatnonzero(pair >= 0))
        while queue:
            r = heapq.heappop(queue)
            p = index.pop(r)
            p = np.unique(np.concatenate(p)) if len(p) > 1 else p[0]
            p = p[pair[p] == r]  # a neighbour may have merged since
            if not len(p):
                continue
            q = right[p]
            if len(p) > 1 and (q[:-1] == p[1:]).any():  # of places that overlap, the first merges
                taken, end = [], -1
                for x, y in zip(p.tolist(), q.tolist(), strict=True):
                    if x != end:
                        taken.append(x)
                        end = y
                p = np.array(taken)
                q = right[p]
            same = word[p[1:]] == word[p[:-1]]
            if same.any():
                # does a merge make a pair of a lower rank where its word has other places? Then it goes first.
                after, before = right[q], left[p]
                new = np.full(len(p), 1 << 40)
                has = after >= 0
                t = self._ranks(np.full(has.sum(), r), ids[after[has]])
                new[has] = np.where(t >= 0, t, 1 << 40)
                has = before >= 0
                t = self._ranks(ids[before[has]], np.full(has.sum(), r))
                new[has] = np.minimum(new[has], np.where(t >= 0, t, 1 << 40))
                many = np.r_[False, same] | np.r_[same, False]
                if (new[many] < r).any():
                    late = np.r_[False, same]  # all but the first place of each word wait
                    index[r] = [p[late]]
                    heapq.heappush(queue, r)
                    p = p[~late]
            merge(p, r)
        flat_ids = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4
        return [flat_ids[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each two tokens' bytes as one token, or -1; looked up once for each distinct pair."""
        if len(a) < 4:
            return np.array([self._join(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
        distinct, which = np.unique(a << 32 | b, return_inverse=True)
        return np.array([self._join(x >> 32, x & 0xFFFFFFFF) for x in distinct.tolist()], dtype=np.int64)[which]

    def _learn(self, keys: set[str], cache: Cache, space: str) -> None:
        """Sees to it that the ids of these units are in the cache; a unit is cut by the pattern, and words that are
        new are replayed together."""
        units = cache.missing(keys)
        found = [unit_words(space + u, self.find) for u in units]
        new = self.words.missing({w for f in found for w in f})
        whole = [self.ranks.get(w.encode()) for w in new]
        words = self.words.young
        words.update((w, r.to_bytes(4, "little")) for w, r in zip(new, whole, strict=True) if r is not None)
        rest = [w for w, r in zip(new, whole, strict=True) if r is None]
        words.update(zip(rest, self.replay([w.encode() for w in rest]), strict=True))
        cache.young.update((u, b"".join([words[w] for w in f])) for u, f in zip(units, found, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[tuple | None] = []
        first: set[str] = set()
        other: set[str] = set()
        for t in texts:
            for p in pieces(t):
                if odd(p):
                    words = self.find(p)
                    first.update(words)
                    cut.append((words, ()))
                else:
                    head, *tail = p.split(" ")
                    first.add(head)
                    other.update(tail)
                    cut.append(((head,), tail))
            cut.append(None)
        self._learn(first, self.known, "")
        self._learn(other, self.spaced, " ")
        out, now = [], []
        known, spaced = self.known.young, self.spaced.young
        for c in cut:
            if c is None:
                out.append(b"".join(now))
                now = []
            else:
                now.extend([known[w] for w in c[0]])
                now.extend([spaced[u] for u in c[1]])
        return out

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes
        return b"".join([of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=4)
def ranks_of(path: str, pattern: str) -> Ranks:
    """One for each worker."""
    return Ranks.read(path, pattern)


def blocks(texts: list[str], limit: int = BLOCK) -> Iterator[list[str]]:
    """Runs of texts of about `limit` characters, one text at least."""
    now, size = [], 0
    for t in texts:
        if now and size + len(t) > limit:
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t)
    if now:
        yield now


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str], digests: bool = False) -> DataFrame:
    """The columns `keep`, n_tokens, and the ids as little-endian unsigned 32-bit integers (`ids`, binary), or with
    `digests` ids_sha256 and decoded_sha256."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path, pattern)
        for b in batches:
            at = 0
            for block in blocks([t or "" for t in b.column(0).to_pylist()]):
                ids = ranks.encode(block)
                more = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if digests:
                    more["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                    more["decoded_sha256"] = pa.array([hashlib.sha256(ranks.decode(x)).hexdigest() for x in ids], pa.string())
                else:
                    more["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(block)) for c in b.columns[1:]), *more.values()], names=[*b.schema.names[1:], *more])
                at += len(block)

    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    return docs.select("text", *keep).mapInArrow(run, f"{fields}, n_tokens long, {tail}")


def decode_documents(encoded: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and the text of `ids`."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path, pattern)
        for b in batches:
            text = [ranks.decode(x or b"").decode("utf-8", "replace") for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(text, pa.string())], names=[*b.schema.names[1:], "text"])

    return encoded.select("ids", *keep).mapInArrow(run, f"{fields}, text string")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return encode_documents(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, ["doc_id"], digests=True)
