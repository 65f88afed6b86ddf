import numpy as np
import pytest
import xxhash

from loamwork.llm import simhash
from loamwork.llm.common import components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """The least index reachable from each."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    least = brute_components(fps)
    want = {(r.doc_id, f"{f:016x}", rows[i].doc_id) for r, f, i in zip(rows, fps, least, strict=True)}
    assert {tuple(r) for r in simhash.op7_simhash(spark, folder).collect()} == want


@pytest.mark.parametrize("text", [None, "", " \t\x0b\x0c\r\n", "One", "ONE two", "É é a", "a\xa0b c d", "x\x1cy z w", "a b c " * 3000, "\U0001f600 b c d e"])
def test_fingerprints(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_pair_within_the_radius_meets(radius):
    rng = np.random.default_rng(0)
    masks = simhash.masks(radius)
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(flips & m == 0 for m in masks)


def test_hot_buckets(spark, monkeypatch):
    """Large buckets take another way to the same links."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(120)})
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = brute_components(fps)
    for limit in (256, 4, 0):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        root = {r.node: r.root for r in components(simhash.links(rows)).collect()}
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        groups = {}
        for f, w in zip(signed, want, strict=True):
            groups.setdefault(w, set()).add(root.get(f, f))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_keep_one(spark, docs, as_table):
    rows = docs((5, "a b c d"), (3, "A b c  d"), (3, "A b c  d"), (7, None), (9, ""), (None, "a b c d"), (None, "only here it is"), (11, "other words here now"))
    got = {(r.doc_id, r.component_id) for r in simhash.op7_simhash(spark, as_table(rows)).collect()}
    assert got == {(5, 3), (3, 3), (7, 7), (9, 7), (None, 3), (None, None), (11, 11)}
    kept = simhash.keep_one(rows.withColumnRenamed("lang", "row_hash").withColumnRenamed("source", "nth"))
    assert kept.columns == ["doc_id", "text", "row_hash", "nth", "n_chars"]
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("11", "other words here now"), ("3", "A b c  d"), ("7", None), ("None", "only here it is")]
    assert simhash.keep_one(rows.limit(0)).count() == 0
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
