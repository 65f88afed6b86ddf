import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline as pipeline
from loamwork.llm import near_copies


def sets(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return out


def brute_kept(rows):
    """The doc_ids that stay, by comparing all pairs."""
    rows = sorted(rows)
    s = sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def planted():
    """Originals, and copies of them with a word changed here and there, some just over and some just under the line."""
    rng = random.Random(3)
    out = []
    for k in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((6, 30, 120, 400)))]
        out.append(" ".join(words))
        for edits in (1, 2, 3, 5, 9):
            copy = list(words)
            for i in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[i] = "changed"
            out.append(" ".join(copy))
    return [(i * 7 % len(out), t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("together", "bits"), [(1000, 1 << 21), (1, 8)])
def test_edited_copies_go(spark, docs, monkeypatch, together, bits):
    monkeypatch.setattr(near_copies, "TOGETHER", together)
    monkeypatch.setattr(near_copies, "FILTER", bits)
    rows = planted()
    got = sorted(r.doc_id for r in dict(pipeline.STAGES)["SimHash near-dedup"](spark, docs(*rows), "").collect())
    assert got == brute_kept(rows) and len(got) < len(rows) * 0.7


def test_documents_against_all_pairs(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(r.doc_id for r in near_copies.keep_one(d).collect()) == brute_kept([(r.doc_id, r.text) for r in d.collect()])


def test_odd_rows(spark, docs):
    rows = docs((5, "a b c d"), (3, "A b c  d"), (3, "A b c  d"), (7, None), (9, ""), (None, "a b c d"), (None, "only here it is"), (11, "other words here now"))
    kept = near_copies.keep_one(rows.withColumnRenamed("lang", "row_hash").withColumnRenamed("source", "nth"))
    assert kept.columns == ["doc_id", "text", "row_hash", "nth", "n_chars"]
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("11", "other words here now"), ("3", "A b c  d"), ("7", None), ("None", "only here it is")]
    assert near_copies.keep_one(rows.limit(0)).count() == 0


def test_long_texts_that_share_passages_are_not_compared(spark, docs, monkeypatch):
    """Texts of 6,000 words, two by two alike in five sixths of them: their parities tell, no whole sets are shuffled. A
    real copy is found among them."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for k in range(0, 8, 2):
        same = [word() for _ in range(5000)]
        rows += [(k + i, " ".join([*same, *(word() for _ in range(1000))])) for i in range(2)]
    rows.append((8, f"{rows[3][1]} and some more words"))
    counts, inner = [], near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, name: counts.append((name, inner(df, name).count())) or inner(df, name))
    got = sorted(r.doc_id for r in near_copies.keep_one(docs(*rows)).collect())
    assert got == brute_kept(rows) == list(range(8))
    assert sum(n for name, n in counts if name == "near_pairs") == 1


def test_parities_never_differ_in_more_bits_than_the_sets():
    rng = random.Random(4)
    sets_ = []
    for n in (1, 900, 1023, 1024, 1025, 1200, 2048, 2500, 3000):
        sets_.append(near_copies.shingles(" ".join(f"w{rng.randrange(30)}" for _ in range(n + 4)).encode()))
    bits = near_copies._Parities([near_copies._parities(s) for s in sets_])
    for i, s in enumerate(sets_):
        at = [j for j, z in enumerate(sets_) if j != i and 5 * min(len(s), len(z)) >= 4 * max(len(s), len(z))]
        for j, apart in zip(at, bits.apart(i, np.array(at, dtype=int)), strict=True):
            differ = len(set(s.tolist()) ^ set(sets_[j].tolist()))
            assert apart <= differ and (apart - differ) % 2 == 0


def test_simhash_pairs_against_brute_force(spark, docs):
    """Fingerprints of five-word shingles, and groups of those within two bits, as a plain computation has them."""
    rng = random.Random(9)
    rows = []
    for k in range(20):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice((3, 40, 800)))]
        rows += [(4 * k + i, " ".join([*words[: len(words) - i], *["end"] * i])) for i in range(4)]
    want = {}
    for i, s in zip((r[0] for r in rows), sets([t for _, t in rows]), strict=True):
        h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in s]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    table = near_copies.slim(docs(*rows), ["doc_id"], 5).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in table} == want
    group = {r.set_id: r.set_id for r in table}
    fp = {r.set_id: want[r.doc_id] for r in table}

    def merged(pairs):
        g = dict(group)
        for a, b in pairs:
            x, y = g[a], g[b]
            g = {k: min(x, y) if v in (x, y) else v for k, v in g.items()}
        return g

    frame = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in fp.items()], "set_id long, fp long")
    got = [(r.a, r.b) for r in near_copies.simhash_pairs(frame).collect()]
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    assert near and merged(got) == merged(near)


def near_and_apart(n=70):
    """Copies of a text with one word changed, each alike to each other copy, and parts of the text, whose sets are smaller
    and so are not alike to any. The parts' ids are below those of all copies, so they are the least of every group."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(100)]
    copies = []
    for k in range(n):
        copy = list(words)
        copy[rng.randrange(10, 90)] = f"new{k}"
        copies.append(" ".join(copy))
    low = min(near_copies._id(near_copies.shingles(t.encode())) for t in copies)
    parts = []
    for start in range(0, 41, 10):
        at = (f"x{k} {' '.join(words[start : start + 60])}" for k in range(100_000))
        parts.append(next(t for t in at if near_copies._id(near_copies.shingles(t.encode())) < low))
    return list(enumerate([*copies, *parts]))


def test_a_group_takes_about_as_many_comparisons_as_it_has_members(spark, docs, monkeypatch):
    rows = near_and_apart()
    counts, inner = [], near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, name: counts.append((name, inner(df, name).count())) or inner(df, name))
    got = sorted(r.doc_id for r in near_copies.keep_one(docs(*rows)).collect())
    assert got == brute_kept(rows) and got[0] == 0
    assert sum(n for name, n in counts if name == "near_pairs") < 4 * len(rows)


@pytest.mark.parametrize("more", [1, 2, 8])
def test_rounds_end_with_every_pair_tried(spark, docs, monkeypatch, more):
    """Long texts just under the line, whose parity bits show few of them apart: these are compared all, in rounds."""
    monkeypatch.setattr(near_copies, "MORE", more)
    words = [f"w{i}" for i in range(1028)]
    rows = []
    for k in range(7):
        copy = list(words)
        for i in range(13):
            copy[10 + 10 * (7 * i + k)] = f"new{k}_{i}"
        rows.append((k, " ".join(copy)))
    rows.append((7, f"{rows[6][1]} and"))
    s = [near_copies.shingles(t.encode()) for _, t in rows[:7]]
    bits = near_copies._Parities([near_copies._parities(x) for x in s])
    unsure = {tuple(sorted((near_copies._id(s[i]), near_copies._id(s[j])))) for i in range(7) for j in range(i) if 9 * bits.apart(i, np.array([j]))[0] <= 2048}
    assert len(unsure) > 15
    compared, inner = [], near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, name: compared.append((name, inner(df, name).collect())) or inner(df, name))
    got = sorted(r.doc_id for r in near_copies.keep_one(docs(*rows)).collect())
    assert got == brute_kept(rows) == list(range(7))
    pairs = [(r.a, r.b) for name, x in compared if name == "near_pairs" for r in x]
    assert len(pairs) == len(set(pairs)) and unsure <= set(pairs)
