import hashlib
from collections import Counter

import numpy as np
import pytest

from loamwork.llm import suffix_dedup as sd


def brute(texts, length=200):
    """For each text, the bytes that a string of `length` covers which starts anywhere else."""
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_later(texts, length=200):
    """What is left of each text when later copies go."""
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        out.append(bytes(np.frombuffer(t, dtype=np.uint8)[~gone]))
    return out


def check(spark, rows, folder):
    texts = [(t or "").encode() for _, t in rows]
    want = Counter((i, *w) for (i, _), w in zip(rows, brute(texts), strict=True))
    assert Counter(tuple(r) for r in sd.op2_suffix_dedup(spark, folder).collect()) == want


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()], folder)


def odd_texts():
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcdefgh \n"), n))
    p, q, r = letters(230), letters(200), letters(199)
    return [
        (1, letters(50) + p + letters(40)), (2, p + letters(30) + p), (3, q), (4, letters(10) + q), (5, r), (6, "x" + r), (7, None), (8, ""), (9, "z" * 1000), (10, "ab" * 300),
        (11, letters(3000)), (12, "é" * 150), (13, "é" * 150 + "a"), (14, "same text " * 30), (14, "same text " * 30), (14, "same text " * 30 + "!"), (None, p[:215]), (None, p[:215]),
        (15, q[:100] + p[100:] + q), (16, letters(100) + p[5:215] + letters(100) + q[:199]), (17, "\U0001f600" * 60), (18, "a" + "\U0001f600" * 60),
    ]


def test_odd_rows(spark, docs, as_table):
    rows = odd_texts()
    check(spark, rows, as_table(docs(*rows).repartition(3)))


def test_large_buckets_give_the_same(spark, docs):
    rows = docs(*odd_texts())
    small, large = (sorted(map(repr, sd.removal_report(rows, bucket=b).collect())) for b in (7000, 1))
    assert small == large
    small, large = (sorted(map(repr, sd.remove_repeats(rows, bucket=b).collect())) for b in (7000, 1))
    assert small == large


def test_first_copies_stay(spark, docs):
    rows = [(i, t) for i, t in odd_texts() if i is not None and t is not None and i != 14]
    got = {r.doc_id: r for r in sd.remove_repeats(docs(*rows).withColumnRenamed("lang", "sd_hash").withColumnRenamed("source", "sd_spans")).collect()}
    want = brute_later([t.encode() for _, t in rows])
    for (i, _), w in zip(rows, want, strict=True):
        assert got[i].text == w.decode("utf-8", "ignore") and got[i].n_chars == len(got[i].text)


@pytest.mark.parametrize("length", [8, 33, 100, 200, 255, 256])
def test_suffix_order_and_longest_previous_factors(length):
    rng = np.random.default_rng(length)
    windows = [rng.choice(list(b"ab"), rng.integers(length, length + 25)).astype(np.uint8).tobytes() for _ in range(10)]
    windows += [w[:length] for w in windows[:5]]
    owner, at, lcp = sd.suffix_order(windows, length)
    strings = [w[i : i + length] for w in windows for i in range(len(w) - length + 1)]
    assert owner.tolist() == [k for k, w in enumerate(windows) for _ in range(len(w) - length + 1)]
    assert at.tolist() == sorted(range(len(strings)), key=lambda i: (strings[i], i))

    def common(x, y):
        return next((i for i, (a, b) in enumerate(zip(x, y, strict=True)) if a != b), length)

    assert lcp.tolist() == [0] + [common(strings[i], strings[j]) for i, j in zip(at, at[1:], strict=False)]
    lpf = sd.longest_previous(at, lcp)
    assert lpf.tolist() == [max((common(s, e) for e in strings[:i]), default=0) for i, s in enumerate(strings)]


@pytest.mark.parametrize("order", [range(500), range(499, -1, -1), [i ^ 1 for i in range(500)], [(i * 181) % 500 for i in range(500)]])
def test_smaller_positions_in_any_order(order):
    at, lcp = np.array(order), np.random.default_rng(1).integers(0, 9, 500).astype(np.int32)
    lcp[0] = 0
    want = np.zeros(500, dtype=int)
    for i in range(500):
        for step in (-1, 1):
            j, least = i, 99
            while 0 <= j + step < 500:
                least = min(least, lcp[max(j, j + step)])
                j += step
                if at[j] < at[i]:
                    want[at[i]] = max(want[at[i]], least)
                    break
    assert sd.longest_previous(at, lcp).tolist() == want.tolist()


def test_segments_of_long_texts(spark, docs, monkeypatch):
    """The same results when texts are anchored in short segments; repeats stand across their edges."""
    rows = odd_texts() + [(40, "".join(t or "" for _, t in odd_texts())), (41, "q" * 777 + "".join(t or "" for _, t in odd_texts())), (42, "w" * 5000)]
    want = Counter((i, *w) for (i, _), w in zip(rows, brute([(t or "").encode() for _, t in rows]), strict=True))
    for block in (1_000_000, 321):
        monkeypatch.setattr(sd, "BLOCK", block)
        texts = [(t or "").encode() for _, t in rows]
        for of, at, parts in sd._text_blocks(texts, 200):
            assert all(texts[i][k : k + len(p)] == p for i, k, p in zip(of, at, parts, strict=True))
        assert Counter(tuple(r) for r in sd.removal_report(docs(*rows)).collect()) == want


def test_a_very_long_text(spark, docs):
    rng = np.random.default_rng(8)
    long = "".join(map(chr, rng.integers(97, 123, 6_000_000)))
    got = {r.doc_id: r for r in sd.removal_report(docs((1, long), (2, "x" * 100 + long[3_000_000:3_000_400]), (3, "a"))).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[3].n_removed) == (400, 1, 400, 0)


def test_empty(spark, docs):
    none = docs((1, "a")).limit(0)
    assert sd.removal_report(none).count() == 0 and sd.remove_repeats(none).count() == 0
