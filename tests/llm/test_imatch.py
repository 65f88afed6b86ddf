import hashlib
import re
import struct
from collections import Counter

import pytest
import regex
import xxhash

from loamwork.llm import imatch


def edited(rows):
    """(doc_id, edited text, next text) of each row, by descending doc_id, null last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        n = len(t) // 3
        out.append((i, t[: len(t) - n] + after[:n], after))
    return out


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: r for r in imatch.op9_imatch(spark, folder).collect()}
    text = dict(rows)
    for i, e, _ in edited(rows):
        assert got[i].n_chars == len(text[i]) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    by_text = {}
    for i, r in got.items():
        assert by_text.setdefault(text[i], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    edits = {i: e for i, e, _ in edited(rows)}
    for i, r in got.items():
        assert by_text.get(edits[i], r.edited_fingerprint) == r.edited_fingerprint
        assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
    near = sorted(r.near_edited for r in got.values())
    far = sorted(r.near_next for r in got.values())
    assert near[len(near) // 10] > far[len(far) * 9 // 10]


@pytest.mark.parametrize("run", [3000, 1])
def test_odd_rows(spark, docs, as_table, monkeypatch, run):
    monkeypatch.setattr(imatch, "RUN", run)
    rows = [(5, "five words of a text"), (-7, "minus"), (3, None), (4, ""), (9, "\U0001f600é" * 7), (12, "!?"), (20, "five words of a text"), (None, "nobody's text")]
    got = {r.doc_id: r for r in imatch.op9_imatch(spark, as_table(docs(*rows))).collect()}
    assert len(got) == len(rows)
    for i, e, _ in edited(rows):
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    assert got[5].fingerprint == got[20].fingerprint and got[3].fingerprint == got[4].fingerprint
    assert got[4].edited_fingerprint == got[4].fingerprint and got[4].near_next == 1  # empty, and so is what follows


def test_repeats_one_and_none(spark, docs, as_table):
    same = imatch.fingerprint_report(docs((1, "a b c"), (1, "a b c"), (1, "other"))).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 2
    one = imatch.fingerprint_report(docs((1, "alone in the world"))).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"alone in the" + b"alone ").hexdigest()
    assert imatch.fingerprint_report(docs((1, "a")).limit(0)).count() == 0


def test_lexicon_is_bounded(spark, docs):
    rows = docs(*((i, " ".join(f"w{i * j % 97}" for j in range(40))) for i in range(60)))
    assert len(imatch.lexicon(rows, 0.0, 1.0, 10)) <= 10
    df = {}
    for i in range(60):
        for w in {f"w{i * j % 97}" for j in range(40)}:
            df[w] = df.get(w, 0) + 1
    assert len(imatch.lexicon(rows, 0.1, 0.3, 10**6)) == sum(6 <= n <= 18 for n in df.values())


def test_native(spark):
    plan = imatch.op9_imatch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_whole_band_is_kept(spark, docs):
    """Long documents (2,200 distinct terms each) do not narrow the band; 400 terms of all documents are out of it."""
    common = " ".join(f"all{k}" for k in range(400))
    rows = docs(*((i, common + " " + " ".join(f"w{k}" for k in range(18_000) if (k * 7 + i) % 10 == 0)) for i in range(60)))
    assert len(imatch.lexicon(rows)) == 18_000


def test_a_large_lexicon_is_joined(spark, docs, monkeypatch):
    """The same results whether the lexicon is a literal or a table; documents and terms repeat, some have none of it."""
    rows = docs(*((i // 2, " ".join(f"w{i * j % 197}" for j in range(i % 30))) for i in range(60)), (None, None), (3, "!?"), (99, "the"))
    want = sorted(map(repr, imatch.fingerprint_report(rows).collect()))
    monkeypatch.setattr(imatch, "MAX_LEXICON", 5)
    assert sorted(map(repr, imatch.fingerprint_report(rows).collect())) == want


def test_signatures(spark):
    """Each subset's signature, from the definition."""
    words = sorted([-(1 << 63), -1, 0, 63, 64, 16_383, (1 << 63) - 1, *(i * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63) for i in range(500))])
    got = spark.createDataFrame([(words,)], "t array<long>").select(imatch.fingerprint("t")).first()[0]
    parts = [[x for x in words if x % 64 == j] for j in range(64)] + [[x for x in words if (x >> 8) % 1024 == j] for j in range(64)]
    hashes = [r[0] for r in spark.createDataFrame(list(enumerate(parts)), "j int, f array<long>").orderBy("j").selectExpr("lpad(lower(hex(1 + pmod(xxhash64(f), 65535))), 4, '0')").collect()]
    assert got == "".join(h if p else "0000" for h, p in zip(hashes, parts, strict=True))


def brute(rows):
    """fingerprint, edited_fingerprint, near_edited and near_next of each row by descending doc_id, from the definitions."""

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def terms(text):
        return sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w})

    def signature(part):
        h = 42
        for x in part:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return f"{1 + signed(h) % 65535:04x}" if part else "0000"

    df = Counter(x for _, t in rows for x in terms(t or ""))
    words = {x for x, n in df.items() if imatch.LOW * len(rows) <= n <= max(imatch.HIGH * len(rows), 1)}

    def mark(text):
        t = terms(text) or [signed(xxhash.xxh64_intdigest(text.encode(), 42))]
        t = [x for x in t if x in words] or t
        return [signature([x for x in t if x % 64 == j]) for j in range(64)], [signature([x for x in t if (x >> 8) % 1024 == j]) for j in range(64)]

    def like(a, b):
        if a == b:
            return 1.0
        shares = [0.0]
        for x, y, enough in zip(a, b, (1, 8), strict=True):
            some = [(p, q) for p, q in zip(x, y, strict=True) if (p, q) != ("0000", "0000")]
            if len(some) >= enough:
                shares.append(sum(p == q for p, q in some) / len(some))
        return max(shares)

    text = lambda m: "".join(m[0] + m[1])
    own = {i: t or "" for i, t in rows}
    return {i: (text(mark(own[i])), text(mark(e)), like(mark(own[i]), mark(e)), like(mark(own[i]), mark(after))) for i, e, after in edited(rows)}


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(rows)
    for r in imatch.op9_imatch(spark, folder).collect():
        assert (r.fingerprint, r.edited_fingerprint) == want[r.doc_id][:2]
        assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][2:])


def test_runs_follow_ranks(spark, docs, monkeypatch):
    """Far-off, repeated and missing doc_ids spread over runs as others do, and order is kept."""
    monkeypatch.setattr(imatch, "RUN", 10)
    ids = [*range(400), 10**12, (1 << 63) - 1, -(1 << 63), *[77] * 300, *[None] * 300]
    rows = [(i, f"text {k} of {len(ids)}") for k, i in enumerate(ids)]
    placed = imatch.neighbours(docs(*rows)).filter("guest = 0").collect()
    sizes = Counter(r.run for r in placed)
    assert len(placed) == len(rows) and max(sizes.values()) <= 40 and len(sizes) > 60
    order = sorted(placed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    assert [r.run for r in order] == sorted((r.run for r in order), reverse=True)
    want = {r.text: after.text for r, after in zip(order, [*order[1:], order[0]], strict=True)}
    shas = {r.edited_sha256 for r in imatch.fingerprint_report(docs(*rows)).collect()}
    assert shas == {hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for t, n in want.items()}


def test_very_long_text_and_columns_that_clash(spark, docs):
    rows = docs((1, "word another " * 400_000), (2, "a b c"), (3, "a b c d e f")).selectExpr("doc_id", "text", "lang AS run", "source AS tie", "n_chars AS t", "1 AS guest", "2 AS fingerprint", "3 AS term")
    got = {r.doc_id: r for r in imatch.fingerprint_report(rows).collect()}
    assert len(got) == 3 and got[1].n_chars == 5_200_000
