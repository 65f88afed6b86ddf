import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loamwork.llm import bpe, token_files

PATH, JSON = public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n", "don't I'LL we've", "x1 2y 33", "<|endoftext|> a", "hi <|endoftext|> there", "x<|endoftext|><|endoftext|>", "\0 \0a", "é é", "\U0001f600\U0001f600 \U0001f468‍\U0001f469", "a\xa0b \x85c\x1cd", " x  y", "中文 字", "1.2,3", "end.", "end. ", "aaaa" * 200, "ab " * 400, "﻿", "Ⅷ ² ½ x", "a,b c, d."]


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks.read(PATH, public.PATTERN)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def ids(data, kind="<u4"):
    return np.frombuffer(data, dtype=kind).tolist()


def column(texts):
    return pa.array(texts, pa.large_string())


def test_odd_texts(encoding, ranks, tokenizer):
    enc = token_files.encoder(JSON)
    assert [ids(x) for x in ranks.encode(ODD)] == [encoding.encode_ordinary(t) for t in ODD]
    assert [ids(x, enc.dtype) for x in enc.encode(column(ODD))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [ranks.decode(x).decode() for x in ranks.encode(ODD)] == ODD


def test_every_character(encoding, ranks, tokenizer):
    enc = token_files.encoder(JSON)
    texts = [f"x{chr(c)}y {chr(c)}1 {chr(c)}{chr(c)} ." for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    assert [ids(x) for x in ranks.encode(texts)] == encoding.encode_ordinary_batch(texts, num_threads=2)
    assert [ids(x, enc.dtype) for x in enc.encode(column(texts))] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t.,'sabcdetTHE1é"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(encoding, ranks, tokenizer, text):
    assert ids(ranks.encode([text])[0]) == encoding.encode_ordinary(text)
    enc = token_files.encoder(JSON)
    assert ids(enc.encode(column([text]))[0], enc.dtype) == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_where_no_match_crosses(encoding, ranks, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 50)
    text = "Some words, and more; 12 numbers  double spaces\n\nlines don't matter. " * 40 + "x" * 500 + "  y z" * 30
    assert ids(ranks.encode([text])[0]) == encoding.encode_ordinary(text)
    assert "".join(bpe.pieces(text)) == text


def test_replay_against_the_library(encoding, ranks):
    """Many words at once, and caches that turn over."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeinrst"), rng.integers(1, 25))) for _ in range(3000)]
    assert [ids(x) for x in ranks.replay([w.encode() for w in words])] == [encoding.encode_single_piece(w) if hasattr(encoding, "encode_single_piece") else encoding.encode_ordinary(w) for w in words]
    small = bpe.Ranks.read(PATH, public.PATTERN)
    small.known, small.spaced, small.words = bpe.Cache(3), bpe.Cache(3), bpe.Cache(3)
    for t in ["a b c d e f", "a b c xx yy", "q a b", "a b c d e f"]:
        assert ids(small.encode([t])[0]) == encoding.encode_ordinary(t)


def test_file_encoder_caches_that_turn_over(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "UNITS", 4)
    monkeypatch.setattr(token_files, "CACHE", 3)
    small = token_files.Encoder(JSON)
    for block in (["a b c d e f", "b"], ["a b c xx, yy", "q a  b", ""], ["a b c d e f"], ["hi <|endoftext|> there a b"]):
        assert [ids(x, small.dtype) for x in small.encode(column(block))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in block]
        assert len(small.units) <= 4 + 8


def test_query_5(spark, encoding):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {}
    for r in rows:
        x = np.array(encoding.encode_ordinary(r.text), dtype="<u4").tobytes()
        want[r.doc_id] = (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op5_byte_bpe(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_query_5_odd_rows(spark, docs, as_table):
    folder = as_table(docs((1, None), (2, ""), (2, "x y"), (None, "x y"), (3, "long text " * 200_000)))
    got = sorted((str(r.doc_id), r.n_tokens) for r in bpe.op5_byte_bpe(spark, folder).collect())
    assert got[:2] == [("1", 0), ("2", 0)] and len(got) == 5
    encoded = bpe.encode_documents(docs((1, "é\U0001f600 x"), (2, None)).withColumnRenamed("source", "ids"), PATH, public.PATTERN, ["doc_id"])
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, PATH, public.PATTERN, ["doc_id"]).collect()} == {1: "é\U0001f600 x", 2: ""}
    assert bpe.encode_documents(docs((1, "a")).limit(0), PATH, public.PATTERN, ["doc_id"]).count() == 0


def check_files(got, rows, tokenizer):
    """Rows in doc_id order, null last, equal doc_ids by their ids."""
    coded = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    coded.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], dtype="<u2").tobytes()))
    start, want = 0, []
    for i, x in coded:
        want.append((i, start, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
        start += len(x)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_query_3(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check_files(token_files.op3_token_files(spark, folder).collect(), rows, tokenizer)


def test_query_3_odd_rows(spark, docs, as_table, tokenizer, monkeypatch):
    rows = [(5, "five"), (-1, "minus"), (3, None), (3, ""), (4, "same"), (4, "same"), (None, "none"), (4, "other"), (9, "long text, " * 30_000), (10, "<|endoftext|>")]
    check_files(token_files.op3_token_files(spark, as_table(docs(*rows).repartition(3))).collect(), rows, tokenizer)


def test_empty_file(spark, docs, as_table):
    assert token_files.op3_token_files(spark, as_table(docs((1, "a")).limit(0))).count() == 0


def optimal(counts, limit):
    """Package-merge as it is taught: packages are sets of leaves."""
    leaves = sorted((int(c), (i,)) for i, c in enumerate(counts) if c)
    if len(leaves) == 1:
        return 1 * leaves[0][0]
    level = leaves
    for _ in range(limit - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = sorted(leaves + pairs)
    return sum(w for w, _ in level[: 2 * len(leaves) - 2])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=40), st.integers(6, 12))
def test_code_lengths(counts, limit):
    counts = np.array(counts)
    bits = token_files.code_lengths(counts, limit)
    assert ((bits > 0) == (counts > 0)).all() and bits.max(initial=0) <= limit
    if counts.any():
        assert sum(2.0 ** -int(b) for b in bits if b) <= 1
        assert int((bits.astype(int) * counts).sum()) == optimal(counts, limit)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.geometric(0.01, n), 3000) - 1
    code = token_files.Code(token_files.code_lengths(np.bincount(x, minlength=3001)))
    if n:
        data, bits, marks = code.encode(x)
        assert (code.decode(data, marks, n) == x).all() and len(marks) == -(-n // token_files.STEP)
        with pytest.raises(ValueError):
            code.encode(np.array([3000]))
