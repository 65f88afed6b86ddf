import sys
from collections import Counter

import public_tokenizers as public
import pytest

import corpus_pipeline as pipeline
from loamwork.durable import written
from loamwork.llm import bpe, mixing

from .test_near_copies import brute_kept
from .test_quality import brute
from .test_suffix_dedup import brute_later


def test_stages_against_brute_force(spark):
    """Every stage on the one before, and the whole on the last."""
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    ok = {r[0] for r in brute([(r.doc_id, r.text, r.lang) for r in rows]) if r[7]}
    rows = [r for r in rows if r.doc_id in ok]
    stay = set(brute_kept([(r.doc_id, r.text) for r in rows]))
    rows = [r for r in rows if r.doc_id in stay]
    texts = [t.decode("utf-8", "ignore") for t in brute_later([r.text.encode() for r in rows])]
    frame = spark.createDataFrame([(r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(rows, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.copies for r in mixing.mixing_plan(frame).collect()}
    ranks = bpe.Ranks.read(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    want = Counter({(r.doc_id, r.lang, r.source, bytes(x)): copies[r.doc_id] for r, x in zip(rows, ranks.encode(texts), strict=True) if copies[r.doc_id]})
    got = pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.lang, r.source, bytes(r.ids)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


@pytest.mark.parametrize("at", range(len(pipeline.STAGES)))
def test_columns_odd_rows_and_empty(spark, docs, at):
    d = docs((1, None, None, None), (1, None, None, None), (None, "x y", "en", "s"), (2, "", "xx", None), (3, "w " * 30_000, "de", "s"))
    out = pipeline.STAGES[at][1](spark, d, "")
    assert out.count() >= 0 and pipeline.STAGES[at][1](spark, d.limit(0), "").count() == 0
    if at < len(pipeline.STAGES) - 1:
        assert out.columns == d.columns


def test_columns_that_clash(spark, docs):
    """Columns called like what the stages use within come through them all."""
    d = docs(*((i, f"word {i} of some text that is long enough to stay here, and the end of it is {i}. " * 3, "en", "s") for i in range(12)))
    names = "set_id row_ key_ sd_hash sd_spans s_id q_row q_text kept size rate copy row_hash nth token group bits at fp".split()
    wide = d.selectExpr("*", *(f"doc_id * 2 AS {n}" for n in names))
    out = wide
    for name, stage in pipeline.STAGES[:-1]:
        out = written(stage(spark, out, ""), name.replace(" ", "-"))
        assert out.columns == wide.columns
    assert all(r[n] == 2 * r.doc_id for r in out.collect() for n in names)
    assert pipeline.STAGES[-1][1](spark, out, "").count() == out.count()


def test_entry_without_the_subpackage():
    """What is left imports and answers when the subpackage and the pipeline are gone."""
    import importlib

    import __spark_entry__ as entry

    held = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("loamwork.llm") or k == "corpus_pipeline"}
    sys.modules["corpus_pipeline"] = None
    try:
        gone = importlib.reload(entry)
        assert gone.llm is None and not any(k.startswith("op") or k == "pipeline" for k in gone.queries())
    finally:
        del sys.modules["corpus_pipeline"]
        sys.modules.update(held)
        importlib.reload(entry)
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in entry.queries()} and "pipeline" in entry.queries()


