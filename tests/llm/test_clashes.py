"""Extra columns that are called like what the operators make, and very long texts: results are as without them."""

import pytest

from loamwork.llm import queries

NAMES = "ids head tally n_tokens start gram context sd_hash sd_spans fp component_id fingerprint tie run guest t e size source_size target taken rate q_text q_lang kept base_failed n_words set_id row_ term at part block doc_ids n_removed".split()
TEXTS = [(1, "a few words of text, and a mark."), (2, "a few words of text, and a mark!"), (3, None), (3, ""), (None, "no id " * 40), (5, "long text without end " * 60_000), (6, "x" * 300_000), (1, "a few words of text, and a mark.")]


@pytest.mark.parametrize("name", ["op1_source_mixing", "op2_suffix_dedup", "op3_token_files", "op5_byte_bpe", "op7_simhash", "op9_imatch", "op10_quality_rules"])
def test_extra_columns(spark, docs, tmp_path, name):
    d = docs(*TEXTS)
    d.write.parquet(str(tmp_path / "plain" / "documents.parquet"))
    d.selectExpr("*", *(f"'{n}' AS {n}" for n in NAMES)).write.parquet(str(tmp_path / "wide" / "documents.parquet"))
    plain, wide = (queries.queries()[name](spark, str(tmp_path / k)) for k in ("plain", "wide"))
    assert plain.columns == wide.columns
    rows = sorted(map(repr, plain.collect()))
    assert rows == sorted(map(repr, wide.collect())) and len(rows) == len(TEXTS)
