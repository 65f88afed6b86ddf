from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents out of (doc_id, text) or (doc_id, text, lang, source)."""

    def make(*rows):
        full = [(*r, *("en", "s")[len(r) - 2 :]) for r in rows]
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], DOCS)

    return make


@pytest.fixture
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def as_table(tmp_path):
    """A folder that holds the frame as the table named."""

    def write(df, name="documents"):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
