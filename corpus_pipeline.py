"""The corpus pipeline: raw documents to encoded training text, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamwork.llm import bpe, mixing, near_copies, quality, suffix_dedup
from loamwork.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, likeness of 0.8 or more) stays: that of the least
    doc_id. SimHash finds groups, verified in full; prefix filtering finds the links that fingerprints do not show."""
    return near_copies.keep_one(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of 200 bytes or more go from the texts; the first copy stays, and so does every document."""
    return suffix_dedup.remove_repeats(docs, keep_first=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids (little-endian unsigned 32-bit integers) of each text."""
    import public_tokenizers as public

    return bpe.encode_documents(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, ["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("source mixing", mix),
    ("byte-level BPE", encode),
]

#: Hashing by shingles, suffix order and byte-pair merges have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
