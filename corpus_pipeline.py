"""A training-corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage works on all that the stage before kept. The first four return the columns of documents; the last returns packed
pieces. Rows are judged each by its own text, also where doc_ids repeat or are null; other columns may have any names; empty tables
stay empty.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import packing, quality, simhash, substring, toxicity
from lathe.llm.common import crc_mod, staged, table
from lathe.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; failing lines leave the others."""
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from labelled documents of this stage's input that are not held out; null
    labels and texts teach nothing."""
    model = toxicity.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, threshold=0.7)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, a similarity of 0.8 or more) stays: the smallest doc_id, one
    without a doc_id only where the group has no other."""
    return simhash.keep_first_like(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words that an earlier document, or an earlier place of the same one, has leave the text; null texts stay null."""
    return substring.keep_first_passages(docs, size=20)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2,048; a null or empty text is its end alone."""
    return packing.pack(docs, Path(tokenizer("byte_bpe_50k.json")).read_bytes(), window=2048, end=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: Fingerprints and tokens are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
