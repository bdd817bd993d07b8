"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.exact_dedup import exact_dedup
from tilewright.llm.jaccard import near_dedup
from tilewright.llm.mixing import mix
from tilewright.llm.packing import default_vocab, pack
from tilewright.llm.quality import quality_filter
from tilewright.llm.shared import Workspace, load

#: Near duplicates: shingles of five words, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's fences. Null and empty texts fail the base; null languages and sources
    are groups of their own; equal rows are judged alike and all stay or go; extra columns pass through. No documents give none."""
    return quality_filter(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, blanks aside, the row with the smallest doc_id. Null texts count as empty, a null doc_id comes last, of
    rows that tie in doc_id one stays; extra columns pass through. No documents give none."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest doc_id. Texts without words link with nothing and stay; long texts
    are compared whole; extra columns pass through. No documents give none."""
    return near_dedup(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it is taken. Null sources are one source, texts without words have size 0, rows without doc_id
    are drawn by their text; extra columns pass through. No documents give none."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each copy with its place. A null text is empty and one token long; texts beyond a sequence are cut;
    repeated rows are packed as often as they come; other columns are left out. No documents give no pieces."""
    return pack(docs, default_vocab())


STAGES = [
    ("quality rules", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_to_weights),
    ("best-fit packing", pack_sequences),
]

#: Repeated windows, blocks of shingles and tokens are not for SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that come through all stages, with their places in sequences."""
    ws = Workspace(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.stage(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
