"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. Stages read only their
predecessor's rows; all but the last return the columns of `documents`. In a stage that filters, what is dropped is: documents whose language can't be
told; all but the first of equal texts; all but the first of each group of near copies.

Every stage takes nulls in any column, empty tables, repeated rows, and further columns of any name, which it carries along unread.
- language ID: texts that are null or have no letters go; a null lang teaches nothing; without any lang, texts with letters stay.
- exact dedup: a null text is empty; equal texts are those that differ in white space only; the smallest doc_id stays, a null one only if there's no
  other; of repeated rows one stays.
- SimHash near-dedup: near means 2 of 64 bits at most, on 3-word shingles in lower case; a null or empty text has fingerprint 0 and is near like any other;
  what stays is chosen as above.
- mixing: a null text has no words; a null source is a source; repeated rows and null doc_ids share one draw.
- BPE: a null text has no tokens; a document that the mix holds twice is encoded twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, language, mixing, simhash
from tidemark.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told; learns from their labels."""
    return language.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of equal texts."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of each group of near copies."""
    return simhash.distinct_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target asks for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, with digests of the ids and of the text they decode to."""
    return bpe.round_trip(docs, bpe.default_vocabulary(), with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: No SQL expresses language ID or BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
