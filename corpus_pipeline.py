"""The corpus pipeline: select, deduplicate, strip repeats, decontaminate and pack `documents`.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the columns
of documents. A stage settles what it decides and deletes the tables that led to it, as no one else has seen them; what
its result reads is the caller's to delete, as run() does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressloom.llm import decontamination, near_dedup, packing, quality_classifier, suffix_dedup
from pressloom.llm.queries import tokenizer_path
from pressloom.llm.tables import read, scratch, settle

#: Texts of this similarity in percent, on shingles of five words, or more are near duplicates.
SIMILAR = 80
#: Passages of over 50 words that repeat go, however few bytes they have.
PASSAGE = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labels keeps. Texts without words, null ones too, go; rows that tie
    at the cut stay; without labels all others stay."""
    return quality_classifier.kept(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group. Texts without words and rows without an id all stay; of rows that
    repeat an id one stays."""
    return near_dedup.deduplicated(docs, percent=SIMILAR)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat. A null text stays null, one that only repeats becomes empty; rows
    that repeat an id are each judged by their own text."""
    return suffix_dedup.stripped(docs, words=PASSAGE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts stay; items without text or id match nothing."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows. A null or empty text is one token, the end; each row is a document, repeats too."""
    return packing.pieces(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontaminate", decontaminate), ("pack", pack)]
#: SQL can't express the classifier's and the tokenizer's stages; tests/llm holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what a stage wrote on its way is deleted with its input."""
    docs, held = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with scratch(spark) as made:
            docs = settle(stage(spark, docs, sf_dir))
            made[:], held = [*made[:-1], *held], made[-1:]
    return docs
