"""From raw documents to packed training sequences: five stages over the corpus operators.

Each stage takes what its predecessor kept as ``docs``; all but the last
return the columns of ``documents``.

Cases: nulls in any column, empty and very long texts, ties, repeated rows
and other columns go through every stage as its operator says; an empty table
gives an empty result.  Stages pass other columns on, the last one drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lemniscate.llm.common import discard, scratch, stored, table
from lemniscate.llm.line_dedup import dedup_lines
from lemniscate.llm.packing import pack
from lemniscate.llm.pii import masked
from lemniscate.llm.quality import keep_good
from lemniscate.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules, or their host's verdict, go.

    A null text counts as empty and goes, as having too few words; a null
    source is a host of its own; repeated rows stay or go alike.
    """
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each host are cut from the texts.

    Every row stays, with an empty text where all its lines go; a null text
    stays null; repeated rows count as one page of their host.
    """
    return dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id.

    Texts without a word, null ones too, are one group; of repeated rows one
    stays; a row without doc_id stays where its group has no other.
    """
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked.

    A null text stays null, texts without personal data stay as they are, and
    repeated rows are masked alike.
    """
    return masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids in sequences of at most 1024.

    A null text holds the end id alone; repeated rows are packed as often as
    they are given; ties in length go by doc_id and ids.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii", pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what each returns is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch():
            docs = stored(stage(spark, before, sf_dir), f"stage-{name}", lasting=True)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenisation, fingerprints and packing can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None
