"""From raw documents to a training mixture: STAGES, each (spark, docs, sf_dir) -> DataFrame.

Each stage gets the rows that its predecessor kept, written as Parquet and read again, and
returns a part of them with their columns, whatever their names. Nulls in any column are
values like others: a null text is an empty one, rows of a null id are one document. Long
texts are judged whole. Of an empty table, every stage returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import contamination, exact_dedup, mixing, quality, simhash
from quern.session import discard, materialise, scratch, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: each row by its own text, whatever its
    id, so repeated rows stay or go together. Without usable labels every score is 0.5 and
    none is accepted."""
    return quality.keep_accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id (null ids rank
    lowest); of rows that repeat id and text, one."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints: the one with the smallest id.
    Rows that repeat an id are one document and stay or go together; rows without an id stay
    unless a document with one is in their component."""
    return simhash.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows that repeat an id, the null id
    included, are one document. An empty benchmark removes nothing."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights, by a number drawn from id and text: rows that
    repeat both share their fate. Null sources and languages count as values without a target."""
    return mixing.sample_mix(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("source_mixing", mix_stage),
]

#: Trained weights, XXH64 fingerprints, alignments and raking are beyond SQL; tests/llm
#: holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents. What a stage writes on its way is deleted when its
    output is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch():
            made = stage(spark, docs, sf_dir)
            docs = materialise(made, f"pipeline-{name}", keep=True)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
