"""The corpus pipeline: quality rules, line dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``; where a
stage changes a text, ``n_chars`` follows it. The operators' docstrings say what becomes of null
and empty texts, ties and repeated rows: only the quality rules and the near dedup drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.llm.common import read, step_table
from courtline.llm.line_dedup import line_dedup
from courtline.llm.near_dedup import near_dedup
from courtline.llm.packing import pack
from courtline.llm.pii import sanitise
from courtline.llm.quality import apply_quality_rules


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and so do lines above the limits."""
    return _counted(apply_quality_rules(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages of three lines or more go."""
    return _counted(line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at a similarity of 0.8 on five-word shingles, the smallest id stays."""
    return near_dedup(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is generalised to its kind, terms that disclose it are removed."""
    return _counted(sanitise(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their places in the sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates),
          ("personal_data", personal_data), ("packing", packing)]

# Tokenising, near-duplicate search and packing are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = step_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
