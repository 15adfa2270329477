"""Exact duplicates: rows are grouped by a 128-bit hash of the normalised text, the texts inside
each group are compared byte for byte, and one stable id per group stays.

The comparison is an aggregation keyed by (hash, text): the engine compares the text of every
row with that of its group, and a group of any size has shrunk to one row per map task before
anything is shuffled. Rows find their group through (128-bit hash, SHA-256); if two different
texts ever shared both, the job stops with an error instead of merging them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, digest, step_table


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest",
                 hash128=digest) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. ``keep``: 'smallest' or 'largest' id.
    Null text counts as empty; empty texts form a group like any other. A null id never wins over
    another id; a group of null ids only has a null ``keep_id`` and all its rows stay. Rows that
    repeat id and text count in ``group_size`` and share the verdict. Other columns are ignored.
    ``hash128`` can be replaced (tests use a weak hash to make collisions).
    """
    normal = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("id"), normal.alias("body"))
    rows = rows.select("id", "body", hash128(F.col("body")).alias("hash"), F.sha2("body", 256).alias("sha"))
    best = F.max("id") if keep == "largest" else F.min("id")
    compared = rows.groupBy("hash", "sha", "body").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = compared.groupBy("hash", "sha").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = groups.select("hash", "sha", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long")).alias("group_size"))
    groups = step_table(groups)  # read from a table, a join with a large group can be split
    kept: Column = F.col("id").eqNullSafe(F.col("keep_id"))
    return rows.select("id", "hash", "sha").join(groups, ["hash", "sha"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
