"""Line dedup: windows of three consecutive lines that occur again, anywhere in the table, go.

Windows run over the lines that hold a word. Each window is hashed (MD5 of its normalised
lines); the first occurrence in the order (doc_id, hash of the text, line) stays, every later one
is covered, and a line goes if any covered window holds it. Overlapping windows merge into one
removed passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, let, normal_line, numbered_lines, step_table, without_lines

WINDOW = 3


def window_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per window: id, key, at (numbers of its lines, array<int>), win (16-byte hash)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(numbered_lines(body), lambda x: F.struct(x["at"].alias("at"), normal_line(x["line"]).alias("line")))

    def windows(x):
        each = F.transform(F.sequence(F.lit(1), F.size(x) - (WINDOW - 1)), lambda i: let(
            F.slice(x, i, F.lit(WINDOW)), lambda w: F.struct(
                w["at"].alias("at"), digest(F.array_join(w["line"], "\n")).alias("win"))))
        return F.when(F.size(x) >= WINDOW, each)

    return docs.select(F.col(doc_id).alias("id"), digest(body).alias("key"), F.inline(let(lines, windows)))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per (id, key) that loses lines: ``lost``, the sorted numbers of its covered lines.

    The groups are reduced on the map side to their first occurrence and a count, so a window
    that a third of all rows share costs one row per task; the occurrences meet it in a
    sort-merge join that adaptive execution splits.
    """
    wins = step_table(window_rows(docs, doc_id, text))  # read twice: each text is split and hashed once
    place = F.struct(F.col("id"), F.col("key"), F.col("at")[0].alias("line"))
    first = wins.groupBy("win").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("win", "first")
    later = wins.join(first, "win").where(place != F.col("first"))
    return later.groupBy("id", "key").agg(F.collect_set("at").alias("at")).select(
        "id", "key", F.sort_array(F.array_distinct(F.flatten("at"))).alias("lost"))


def _cleaned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), digest(body).alias("key"))
    gone = repeated_lines(docs, doc_id, text)
    out = rows.alias("r").join(gone.alias("g"), F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.key") == F.col("g.key")), "left")
    cleaned = F.when(F.col("lost").isNull(), F.col("row")[text]).otherwise(without_lines(F.col("row")[text], F.col("lost")))
    return out.select("row", "lost", cleaned.alias("cleaned"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated passages.

    Texts with fewer than three lines that hold a word have no window and stay as they are; so do
    null texts. A text all of whose lines go becomes ''. Rows that repeat id and text are one
    occurrence. A null id sorts first. No row is dropped.
    """
    return _cleaned(docs, doc_id, text).select(*[
        F.col("cleaned").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def line_dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines (with a word), n_removed, text_sha256 (of what is
    left; null text counts as empty)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _cleaned(slim, "doc_id", "text").select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(numbered_lines(F.coalesce(F.col("row.text"), F.lit("")))).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("text_sha256"))
