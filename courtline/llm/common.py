"""Column helpers and step tables shared by the operators of this subpackage.

Words are runs of ``[^\\x20\\x09-\\x0D]``; lines are the ``\\n``-separated pieces of a text. The
other helpers here are plain column expressions: no Python runs on the executors.
"""

from __future__ import annotations

import ctypes
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, configure

BLANKS = "[\\x20\\x09-\\x0D]+"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
a_to_z = A_TO_Z.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def step_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of the session (spark.checkpoint.dir) and
    read it back: cuts the lineage, and lost executors cost no recomputation of earlier steps."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "steps", uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hand_back() -> None:
    """For Python tasks, after a batch: freed memory goes back to the system. Else a worker keeps its
    largest batches' memory, and it lives on beside the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: the lambda variable holds it, so a
    nested lambda that refers to it does not evaluate it again for each element."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII only take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, A_TO_Z, a_to_z))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def normal_line(line: Column) -> Column:
    """A line as it is compared: A-Z lowered, runs of blanks as one space, no blanks around."""
    return F.trim(F.regexp_replace(ascii_lower(line), BLANKS, " "))


def digest(text: Column) -> Column:
    """MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def numbered_lines(text: Column) -> Column:
    """Lines that hold a word, as array<struct<at int, line string>>; ``at`` counts all lines from 0."""
    every = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    return F.filter(every, lambda x: has_word(x["line"]))


def without_lines(text: Column, drop: Column) -> Column:
    """``text`` without the lines whose numbers stand in the array ``drop``; '' when no line with
    a word is left. Lines and marks are sorted together, so the cost is n log n however many go."""
    def kept(both: Column) -> Column:
        pairs = F.zip_with(both, F.slice(both, F.lit(2), F.size(both)), lambda a, b: F.when(
            (a["mark"] == 0) & (b.isNull() | (b["mark"] == 0)), a["line"]))
        return F.filter(pairs, lambda x: x.isNotNull())

    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("at"), F.lit(0).alias("mark"), line.alias("line")))
    marks = F.transform(drop, lambda at: F.struct(at.alias("at"), F.lit(1).alias("mark"), F.lit("").alias("line")))
    left = F.array_join(let(F.sort_array(F.concat(lines, marks)), kept), "\n")
    return F.when(F.size(drop) == 0, text).otherwise(let(left, lambda x: F.when(has_word(x), x).otherwise(F.lit(""))))
