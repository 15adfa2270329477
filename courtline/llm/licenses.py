"""Licence scan: sparse TF-IDF cosine of lines to licence templates, inherited down directories.

The vocabulary is that of the templates; document frequencies are counted over all documents and
come to the driver as one number per vocabulary term. A line is compared with a template only
if it holds one of the template's heavy terms: without them, by Cauchy-Schwarz, its cosine cannot
reach the threshold. A file whose matching lines hold a large share of its words is a licence file
and licenses its directory; a file without a header of its own takes the licence of the nearest
directory above it that has one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, numbered_lines, step_table, words

# Notices by which public licences are declared.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
THRESHOLD = 0.8
FILE_PERCENT = 25  # so many of its words in matching lines make a file a licence file


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def _template_terms() -> list[dict[str, int]]:
    import re
    out = []
    for _, notice in TEMPLATES:
        found = re.findall(TERM, notice.lower())
        out.append({t: found.count(t) for t in found})
    return out


def may_hold(text: Column, wanted: set[str]) -> Column:
    """True wherever one of the wanted terms stands in the text, and seldom otherwise: a term found by
    ``TERM`` has no letter A-Z or digit next to it, so only the starts of words are compared."""
    either = "|".join(t.replace(".", "\\.").replace("+", "\\+") for t in sorted(wanted))
    return text.rlike(f"(?:^|[^A-Za-z0-9])(?i:{either})(?![A-Za-z0-9])")


def matches(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, at, license, score) of the best template of each line at or above the threshold;
    ties go to the first licence name."""
    spark = files.sparkSession
    counts = _template_terms()
    vocabulary = sorted({t for c in counts for t in c})
    body = F.coalesce(F.col(text), F.lit(""))
    held = files.select(F.explode(F.array_intersect(terms(body), F.lit(vocabulary))).alias("t"))
    df = {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the vocabulary
    total = files.count()
    idf = {t: math.log((total + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    unknown = math.log(total + 1) + 1
    postings, heavy = [], set()
    for i, c in enumerate(counts):
        weight = {t: n * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        postings += [(t, i, TEMPLATES[i][0], idf[t], w / norm) for t, w in weight.items()]
        light = 0.0
        for t in sorted(weight, key=lambda t: (weight[t], t)):
            light += (weight[t] / norm) ** 2
            if light >= THRESHOLD ** 2 - 1e-9:
                heavy.add(t)
    weights = spark.createDataFrame(postings, "t string, template int, license string, idf double, w double")
    known = F.create_map(*[F.lit(x) for t in vocabulary for x in (t, idf[t])])
    # cheap superset tests before a text is cut into lines and a line is taken apart
    lines = files.where(may_hold(body, heavy)).select(F.col(path).alias("path"), F.explode(numbered_lines(body)).alias("x")).select(
        "path", "x.at", F.col("x.line").alias("line")).where(may_hold(F.col("line"), heavy))
    lines = lines.select("path", "at", terms(F.col("line")).alias("ts")).where(F.arrays_overlap("ts", F.lit(sorted(heavy))))
    # the square of the line's norm: sum over its distinct terms of (count * idf)^2
    tf = lambda ts: F.transform(F.array_distinct(ts), lambda t: F.struct(
        t.alias("t"), F.size(F.filter(ts, lambda y: y == t)).alias("n")))
    lines = lines.select("path", "at", let(F.col("ts"), tf).alias("tf"))
    square = F.aggregate("tf", F.lit(0.0), lambda acc, x: acc + F.pow(x["n"] * F.coalesce(F.element_at(known, x["t"]), F.lit(unknown)), F.lit(2)))
    lines = lines.select("path", "at", F.sqrt(square).alias("norm"), F.inline("tf"))
    scored = lines.join(F.broadcast(weights), "t").groupBy("path", "at", "template", "license").agg(
        F.round(F.sum(F.col("n") * F.col("idf") * F.col("w") / F.col("norm")), 6).alias("score")).where(F.col("score") >= THRESHOLD)
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b")
    return scored.groupBy("path", "at").agg(best).select("path", "at", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def license_scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per distinct path: path, license, score, origin ('header', 'inherited', 'none'), via (the
    directory it came from).

    Null and empty texts hold no notice and can only inherit; a null path counts as ''. Of several
    notices in a file the best cosine, then the first name, decides; of several licence files in a
    directory likewise. Rows that repeat a path are one file with the lines of all of them. Long lines
    are compared whole. Other columns are ignored.
    """
    rows = files.select(F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("text"))
    found = step_table(matches(rows))
    better = F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l")))
    own = found.groupBy("path").agg(better.alias("b"), F.collect_set("at").alias("at"))
    # files with a notice grow with the input, so they are met by a shuffle at every size, never by a broadcast
    line_words = rows.join(own.select("path", "at").hint("merge"), "path").select("path", F.size(words(F.coalesce("text", F.lit("")))).alias("all"), F.aggregate(
        F.filter(numbered_lines(F.coalesce("text", F.lit(""))), lambda x: F.array_contains(F.col("at"), x["at"])),
        F.lit(0), lambda acc, x: acc + F.size(words(x["line"]))).alias("hit"))
    share = line_words.groupBy("path").agg((100 * F.sum("hit") >= FILE_PERCENT * F.sum("all")).alias("is_file"))
    of_dirs = own.join(share.where("is_file"), "path").groupBy(directory(F.col("path")).alias("dir")).agg(F.min("b").alias("b"))
    names = rows.select("path").distinct().select("path", directory(F.col("path")).alias("dir"))
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/"))
    ladder = names.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = ladder.join(of_dirs.select(F.col("dir").alias("up"), "b"), "up").groupBy("dir").agg(
        F.max(F.struct(F.length("up").alias("depth"), "up", "b")).alias("near")).select("dir", "near")
    out = names.join(own.select("path", F.col("b").alias("own")), "path", "left").join(nearest, "dir", "left")
    has = F.col("own").isNotNull()
    return out.select("path", F.when(has, F.col("own.l")).otherwise(F.col("near.b.l")).alias("license"),
                      (-F.when(has, F.col("own.s")).otherwise(F.col("near.b.s"))).alias("score"),
                      F.when(has, "header").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
                      F.when(has, F.col("dir")).otherwise(F.col("near.up")).alias("via"))
