"""Quality rules: text statistics of each document, and the cross-document frequency of lines.

Every line with a word is normalised and hashed; for each host the distinct documents that hold
a line are counted. A document counts by the hash of its text, so exact copies count as one
document and a text is not taken for boilerplate because it was copied. Lines above the limits are removed; a document whose words
lie mostly in removed lines is rejected as depleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, has_word, let, normal_line, numbered_lines, step_table, without_lines, words

MIN_WORDS = 50          # fewer words: fails
MAX_REPEAT_PERCENT = 50  # more of the words in repeated three-word windows: fails
LINE_MIN_DOCS = 20      # a line in at most so many documents of a host always stays
LINE_MAX_PERCENT = 1.0  # and so does one in at most this share of the host's documents
DEPLETED_PERCENT = 30   # fewer of the words left outside removed lines: rejected


FEW_WINDOWS = 32  # so many repeated windows are looked up one by one, more by sorting; same result


def repeat_words(tokens: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array of words."""
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def again(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a == b, a))
        return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))

    def looked_up(h: Column, found: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(found, x), i)), lambda x: x.isNotNull())

    def sorted_out(h: Column) -> Column:
        def places(s: Column) -> Column:
            pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), places)

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    def count(h: Column) -> Column:
        many = let(let(F.sort_array(h), again), lambda found: F.when(
            F.size(found) <= FEW_WINDOWS, looked_up(h, found)).otherwise(sorted_out(h)))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(many, covered)).otherwise(F.lit(0))

    return let(tokens, lambda w: F.when(F.size(w) > 3, let(hashes(w), count)).otherwise(F.lit(0))).cast("long")


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), has_word)
    return let(words(whole), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words")))


def document_profile(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The one pass over the texts, as a step table: id, key (hash of the text), host, stats, lines
    (array<struct<at, line, n_words>>: number and hash of each line with a word)."""
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = F.transform(numbered_lines(body), lambda x: F.struct(
        x["at"].alias("at"), digest(normal_line(x["line"])).alias("line"), F.size(words(x["line"])).alias("n_words")))
    return step_table(docs.select(F.col(doc_id).alias("id"), digest(body).alias("key"), F.col(host).alias("host"),
                                  text_statistics(F.col(text)).alias("stats"), hashed.alias("lines")))


def line_rows(profile: DataFrame) -> DataFrame:
    """One row per line with a word: id, key, host, at, line, n_words."""
    return profile.select("id", "key", "host", F.inline("lines"))


def frequent_lines(lines: DataFrame, min_docs: int = LINE_MIN_DOCS, max_percent: float = LINE_MAX_PERCENT) -> DataFrame:
    """(host, line) above both limits. Each (host, line, document) is one row after map-side
    aggregation, so a line that every document holds arrives as one count per task."""
    in_docs = lines.select("host", "line", "key").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = lines.select("host", "key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    above = in_docs.where(F.col("n_docs") > min_docs).alias("l").join(
        hosts.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
    return above.where(F.col("n_docs") * 100.0 > F.col("host_docs") * max_percent).select("l.host", "l.line")


def removed_lines(profile: DataFrame, min_docs: int = LINE_MIN_DOCS, max_percent: float = LINE_MAX_PERCENT) -> DataFrame:
    """One row per (id, key) that loses lines: ``lost`` array<int> of line numbers, ``n_lost_words``.
    Rows that repeat id and text share one result."""
    lines = line_rows(profile)
    often = frequent_lines(lines, min_docs, max_percent).alias("f")
    hits = lines.alias("x").join(often, F.col("x.host").eqNullSafe(F.col("f.host")) & (F.col("x.line") == F.col("f.line")), "left_semi")
    found = hits.groupBy("id", "key").agg(F.collect_set(F.struct("at", "n_words")).alias("found"))
    return found.select("id", "key", F.transform("found", lambda x: x["at"]).alias("lost"), F.aggregate(
        "found", F.lit(0), lambda acc, x: acc + x["n_words"]).cast("long").alias("n_lost_words"))


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")) & (F.col(f"{left}.key") == F.col(f"{right}.key"))


def _verdict(with_lost: DataFrame) -> tuple[Column, Column]:
    s = F.col("stats")
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
    depleted = 100 * (s["n_words"] - F.coalesce("n_lost_words", F.lit(0))) < DEPLETED_PERCENT * s["n_words"]
    return failed, ~failed & ~depleted


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                  min_docs: int = LINE_MIN_DOCS, max_percent: float = LINE_MAX_PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lost_words, base_failed, kept.

    Null text counts as empty (0 words, base_failed). A null host is a host of its own. Rows that
    repeat an id are judged each by its own text. Other columns are ignored.
    """
    rows = document_profile(docs, doc_id, text, host)
    lost = removed_lines(rows, min_docs, max_percent).select("id", "key", "n_lost_words")
    rows = rows.select("id", "key", "stats")
    out = rows.alias("r").join(lost.alias("q"), _same("r", "q"), "left")
    failed, kept = _verdict(out)
    return out.select(F.col("r.id").alias("doc_id"), "stats.*", F.coalesce("n_lost_words", F.lit(0)).alias("n_lost_words"),
                      failed.alias("base_failed"), kept.alias("kept"))


def apply_quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                        min_docs: int = LINE_MIN_DOCS, max_percent: float = LINE_MAX_PERCENT) -> DataFrame:
    """The documents that pass, with all their columns, without the lines above the limits."""
    profile = document_profile(docs, doc_id, text, host)
    lost = removed_lines(profile, min_docs, max_percent)
    judged = profile.select("id", "key", "stats").dropDuplicates(["id", "key"]).alias("r").join(lost.alias("q"), _same("r", "q"), "left")
    passed = judged.where(_verdict(judged)[1]).select("r.id", "r.key", "lost")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"),
                       digest(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    out = rows.alias("d").join(passed.alias("p"), _same("d", "p"))
    cleaned = F.when(F.col("lost").isNull(), F.col("row")[text]).otherwise(without_lines(F.col("row")[text], F.col("lost")))
    return out.select(*[cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
