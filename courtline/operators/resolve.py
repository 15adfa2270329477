"""Entity resolution: feed names → historical ids by a five-pass cascade.

Pass order and confidences are fixed (``params.MAPPING_METHODS``): exact name, cleaned name,
initial + last name, unique last name, fuzzy. Every pass only sees the feed ids left
unmatched by the earlier passes (``left_anti``).

Scale: a popular name must not turn into a name-group product. Each pass therefore
aggregates the historical side per match key first (candidate count, smallest id, hit
counts for the ambiguity guard) and joins every feed row to at most one key row. The result
per pass is the candidate the final resolution would keep (highest confidence, then the
smallest historical id), so ``map_resolve`` over the union equals resolving the full pair
list. The fuzzy pass finds every candidate above the threshold exactly: names are cut into
pieces of which one must stand unchanged in any partner, so no block is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..session import cut_lineage
from ..functions.text import block_key, clean_name, initial_lastname, lastname, name_similarity, token_sorted

OUT_COLS = ["source_id", "historical_id", "source_name", "matched_name", "confidence", "method"]


def _emit(df: DataFrame, method: str, confidence) -> DataFrame:
    conf = F.lit(float(confidence)) if not isinstance(confidence, str) else F.col(confidence).cast("double")
    return df.select("source_id", "historical_id", "source_name", "matched_name", conf.alias("confidence"),
                     F.lit(method).alias("method"))


def map_exact(src: DataFrame, hist: DataFrame) -> DataFrame:
    """Pass 1: raw names equal (no ambiguity guard). Keeps the smallest historical id."""
    h = hist.groupBy(F.col("historical_name").alias("_key")).agg(F.min("historical_id").alias("historical_id"))
    j = src.join(h, src.source_name == h._key).withColumn("matched_name", F.col("_key"))
    return _emit(j, "Exact", 100.0)


def _guarded_pass(src: DataFrame, hist: DataFrame, src_key, hist_key, method: str, confidence: float) -> DataFrame:
    """Equi-match on a derived key, dropping every historical id that the pass would hit
    more than once (once per feed row with that key, summed over all its keys)."""
    s = src.withColumn("_key", src_key)
    h = hist.withColumn("_key", hist_key)
    src_per_key = s.groupBy("_key").agg(F.count(F.lit(1)).alias("_nsrc"))
    hits = (h.join(src_per_key, "_key")                      # one row per historical row, no pairs
            .groupBy("historical_id").agg(F.sum("_nsrc").alias("_hits")))
    ok = h.join(hits.where(F.col("_hits") == 1).select("historical_id"), "historical_id", "left_semi")
    best = ok.groupBy("_key").agg(F.min_by(F.struct("historical_id", "historical_name"),
                                           F.col("historical_id")).alias("_b"))
    j = s.join(best, "_key").select("source_id", "source_name", F.col("_b.historical_id").alias("historical_id"),
                                    F.col("_b.historical_name").alias("matched_name"))
    return _emit(j, method, confidence)


def map_cleaned(src: DataFrame, hist: DataFrame) -> DataFrame:
    """Pass 2: cleaned names equal; ambiguous historical ids dropped."""
    return _guarded_pass(src, hist, clean_name("source_name"), clean_name("historical_name"), "Exact-Cleaned", 99.5)


def map_initial(src: DataFrame, hist: DataFrame) -> DataFrame:
    """Pass 3: 'N Last' forms equal (case-sensitive, uncleaned); same guard."""
    return _guarded_pass(src, hist, initial_lastname("source_name"), initial_lastname("historical_name"),
                         "Initial+Lastname", 99.0)


def map_unique_lastname(src: DataFrame, hist: DataFrame) -> DataFrame:
    """Pass 4: the feed last name occurs exactly once among historical rows."""
    h = (hist.withColumn("_key", lastname("historical_name"))
         .groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("historical_id").alias("historical_id"),
                              F.min("historical_name").alias("matched_name"))
         .where(F.col("_n") == 1))
    j = src.withColumn("_key", lastname("source_name")).join(h, "_key")
    return _emit(j, "Unique Lastname", 98.0)


# ---------------------------------------------------------------- fuzzy pass

def _edits(length: str, delta: float) -> str:
    """Most edits between a string of this length and any partner that passes."""
    return f"CAST(floor({length} * {delta / (1.0 - delta)!r}D + 1e-9D) AS int)"


def _segment_starts(length: str, pieces: str, i: str) -> str:
    """1-based start of piece ``i`` when a string is cut evenly, the longer pieces last."""
    return f"(1 + ({i} - 1) * ({length} div {pieces}) + greatest(0, {i} - 1 - ({pieces} - {length} % {pieces})))"


def _segment_size(length: str, pieces: str, i: str) -> str:
    return f"({length} div {pieces} + if({i} > {pieces} - {length} % {pieces}, 1, 0))"


def _candidates(s: DataFrame, h: DataFrame, delta: float) -> DataFrame:
    """Distinct pairs (sname, hname) that can reach ``1 - delta`` similarity on some spelling.

    Both sides carry one row per spelling (``_tag``: raw / token-sorted, text in ``_rep``). A
    historical spelling of length L may be off by τ(L) edits from a partner that passes, so it is
    cut into τ + 1 pieces, of which τ edits leave one whole. A feed spelling of length l sends, for
    each L in its band, the substrings that can be that piece: piece i at p can stand at most i − 1
    places off p, and at most τ + 1 − i off p + l − L, or a piece to its left or right is whole as
    well. The pairs come from one equi-join on (spelling, block, L, i, text); the number of
    substrings depends on the length of the name alone."""
    hs = (h.selectExpr("hname", "_tag", "_blk", "_rep", "length(_rep) AS _L").selectExpr("*", f"{_edits('_L', delta)} + 1 AS _k")
          .selectExpr("*", "explode(sequence(1, _k)) AS _i")
          .selectExpr("hname", "_tag", "_blk", "_L", "_i",
                      f"substring(_rep, {_segment_starts('_L', '_k', '_i')}, {_segment_size('_L', '_k', '_i')}) AS _seg"))
    low, high = f"CAST(ceil(_len * {1.0 - delta!r}D - 1e-9D) AS int)", f"CAST(floor(_len * {1.0 / (1.0 - delta)!r}D + 1e-9D) AS int)"
    at = (s.selectExpr("sname", "_tag", "_blk", "_rep", "length(_rep) AS _len")
          .selectExpr("*", f"explode(sequence(greatest(1, {low}), {high})) AS _L").selectExpr("*", f"{_edits('_L', delta)} + 1 AS _k")
          .selectExpr("*", "explode(sequence(1, _k)) AS _i")
          .selectExpr("*", f"{_segment_starts('_L', '_k', '_i')} AS _p", f"{_segment_size('_L', '_k', '_i')} AS _n"))
    first = "greatest(1, _p - (_i - 1), _p + _len - _L - (_k - _i))"
    last = "least(_len - _n + 1, _p + (_i - 1), _p + _len - _L + (_k - _i))"
    ss = (at.where(f"{first} <= {last}").selectExpr("*", f"explode(sequence({first}, {last})) AS _from")
          .selectExpr("sname", "_tag", "_blk", "_L", "_i", "substring(_rep, _from, _n) AS _seg"))
    return ss.join(hs, ["_tag", "_blk", "_L", "_i", "_seg"]).select("sname", "hname").distinct()


def _spellings(names: DataFrame, name: str) -> DataFrame:
    each = F.explode(F.array(F.struct(F.lit("raw").alias("_tag"), F.col(name).alias("_rep")),
                             F.struct(F.lit("sorted").alias("_tag"), token_sorted(name).alias("_rep"))))
    return names.select(name, "_blk", each.alias("_x")).select(name, "_blk", "_x.*")


def _scored_names(src: DataFrame, hist: DataFrame, min_score: float) -> DataFrame:
    """(sname, hname, hid, _score ≥ min_score) of the distinct names of both sides that share a block."""
    if min_score <= 50.0:
        raise ValueError("pieces need a similarity above 50")
    delta = 1.0 - min_score / 100.0
    s = (src.where(F.length(F.trim("source_name")) > 0).select(F.col("source_name").alias("sname")).distinct()
         .withColumn("_blk", block_key("sname")).where(F.col("_blk") != ""))
    h = (hist.groupBy(F.col("historical_name").alias("hname")).agg(F.min("historical_id").alias("hid"))
         .withColumn("_blk", block_key("hname")).where(F.col("_blk") != ""))
    # a distance is only worked out as far as it can still pass
    near = " OR ".join(f"levenshtein({a}, {b}, CAST(floor(greatest(length({a}), length({b})) * {delta!r}D + 1e-9D) AS int)) >= 0"
                       for a, b in (("sname", "hname"), ("_st", "_ht")))
    return (_candidates(_spellings(s, "sname"), _spellings(h, "hname"), delta)
            .withColumns({"_st": token_sorted("sname"), "_ht": token_sorted("hname")}).where(near).drop("_st", "_ht")
            .withColumn("_score", name_similarity("sname", "hname")).where(F.col("_score") >= min_score)
            .join(h.select("hname", "hid"), "hname"))


def fuzzy_scored(src: DataFrame, hist: DataFrame, min_score: float) -> DataFrame:
    """Every (feed id, historical name) pair in the same block with ``name_similarity ≥ min_score``
    (above 50), exactly. Each distinct name is compared once, however many ids carry it; duplicate
    historical names keep their smallest id."""
    ids = src.select("source_id", F.col("source_name").alias("_sn"))
    pairs = _scored_names(src, hist, min_score).withColumnRenamed("sname", "_sn")
    return ids.join(pairs, "_sn").select("hname", "source_id", "_sn", "hid", "_score")


def map_fuzzy(src: DataFrame, hist: DataFrame, threshold: float = params.MAPPING_CONFIDENCE_THRESHOLD) -> DataFrame:
    """Pass 5: best historical name in the same block (first letter of the last name) by
    ``name_similarity``, kept when the score reaches ``threshold``; ties go to the smaller
    name, then id. Exact: no candidate above the threshold is skipped. The best partner is chosen
    per distinct name, before ids that share a name get it."""
    best = F.min_by(F.struct("hname", "hid", "_score", "_sn"), F.struct(-F.col("_score"), F.col("hname"), F.col("hid"))).alias("_b")
    per_name = (_scored_names(src, hist, threshold).withColumnRenamed("sname", "_sn").groupBy("_sn").agg(best)
                .select("_sn", "_b.hname", "_b.hid", "_b._score"))
    per_id = src.select("source_id", F.col("source_name").alias("_sn")).join(per_name, "_sn").groupBy("source_id").agg(best)
    out = per_id.select("source_id", F.col("_b.hid").alias("historical_id"), F.col("_b._sn").alias("source_name"),
                        F.col("_b.hname").alias("matched_name"), F.col("_b._score").alias("confidence"))
    return _emit(out, "Fuzzy", "confidence")


def _block_scored(src: DataFrame, hist: DataFrame) -> DataFrame:
    """Every name of ``src`` with every historical name of its block, scored."""
    s = src.where(F.length(F.trim("source_name")) > 0).withColumn("_blk", block_key("source_name")).where(F.col("_blk") != "")
    h = (hist.groupBy(F.col("historical_name").alias("hname")).agg(F.min("historical_id").alias("hid"))
         .withColumn("_blk", block_key("hname")))
    return s.select("source_id", "_blk", F.col("source_name").alias("_sn")).join(h, "_blk").withColumn("_score", name_similarity("_sn", "hname"))


# ---------------------------------------------------------------- cascade

def map_cascade(src: DataFrame, hist: DataFrame, threshold: float = params.MAPPING_CONFIDENCE_THRESHOLD,
                checkpoint: bool = True) -> DataFrame:
    """Run the five passes; returns the union of all pass outputs (one row per matched feed id).

    ``src``: (source_id, source_name) — distinct pairs; ``hist``: (historical_id, historical_name).
    Each pass depends on what the earlier passes left unmatched, so without cuts the plan of
    pass k would contain every earlier pass 2^k times. Each pass output (the feed ids it
    matched — small) and the historical table are written with a reliable checkpoint
    (session checkpoint folder; survives executor loss), so the remainder is a linear chain
    of anti-joins against materialised outputs; ``checkpoint=False`` keeps everything lazy
    (small inputs only).
    """
    def cut(df):
        return cut_lineage(df) if checkpoint else df

    src = src.select("source_id", "source_name").distinct()
    hist = hist.select("historical_id", "historical_name").where(
        F.col("historical_id").isNotNull() & F.col("historical_name").isNotNull()).distinct()
    out = []
    remaining = src
    hist = cut(hist)
    for fn in (map_exact, map_cleaned, map_initial, map_unique_lastname):
        m = cut(fn(remaining, hist))  # small: the feed ids matched by this pass
        out.append(m)
        # a chain of anti-joins against materialised pass outputs: linear lineage
        remaining = remaining.join(m.select("source_id"), "source_id", "left_anti")
    out.append(map_fuzzy(remaining, hist, threshold))
    result = out[0]
    for m in out[1:]:
        result = result.unionByName(m)
    return result


def map_resolve(mappings: DataFrame) -> DataFrame:
    """Best mapping per feed id: highest confidence, then pass order, then smallest historical id."""
    rank = F.when(F.col("method") == "Exact", 1).when(F.col("method") == "Exact-Cleaned", 2) \
            .when(F.col("method") == "Initial+Lastname", 3).when(F.col("method") == "Unique Lastname", 4).otherwise(5)
    best = mappings.groupBy("source_id").agg(
        F.min_by(F.struct(*OUT_COLS), F.struct(-F.col("confidence"), rank, F.col("historical_id"))).alias("_b"))
    return best.select("_b.*")


def filter_ambiguous_map(mappings: DataFrame, below: float, method: str | None = None) -> DataFrame:
    cond = F.col("confidence") < below
    if method:
        cond = cond & (F.col("method") == method)
    return mappings.where(cond)


def topk_candidates(src: DataFrame, hist: DataFrame, k: int = 5, floors: tuple[float, ...] = (85.0, 60.0)) -> DataFrame:
    """The ``k`` best historical names of the same block per feed name, for manual review.

    Names with ``k`` candidates at a high floor need no others, so each floor is tried only on the
    names the one before left short, and the few that are still short are scored against their
    block. Ties go to the smaller name, then id."""
    w = Window.partitionBy("source_id").orderBy(F.col("_score").desc(), "hname", "hid")

    def best(scored: DataFrame) -> DataFrame:
        return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)

    left, out = src, None
    for floor in floors:
        top = cut_lineage(best(fuzzy_scored(left, hist, floor)).select("source_id", "_sn", "hname", "hid", "_score", "_r"))
        full = top.where(F.col("_r") == k).select("source_id")
        done = top.join(full, "source_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        left = left.join(full, "source_id", "left_anti")
    rest = best(_block_scored(left, hist)).select("source_id", "_sn", "hname", "hid", "_score", "_r")
    out = rest if out is None else out.unionByName(rest)
    return out.select("source_id", F.col("_sn").alias("source_name"), F.col("hname").alias("candidate_name"),
                      F.col("hid").alias("candidate_id"), F.col("_score").alias("score"), F.col("_r").alias("candidate_rank"))


def apply_corrections(mappings: DataFrame, corrections: DataFrame) -> DataFrame:
    """Keyed update: corrected rows get the manual name / id, confidence 100 and method
    'Manual Correction'; others are unchanged."""
    c = corrections.select(F.col("source_id").alias("_cid"), F.col("historical_id").alias("_chid"),
                           F.col("matched_name").alias("_cname"))
    j = mappings.join(c, mappings.source_id == c._cid, "left")
    hit = F.col("_cid").isNotNull()
    return j.select("source_id",
                    F.when(hit, F.col("_chid")).otherwise(F.col("historical_id")).alias("historical_id"),
                    "source_name",
                    F.when(hit, F.col("_cname")).otherwise(F.col("matched_name")).alias("matched_name"),
                    F.when(hit, F.lit(100.0)).otherwise(F.col("confidence")).alias("confidence"),
                    F.when(hit, F.lit("Manual Correction")).otherwise(F.col("method")).alias("method"))
