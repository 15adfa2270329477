"""Reshaping: match ↔ player-perspective rows, market → bet rows, long → wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_player_perspective(matches: DataFrame, *, winner="winner_id", loser="loser_id",
                          keep: list[str] | None = None) -> DataFrame:
    """Each match → two rows (player, opponent, won). One scan, an ``explode`` of two
    structs — no union, no second pass over the input."""
    keep = keep if keep is not None else [c for c in matches.columns if c not in (winner, loser)]
    sides = F.array(
        F.struct(F.col(winner).alias("player_id"), F.col(loser).alias("opponent_id"), F.lit(1).alias("won")),
        F.struct(F.col(loser).alias("player_id"), F.col(winner).alias("opponent_id"), F.lit(0).alias("won")))
    return matches.select(*keep, F.explode(sides).alias("_s")).select(*keep, "_s.player_id", "_s.opponent_id", "_s.won")


def unpivot_bets(markets: DataFrame, *, base: list[str], p1_prob: str = "p1_predicted_prob") -> DataFrame:
    """Market → one bet row per side. The p2 side gets probability 1 − p1 and
    ``winner`` = 1 − winner."""
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.col("p1_id").alias("player_id"), F.col("p1_odds").alias("odds"),
                 F.col(p1_prob).alias("predicted_prob"), F.col("winner").alias("winner")),
        F.struct(F.lit(2).alias("side"), F.col("p2_id").alias("player_id"), F.col("p2_odds").alias("odds"),
                 (F.lit(1.0) - F.col(p1_prob)).alias("predicted_prob"), (F.lit(1) - F.col("winner")).alias("winner")))
    return markets.select(*base, F.explode(sides).alias("_b")).select(*base, "_b.*")


def pivot_to_match(long: DataFrame, feature_cols: list[str], *, match="match_id", player="player_id",
                   p1="p1_id", p2="p2_id") -> DataFrame:
    """Player rows (with the match's p1/p2 ids) → one row per match with ``p1_``/``p2_``
    prefixed features. Conditional aggregation in one grouped pass instead of two joins."""
    aggs = []
    for c in feature_cols:
        aggs.append(F.max(F.when(F.col(player) == F.col(p1), F.col(c))).alias(f"p1_{c}"))
        aggs.append(F.max(F.when(F.col(player) == F.col(p2), F.col(c))).alias(f"p2_{c}"))
    return long.groupBy(match, p1, p2).agg(*aggs)


def prefix_columns(df: DataFrame, prefix: str, cols: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in cols})


def normalize_columns(df: DataFrame) -> DataFrame:
    """lower case, spaces → '_', parentheses removed."""
    return df.toDF(*[c.lower().replace(" ", "_").replace("(", "").replace(")", "") for c in df.columns])


def sanitize_feature_names(df: DataFrame) -> DataFrame:
    """Remove '[', ']' and '<' from column names."""
    return df.toDF(*[c.replace("[", "").replace("]", "").replace("<", "") for c in df.columns])


def project_final(df: DataFrame, schema) -> DataFrame:
    """Fixed column order; absent columns become typed NULLs."""
    have = set(df.columns)
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def align_to_model(df: DataFrame, cols: list[str]) -> DataFrame:
    """Model input columns in order; absent → 0, NULL → 0."""
    have = set(df.columns)
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c)
                       for c in cols], *[c for c in df.columns if c not in cols])


def union_tours(frames: list[DataFrame], allow_missing: bool = True) -> DataFrame:
    """Concatenate per-tour tables by column name; columns missing in a frame become NULL
    (``union_with_missing``, e.g. 4-column ranking files next to 5-column ones)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out
