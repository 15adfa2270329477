"""Match-level feature table: the composition the model and the back-test read.

matches → canonical pair → player-perspective rows → point-in-time features (running
aggregates) → one row per match with ``p1_``/``p2_`` columns (conditional
aggregation, one shuffle on match_id) → head-to-head, odds, implied probabilities, diffs,
optional Elo and rank.

Shuffles on the hot path: perspective rows by ranges of (player, time) for the running
aggregates (a hot player is cut like any other), the match pivot by match_id, the pair pass by
ranges of (pair, time). No broadcast of anything that grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import book_margin, implied_prob
from ..operators import pairs, pit
from ..operators.markets import canonical_pair
from ..operators.running import rows_before

PLAYER_FEATURES = ["win_perc", "form", "rolling_win_perc_20", "rolling_win_perc_50", "surface_win_perc",
                   "matches_last_7_days", "matches_last_14_days", "sets_played_last_7_days", "sets_played_last_14_days"]


def player_rows(matches: DataFrame) -> DataFrame:
    """Two rows per match; ``row_id`` = 2·match_id (winner) / 2·match_id + 1 (loser)."""
    sides = F.array(
        F.struct(F.col("winner_id").alias("player_id"), F.lit(1).alias("won"), (F.col("match_id") * 2).alias("row_id")),
        F.struct(F.col("loser_id").alias("player_id"), F.lit(0).alias("won"), (F.col("match_id") * 2 + 1).alias("row_id")))
    return (matches.select("match_id", F.col("tourney_date").alias("ts"), "surface", "sets_played",
                           F.explode(sides).alias("_s"))
            .select("match_id", "ts", "surface", "sets_played", "_s.*"))


def player_features(rows: DataFrame) -> DataFrame:
    """All point-in-time features of each player row (keyed by ``row_id``).

    One running pass per player gives positions and sums for the expanding and all three
    positional windows, which share one more shuffle; surface means and day ranges are passes
    of their own over the same narrow input. The three meet in one aggregate on ``row_id``.
    """
    base = rows.select("row_id", "match_id", "player_id", "ts", "surface", "won", "sets_played")
    sizes = {10: "form", 20: "rolling_win_perc_20", 50: "rolling_win_perc_50"}
    r = rows_before(base.select("row_id", "match_id", "player_id", "ts", "won"), ["player_id"], ["ts", "row_id"], "won", list(sizes))

    def mean(total: str, n: str):
        return F.coalesce(F.try_divide(F.col(total).cast("double"), F.col(n).cast("double")), F.lit(0.0))

    out = r.select("row_id", "match_id", "player_id", mean("_rb_sum", "_rb_cnt").alias("win_perc"),
                   *[mean(f"_rb_sum_{n}", f"_rb_cnt_{n}").alias(name) for n, name in sizes.items()])
    surf = pit.pit_surface_win_perc(base.select("row_id", "player_id", "surface", "ts", "won")).select("row_id", "surface_win_perc")
    return meet([out, surf, pit.pit_load(base, sets="sets_played")], "row_id")


def meet(parts: list[DataFrame], key: str) -> DataFrame:
    """Tables with at most one row per key and columns of their own as one table: a union and one
    aggregate on the key instead of a join for each."""
    columns = [c for part in parts for c in part.columns if c != key]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.groupBy(key).agg(*[F.expr(f"max(`{c}`) AS `{c}`") for c in columns])


def match_ranks(m: DataFrame, rankings: DataFrame) -> DataFrame:
    """Both sides' ranks at the match's time: the sides are two probes of one as-of pass, which reads
    the rankings once and the matches themselves, not the features made of them."""
    asked = m.select("match_id", "tourney_date", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_side"), F.col(f"p{i}_id").alias("_pid")) for i in (1, 2)])))
    r = pairs.asof_rank_join(asked, rankings, player="_pid", date="tourney_date", left_id="match_id")
    return r.groupBy("match_id").agg(*[F.max(F.when(F.col("_side") == i, F.col("rank"))).alias(f"p{i}_rank") for i in (1, 2)])


def build_match_features(matches: DataFrame, *, elo: DataFrame | None = None,
                         rankings: DataFrame | None = None, players: DataFrame | None = None,
                         materialize: bool = True) -> DataFrame:
    """``materialize``: write the narrow match table once (reliable checkpoint in the
    session's checkpoint folder) and build every branch from it. Each branch prunes other
    columns, so without this step boundary Spark cannot reuse the upstream exchange and
    recomputes the match table once per branch (and plans a much larger tree)."""
    matches = matches.select("match_id", "tourney_date", "tourney_name", "surface", "winner_id", "loser_id",
                             "winner_odds", "loser_odds", "sets_played")
    if materialize:
        from ..session import cut_lineage
        matches = cut_lineage(matches)
    m = canonical_pair(matches)
    feats = player_features(player_rows(matches))
    h2h = pairs.pit_h2h(matches).select("match_id", "h2h_p1_wins", "h2h_p2_wins")
    sides = feats.groupBy("match_id").agg(*[F.expr(f"max(if(row_id % 2 = {odd}, {c}, NULL)) AS _{side}_{c}")
                                            for c in PLAYER_FEATURES for odd, side in enumerate("wl")])
    parts = [sides, h2h]
    if rankings is not None:
        parts.append(match_ranks(m, rankings))
    p1_won = "winner_id = p1_id"
    out = m.join(meet(parts, "match_id"), "match_id").selectExpr(
        "match_id", "tourney_date", "tourney_name", "surface", "p1_id", "p2_id", "winner",
        f"if({p1_won}, winner_odds, loser_odds) AS p1_odds", f"if({p1_won}, loser_odds, winner_odds) AS p2_odds",
        *[f"if({p1_won}, _{a}_{c}, _{b}_{c}) AS {side}_{c}" for c in PLAYER_FEATURES for side, a, b in (("p1", "w", "l"), ("p2", "l", "w"))],
        "h2h_p1_wins", "h2h_p2_wins", *(["p1_rank", "p2_rank"] if rankings is not None else []))
    out = out.withColumns({"p1_implied_prob": implied_prob("p1_odds"), "p2_implied_prob": implied_prob("p2_odds")})
    out = out.withColumns({
        "book_margin": book_margin("p1_implied_prob", "p2_implied_prob"),
        "fatigue_diff_7_days": F.col("p1_matches_last_7_days") - F.col("p2_matches_last_7_days"),
        "fatigue_diff_14_days": F.col("p1_matches_last_14_days") - F.col("p2_matches_last_14_days"),
        "fatigue_sets_diff_7_days": F.col("p1_sets_played_last_7_days") - F.col("p2_sets_played_last_7_days"),
        "fatigue_sets_diff_14_days": F.col("p1_sets_played_last_14_days") - F.col("p2_sets_played_last_14_days"),
        "h2h_p1_wins": F.coalesce("h2h_p1_wins", F.lit(0)), "h2h_p2_wins": F.coalesce("h2h_p2_wins", F.lit(0)),
    })
    if elo is not None:
        out = join_elo(out, elo)
    if rankings is not None:
        out = out.withColumn("rank_diff", F.col("p1_rank") - F.col("p2_rank"))
    if players is not None:
        for side in ("p1", "p2"):
            p = players.select(F.col("player_id").alias(f"_{side}pid"), F.col("hand").alias(f"{side}_hand"))
            out = out.join(p, out[f"{side}_id"] == p[f"_{side}pid"], "left").drop(f"_{side}pid")
    return out


# ---------------------------------------------------------------- named joins of the feature build

def join_elo(features: DataFrame, elo: DataFrame, initial: float = 1500.0) -> DataFrame:
    """Attach pre-match ratings on (match_id, p1_id, p2_id) — ratings carry canonical ids, so
    they cannot be attached to the wrong side; missing → initial rating; adds ``elo_diff``."""
    e = elo.select("match_id", F.col("p1_id").alias("_e1"), F.col("p2_id").alias("_e2"), "p1_elo", "p2_elo")
    j = features.join(e, (features.match_id == e.match_id) & (features.p1_id == e._e1) & (features.p2_id == e._e2), "left")
    return (j.drop(e.match_id).drop("_e1", "_e2")
            .withColumns({"p1_elo": F.coalesce("p1_elo", F.lit(initial)), "p2_elo": F.coalesce("p2_elo", F.lit(initial))})
            .withColumn("elo_diff", F.col("p1_elo") - F.col("p2_elo")))


def join_odds(features: DataFrame, market: DataFrame) -> DataFrame:
    """Attach p1/p2 prices by match id (left join), with implied probabilities (missing → 0)
    and margin."""
    m = market.select(F.col("match_id").alias("_mm"), F.col("p1_odds").alias("_o1"), F.col("p2_odds").alias("_o2"))
    j = features.join(m, features.match_id == m._mm, "left").drop("_mm")
    j = j.withColumns({"p1_odds": F.coalesce("_o1", *(["p1_odds"] if "p1_odds" in features.columns else [])),
                       "p2_odds": F.coalesce("_o2", *(["p2_odds"] if "p2_odds" in features.columns else []))}).drop("_o1", "_o2")
    j = j.withColumns({"p1_implied_prob": implied_prob("p1_odds"), "p2_implied_prob": implied_prob("p2_odds")})
    return j.withColumn("book_margin", book_margin("p1_implied_prob", "p2_implied_prob"))


def join_side_features(keyed_rows: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Player rows (carrying their match's p1_id / p2_id) → one row per match with p1_/p2_
    columns: the two side joins of the reference as one conditional aggregation."""
    aggs = []
    for c in feature_cols:
        aggs.append(F.max(F.when(F.col("player_id") == F.col("p1_id"), F.col(c))).alias(f"p1_{c}"))
        aggs.append(F.max(F.when(F.col("player_id") == F.col("p2_id"), F.col(c))).alias(f"p2_{c}"))
    return keyed_rows.groupBy("match_id").agg(*aggs)


def diff_features(features: DataFrame) -> DataFrame:
    """Side differences (rank, Elo, load) where both sides are present."""
    pairs = {"rank_diff": ("p1_rank", "p2_rank"), "elo_diff": ("p1_elo", "p2_elo"),
             "fatigue_diff_7_days": ("p1_matches_last_7_days", "p2_matches_last_7_days"),
             "fatigue_diff_14_days": ("p1_matches_last_14_days", "p2_matches_last_14_days"),
             "fatigue_sets_diff_7_days": ("p1_sets_played_last_7_days", "p2_sets_played_last_7_days"),
             "fatigue_sets_diff_14_days": ("p1_sets_played_last_14_days", "p2_sets_played_last_14_days")}
    have = set(features.columns)
    return features.withColumns({k: F.col(a) - F.col(b) for k, (a, b) in pairs.items() if a in have and b in have})
