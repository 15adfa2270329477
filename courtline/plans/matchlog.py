"""Match log and market table builders (odds + player map + history → match_log / market_data)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sets_played, surface_of
from ..operators.markets import filter_settled, first_last_runner, join_player_map, join_winner_loser

MATCH_LOG_COLS = ["match_id", "tourney_date", "tourney_name", "surface", "winner_id", "winner_historical_id",
                  "winner_name", "loser_id", "loser_historical_id", "loser_name", "score", "sets_played"]


def dedup_history_lookup(history: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One history row per (calendar date, p1 = smaller id, p2 = larger id): exact duplicates
    removed, then the last row by ``order`` kept (``max_by`` — a partial aggregate, no window)."""
    h = history.select(F.to_date("tourney_date").alias("d"), F.least("winner_id", "loser_id").alias("p1_id"),
                       F.greatest("winner_id", "loser_id").alias("p2_id"), "tourney_name", "score",
                       *(order or [])).distinct()
    key = F.struct(*[F.col(c) for c in (order or [])], F.col("tourney_name"), F.col("score"))
    return h.groupBy("d", "p1_id", "p2_id").agg(F.max_by(F.struct("tourney_name", "score"), key).alias("_h")) \
            .select("d", "p1_id", "p2_id", F.col("_h.tourney_name").alias("h_tourney_name"), F.col("_h.score").alias("h_score"))


def join_history_lookup(matches: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join on (calendar date, smaller id, larger id); the history only fills a missing name."""
    m = matches.withColumns({"_d": F.to_date("tourney_date"),
                             "_p1": F.least("winner_historical_id", "loser_historical_id"),
                             "_p2": F.greatest("winner_historical_id", "loser_historical_id")})
    j = m.join(lookup, (m._d == lookup.d) & (m._p1 == lookup.p1_id) & (m._p2 == lookup.p2_id), "left")
    return j.withColumn("tourney_name", F.coalesce("tourney_name", "h_tourney_name")) \
            .withColumn("score", F.col("h_score")) \
            .drop("_d", "_p1", "_p2", "d", "p1_id", "p2_id", "h_tourney_name", "h_score")


def build_match_log(odds: DataFrame, player_map: DataFrame, history: DataFrame | None = None,
                    history_order: list[str] | None = None) -> DataFrame:
    """Settled two-runner markets with historical ids, tournament name / score from the
    history lookup, surface from the name and sets from the score."""
    mapped = join_player_map(odds, player_map)
    settled = filter_settled(mapped, "historical_id")
    is_w, is_l = F.col("result") == "WINNER", F.col("result") == "LOSER"
    wl = join_winner_loser(settled.withColumn("selection_id", F.col("selection_id")))
    ids = settled.groupBy(F.col("market_id").alias("match_id")).agg(
        F.max(F.when(is_w, F.col("historical_id"))).alias("winner_historical_id"),
        F.max(F.when(is_l, F.col("historical_id"))).alias("loser_historical_id"),
        F.max(F.when(is_w, F.col("selection_name"))).alias("winner_name") if "selection_name" in odds.columns
        else F.lit(None).cast("string").alias("winner_name"),
        F.max(F.when(is_l, F.col("selection_name"))).alias("loser_name") if "selection_name" in odds.columns
        else F.lit(None).cast("string").alias("loser_name"))
    m = wl.join(ids, "match_id")
    if history is not None:
        m = join_history_lookup(m, dedup_history_lookup(history, history_order))
    else:
        m = m.withColumn("score", F.lit(None).cast("string"))
    m = m.withColumn("surface", surface_of("tourney_name")).withColumn("sets_played", sets_played("score"))
    return m.select(*MATCH_LOG_COLS)


def canonical_market(md: DataFrame) -> DataFrame:
    """p1 = smaller id everywhere (the feature table's convention): swap sides where needed."""
    swap = F.col("p1_id") > F.col("p2_id")

    def pick(a, b):
        return F.when(swap, F.col(b)).otherwise(F.col(a))
    return md.select("match_id", "tourney_date", "tourney_name", "surface",
                     pick("p1_id", "p2_id").alias("p1_id"), pick("p2_id", "p1_id").alias("p2_id"),
                     pick("p1_odds", "p2_odds").alias("p1_odds"), pick("p2_odds", "p1_odds").alias("p2_odds"),
                     F.when(swap, F.lit(1) - F.col("winner")).otherwise(F.col("winner")).alias("winner"),
                     pick("p1_implied_prob", "p2_implied_prob").alias("p1_implied_prob"),
                     pick("p2_implied_prob", "p1_implied_prob").alias("p2_implied_prob"), "book_margin")


def build_market_data(odds: DataFrame, player_map: DataFrame, order: list[str]) -> DataFrame:
    """Markets with exactly two mapped runners: first / last runner (by ``order``) with ids
    replaced by historical ids, then put in canonical order (p1 = smaller id), with implied
    probabilities and margin."""
    mapped = join_player_map(odds, player_map).withColumn("selection_id", F.col("historical_id"))
    return canonical_market(first_last_runner(mapped, order, prob_col=None))


def join_backtest_market(features: DataFrame, market: DataFrame) -> DataFrame:
    """Realistic back-test input: features ⋈ market table on (p1_id, p2_id, calendar date);
    market-side odds, probabilities and winner win (explicit projection, no suffixes)."""
    f = features.withColumn("_d", F.to_date("tourney_date"))
    mk = market.select(F.col("match_id").alias("m_match_id"), F.col("p1_id").alias("m_p1"), F.col("p2_id").alias("m_p2"),
                       F.to_date("tourney_date").alias("m_d"), F.col("p1_odds").alias("m_p1_odds"),
                       F.col("p2_odds").alias("m_p2_odds"), F.col("winner").alias("m_winner"),
                       F.col("p1_implied_prob").alias("m_p1_ip"), F.col("p2_implied_prob").alias("m_p2_ip"),
                       F.col("book_margin").alias("m_margin"))
    j = f.join(mk, (f.p1_id == mk.m_p1) & (f.p2_id == mk.m_p2) & (f._d == mk.m_d), "inner")
    drop = [c for c in ("p1_odds", "p2_odds", "winner", "p1_implied_prob", "p2_implied_prob", "book_margin") if c in f.columns]
    return (j.drop(*drop).withColumnsRenamed({"m_p1_odds": "p1_odds", "m_p2_odds": "p2_odds", "m_winner": "winner",
                                              "m_p1_ip": "p1_implied_prob", "m_p2_ip": "p2_implied_prob",
                                              "m_margin": "book_margin"})
            .drop("_d", "m_p1", "m_p2", "m_d"))
