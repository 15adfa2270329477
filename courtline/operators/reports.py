"""Back-test and reports: value bets, P&L, category summary, KPIs, strategy boxes, bins,
leaderboard, tournament lists, report filters."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions.pricing import elo_prob, elo_sim_odds, expected_value, flat_pnl, kelly_fraction
from ..functions.text import tournament_category
from .reshape import unpivot_bets

BET_BASE = ["market_id", "tourney_name", "tourney_date", "surface"]


def price_bets(bets: DataFrame, commission: float = 0.0) -> DataFrame:
    """Add expected value and Kelly fraction (``add_ev_and_kelly``)."""
    return bets.withColumns({"expected_value": expected_value("predicted_prob", "odds"),
                             "kelly_fraction": kelly_fraction("predicted_prob", "odds", commission)})


def backtest(markets: DataFrame, *, ev_threshold: float = params.EV_THRESHOLD,
             confidence_threshold: float = params.CONFIDENCE_THRESHOLD, commission: float = params.COMMISSION,
             mode: str = "realistic", p1_prob: str = "p1_predicted_prob") -> DataFrame:
    """Value bets of a scored market table.

    ``markets``: one row per match with match_id, tourney_*, surface, p1/p2 ids and odds,
    ``winner`` (1 = p1 won) and the model's p1 probability. ``mode='simulation'`` first
    prices both sides from Elo ratings (``p1_elo``/``p2_elo``) with a bookmaker margin.
    Each market becomes two bets (p2: 1 − p, 1 − winner), priced, filtered strictly on
    EV and probability, and settled at unit stake with the exchange commission.
    """
    if mode == "simulation":
        markets = markets.withColumn("_p1e", elo_prob("p1_elo", "p2_elo")) \
            .withColumns({"p1_odds": elo_sim_odds(F.col("_p1e")), "p2_odds": elo_sim_odds(F.lit(1.0) - F.col("_p1e"))}) \
            .drop("_p1e")
    elif mode != "realistic":
        raise ValueError(f"Invalid mode '{mode}'. Choose 'simulation' or 'realistic'.")
    m = markets.withColumnRenamed("match_id", "market_id")
    for price in ("p1_odds", "p2_odds"):  # NaN is a missing price; left as it is, it would pass every filter
        m = m.withColumn(price, F.nanvl(F.col(price).cast("double"), F.lit(None).cast("double")))
    bets = price_bets(unpivot_bets(m, base=BET_BASE, p1_prob=p1_prob))
    value = bets.where((F.col("expected_value") > ev_threshold) & (F.col("predicted_prob") > confidence_threshold))
    return value.withColumns({"pnl": flat_pnl("odds", "winner", commission),
                              "bet_id": F.col("market_id") * 2 + F.col("side") - 1})


def with_pnl(bets: DataFrame, commission: float = params.COMMISSION) -> DataFrame:
    """Add unit-stake P&L unless a non-empty ``pnl`` column is already there.

    Deciding "non-empty" needs one look at the data (a bounded ``limit(1)`` probe)."""
    if "pnl" in bets.columns and bets.where(F.col("pnl").isNotNull()).limit(1).count() > 0:
        return bets
    return bets.withColumn("pnl", flat_pnl("odds", "winner", commission))


def summary_by_category(bets: DataFrame, min_bets: int = 1) -> DataFrame:
    """Per (tournament category, surface): bets, wins, mean odds, P&L, win rate %, ROI %;
    groups below ``min_bets`` dropped; ordered by ROI descending."""
    g = (bets.withColumn("tourney_category", tournament_category("tourney_name"))
         .where(F.col("surface").isNotNull())
         .groupBy("tourney_category", "surface")
         .agg(F.count(F.lit(1)).alias("total_bets"), F.sum("winner").alias("total_wins"),
              F.avg("odds").alias("avg_odds"), F.sum("pnl").alias("total_pnl")))
    g = g.withColumns({"win_rate": F.col("total_wins") / F.col("total_bets") * 100,
                       "roi": F.col("total_pnl") / F.col("total_bets") * 100})
    return g.where(F.col("total_bets") >= min_bets).orderBy(F.col("roi").desc(), "tourney_category", "surface")


def kpi_overall(bets: DataFrame) -> DataFrame:
    return bets.agg(F.count(F.lit(1)).alias("total_bets"), F.sum("pnl").alias("total_pnl"),
                    (F.sum("pnl") / F.count(F.lit(1)) * 100).alias("roi"),
                    (F.sum("winner") / F.count(F.lit(1)) * 100).alias("win_rate"),
                    F.avg("odds").alias("avg_odds"))


def strategies_frame(spark: SparkSession, strategies=params.STRATEGIES) -> DataFrame:
    return spark.createDataFrame([(n, float(a), float(b), float(e)) for n, a, b, e in strategies],
                                 "name string, min_odds double, max_odds double, min_ev double")


def kpi_by_strategy(bets: DataFrame, strategies: DataFrame) -> DataFrame:
    """KPIs per named strategy box (inclusive odds range, minimum EV). Boxes may overlap.
    The strategy table is a parameter list (a handful of rows) — broadcast, one pass."""
    j = bets.join(F.broadcast(strategies), (F.col("odds") >= F.col("min_odds")) & (F.col("odds") <= F.col("max_odds"))
                  & (F.col("expected_value") >= F.col("min_ev")), "inner")
    return j.groupBy("name").agg(F.count(F.lit(1)).alias("total_bets"), F.sum("pnl").alias("total_pnl"),
                                 (F.sum("pnl") / F.count(F.lit(1)) * 100).alias("roi"),
                                 (F.sum("winner") / F.count(F.lit(1)) * 100).alias("win_rate"),
                                 F.avg("odds").alias("avg_odds"))


def bin_edges(bins) -> list[float]:
    return sorted(set([-math.inf] + [float(b) for b in bins] + [math.inf]))


def right_closed_bin(col: Column, bins) -> Column:
    """(lo, hi] of the bin holding ``col`` as a struct; NULL for NULL. A CASE over the fixed
    edges — no join, stays in codegen."""
    edges = bin_edges(bins)
    expr = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = (col > F.lit(lo)) & (col <= F.lit(hi))
        val = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def bucket_summary(bets: DataFrame, column: str, bins) -> DataFrame:
    """Bets, P&L and ROI per right-closed bin of ``column``; only non-empty bins."""
    b = bets.withColumn("_bin", right_closed_bin(F.col(column), bins)).where(F.col("_bin").isNotNull())
    g = b.groupBy(F.col("_bin.lo").alias("bin_lo"), F.col("_bin.hi").alias("bin_hi")).agg(
        F.count("market_id").alias("bets"), F.sum("pnl").alias("pnl"))
    return g.where(F.col("bets") > 0).withColumn("roi", F.col("pnl") / F.col("bets") * 100)


def topk_leaderboard(summary: DataFrame, sort_by: str = "roi", top_n: int = params.LEADERBOARD_TOP_N) -> DataFrame:
    """Top ``top_n`` rows by ``sort_by`` (a TakeOrderedAndProject: per-partition top-n, then merge)."""
    keys = [F.col(sort_by).desc()] + [F.col(c) for c in summary.columns if c != sort_by]
    return summary.orderBy(*keys).limit(top_n)


def filter_year(df: DataFrame, year: int, ts: str = "tourney_date") -> DataFrame:
    """Rows of one calendar year as a half-open timestamp range (prunes parquet row groups)."""
    lo = F.lit(datetime(year, 1, 1)).cast("timestamp")
    hi = F.lit(datetime(year + 1, 1, 1)).cast("timestamp")
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))


def list_tournaments(df: DataFrame, year: int | None = None, name: str = "tourney_name", ts: str = "tourney_date") -> DataFrame:
    if year is not None:
        df = filter_year(df, year, ts)
    return df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name)


def filter_report(bets: DataFrame, *, date_range=None, odds_range=None, ev_range=None, ts: str = "tourney_date") -> DataFrame:
    """Closed-range conjunction on date, odds and EV (each optional)."""
    cond = F.lit(True)
    if date_range:
        cond = cond & F.col(ts).between(F.lit(date_range[0]).cast("timestamp"), F.lit(date_range[1]).cast("timestamp"))
    if odds_range:
        cond = cond & F.col("odds").between(odds_range[0], odds_range[1])
    if ev_range:
        cond = cond & F.col("expected_value").between(ev_range[0], ev_range[1])
    return bets.where(cond)


def tail_history(bets: DataFrame, n: int = 200, order: tuple = ("tourney_date", "bet_id")) -> DataFrame:
    """Latest ``n`` rows by a total order."""
    return bets.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """``n`` pseudo-random rows, reproducible: smallest MD5 of seed and key — a top-n, no
    full sort, no driver-side collection."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)


def load_bets_report(bets: DataFrame, features: DataFrame | None = None, commission: float = params.COMMISSION) -> DataFrame:
    """Bets for the dashboard: P&L added if absent; ``rank_diff`` from the features (0 when
    there is none)."""
    b = with_pnl(bets, commission)
    if features is not None and "rank_diff" in features.columns:
        f = features.select(F.col("match_id").alias("_fm"), "rank_diff")
        b = b.join(f, b.market_id == f._fm, "left").drop("_fm")
        b = b.withColumn("rank_diff", F.coalesce("rank_diff", F.lit(0)))
    else:
        b = b.withColumn("rank_diff", F.lit(0))
    return b
