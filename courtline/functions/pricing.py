"""Pricing column expressions: implied probability, margin, Elo probability, EV, Kelly, P&L."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def implied_prob(odds) -> Column:
    """1 / odds; 0 when the price is missing or not positive (never ∞)."""
    price = F.nanvl(_c(odds).cast("double"), F.lit(None).cast("double"))
    return F.coalesce(F.when(price > 0, F.lit(1.0) / price), F.lit(0.0))


def book_margin(p1_prob, p2_prob) -> Column:
    """Sum of both probabilities less one; 0 when either price is missing."""
    both = (_c(p1_prob) > 0) & (_c(p2_prob) > 0)
    return F.when(both, _c(p1_prob) + _c(p2_prob) - F.lit(1.0)).otherwise(F.lit(0.0))


def elo_prob(rating, opponent, factor: float = params.ELO_RATING_DIFF_FACTOR) -> Column:
    """Win probability of ``rating`` against ``opponent``."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (_c(opponent) - _c(rating)) / F.lit(float(factor))))


def elo_sim_odds(prob, margin: float = params.BOOKMAKER_MARGIN, max_odds: float = params.BACKTEST_MAX_ODDS) -> Column:
    """Bookmaker-style odds from a probability: (1/p)/margin, capped; p ≤ 0 → the cap."""
    return F.least(F.when(_c(prob) > 0, (F.lit(1.0) / _c(prob)) / F.lit(margin)).otherwise(F.lit(max_odds)),
                   F.lit(max_odds))


def expected_value(prob, odds) -> Column:
    """p·(o − 1) − (1 − p)."""
    return _c(prob) * (_c(odds) - F.lit(1.0)) - (F.lit(1.0) - _c(prob))


def kelly_fraction(prob, odds, commission: float = 0.0) -> Column:
    """Kelly stake fraction, floored at 0; 0 when odds ≤ 1. With a commission c the net
    odds (o − 1)(1 − c) are used."""
    p, o = _c(prob), _c(odds)
    if commission > 0:
        k = p - (F.lit(1.0) - p) / ((o - F.lit(1.0)) * F.lit(1.0 - commission))
    else:
        k = expected_value(p, o) / (o - F.lit(1.0))
    return F.when(o > 1, F.greatest(F.lit(0.0), k)).otherwise(F.lit(0.0))


def live_expected_value(prob, odds) -> Column:
    """Live form: p·o − 1."""
    return _c(prob) * _c(odds) - F.lit(1.0)


def kelly_live(prob, odds) -> Column:
    """EV / (o − 1) when o > 1, floored at 0."""
    ev = live_expected_value(prob, odds)
    return F.when(_c(odds) > 1, F.greatest(F.lit(0.0), ev / (_c(odds) - F.lit(1.0)))).otherwise(F.lit(0.0))


def flat_pnl(odds, winner, commission: float = params.COMMISSION) -> Column:
    """Unit-stake profit: (o − 1)(1 − c) on a win, −1 otherwise."""
    return F.when(_c(winner) == 1, (_c(odds) - F.lit(1.0)) * F.lit(1.0 - commission)).otherwise(F.lit(-1.0))


def label_winner(winner_id, p1_id) -> Column:
    return (_c(winner_id) == _c(p1_id)).cast("int")


def patch_winner(col) -> Column:
    """Coerce a winner flag: non-numeric / NULL → 0, then integer."""
    return F.coalesce(_c(col).cast("string").try_cast("double"), F.lit(0.0)).cast("int")


def selection_key(market_id, selection_id) -> Column:
    return F.concat_ws("-", _c(market_id).cast("string"), _c(selection_id).cast("string"))


def format_pct(x, signed: bool = False) -> Column:
    """0.2 → '20.00%' (or '+20.00%')."""
    return F.format_string("%+.2f%%" if signed else "%.2f%%", _c(x) * 100)
