"""Parameters of the pipeline.

Fixed values: the numbers, keyword lists and tables below must equal the reference's for the
results to agree. They are stated here once, in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------- fixed values
ELO_K_FACTOR = 32
ELO_RATING_DIFF_FACTOR = 400
ELO_INITIAL_RATING = 1500.0
DEFAULT_PLAYER_RANK = 500

MAPPING_CONFIDENCE_THRESHOLD = 85.0

EV_THRESHOLD = 0.10
CONFIDENCE_THRESHOLD = 0.52
COMMISSION = 0.05
LIVE_BANKROLL = 1000.0
LIVE_KELLY_FRACTION = 0.10
LIVE_MAX_KELLY_STAKE_FRACTION = 0.05
LIVE_MIN_STAKE = 0.03
LIVE_MIN_BANKROLL = 10.0
LIVE_MAX_DAILY_LOSS = 50.0
LIVE_MAX_EXPOSURE = 200.0
PROFITABLE_TOURNAMENTS = ["Grand Slam", "Masters 1000", "ATP / WTA Tour", "Challenger", "ITF / Futures"]

SIM_MAX_KELLY_STAKE_FRACTION = 0.1
SIM_MAX_PROFIT_PER_BET = 10000.0
INITIAL_BANKROLL = 1000.0

BOOKMAKER_MARGIN = 1.05
BACKTEST_MAX_ODDS = 50.0

MIN_BETS_FOR_SUMMARY = 100
LEADERBOARD_TOP_N = 25
ODDS_BINS = [1, 1.5, 2, 2.5, 3, 5, 10, 20]
EV_BINS = [-0.1, 0, 0.05, 0.1, 0.15, 0.2, 0.5, 1.0]
RANK_BINS = [-1000, -200, -100, -50, 0, 50, 100, 200, 1000]

# (name, min_odds, max_odds, min_ev) — inclusive boxes
STRATEGIES = [
    ("High Confidence (Odds < 3.0)", 1.01, 3.0, 0.15),
    ("Value Outsiders (Odds 3.0 - 6.0)", 3.0, 6.0, 0.20),
]

ORDER_TIMEOUT_SECONDS = 120
POLL_HOURS_AHEAD = 12
STREAM_LIMIT = 195
DECISION_WINDOW_SECONDS = (60, 3600)  # strict on both ends

SURFACES = ["Hard", "Clay", "Grass", "Unknown"]
SURFACE_TAGS = [("(clay)", "Clay"), ("(grass)", "Grass"), ("(hard)", "Hard")]
GRASS_KEYWORDS = ["wimbledon", "queens club", "halle", "'s-hertogenbosch", "newport"]
CLAY_KEYWORDS = ["roland garros", "french open", "monte carlo", "madrid", "rome"]

# ordered: the first keyword found in the lower-cased name wins
TOURNAMENT_CATEGORIES = [
    ("utr", "UTR / Pro Series"),
    ("grand slam", "Grand Slam"),
    ("australian open", "Grand Slam"),
    ("roland garros", "Grand Slam"),
    ("french open", "Grand Slam"),
    ("wimbledon", "Grand Slam"),
    ("us open", "Grand Slam"),
    ("masters", "Masters 1000"),
    ("tour finals", "Tour Finals"),
    ("next gen finals", "Tour Finals"),
    ("atp cup", "Team Event"),
    ("davis cup", "Team Event"),
    ("laver cup", "Team Event"),
    ("olympics", "Olympics"),
    ("challenger", "Challenger"),
    ("chall", "Challenger"),
    ("itf", "ITF / Futures"),
    ("futures", "ITF / Futures"),
]
DEFAULT_CATEGORY = "ATP / WTA Tour"

# mapping cascade: (method, confidence) in pass order
MAPPING_METHODS = [
    ("Exact", 100.0),
    ("Exact-Cleaned", 99.5),
    ("Initial+Lastname", 99.0),
    ("Unique Lastname", 98.0),
    ("Fuzzy", None),
]
# ---------------------------------------------------------------- end of fixed values


@dataclass(frozen=True)
class EloParams:
    k_factor: float = ELO_K_FACTOR
    rating_diff_factor: float = ELO_RATING_DIFF_FACTOR
    initial_rating: float = ELO_INITIAL_RATING


@dataclass(frozen=True)
class BettingParams:
    ev_threshold: float = EV_THRESHOLD
    confidence_threshold: float = CONFIDENCE_THRESHOLD
    commission: float = COMMISSION


@dataclass(frozen=True)
class SimParams:
    initial_bankroll: float = INITIAL_BANKROLL
    strategy: str = "kelly"  # kelly | flat | percent
    stake_unit: float = 10.0
    kelly_fraction: float = 0.5
    max_stake_cap: float = 1.0
    max_kelly_stake_fraction: float = SIM_MAX_KELLY_STAKE_FRACTION
    max_profit_per_bet: float = SIM_MAX_PROFIT_PER_BET


@dataclass(frozen=True)
class LiveParams:
    ev_threshold: float = EV_THRESHOLD
    confidence_threshold: float = 0.0
    bankroll: float = LIVE_BANKROLL
    kelly_fraction: float = LIVE_KELLY_FRACTION
    max_kelly_stake_fraction: float = LIVE_MAX_KELLY_STAKE_FRACTION
    min_stake: float = LIVE_MIN_STAKE
    min_bankroll: float = LIVE_MIN_BANKROLL
    categories: tuple = tuple(PROFITABLE_TOURNAMENTS)
    order_timeout_seconds: int = ORDER_TIMEOUT_SECONDS
    max_daily_loss: float = LIVE_MAX_DAILY_LOSS
    max_exposure: float = LIVE_MAX_EXPOSURE
    window_seconds: tuple = field(default=DECISION_WINDOW_SECONDS)
