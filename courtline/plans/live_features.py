"""The live feature row: what the model reads of a market, as known when a book update came.

Every lookup is a point-in-time pass of ``operators``: the update becomes a probe in the history's
own order, so nothing that happened at or after it can be seen, in a replay as little as live, and
no update meets a player's whole history.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.pricing import book_margin, elo_prob, implied_prob
from ..functions.text import hand_default, surface_of_market
from ..operators import pairs, pit
from ..params import EloParams
from ..streaming.live import filter_two_runner
from .features import diff_features, meet, player_rows

DAY = 86_400
LOADS = {"matches_last_7_days": "n_7", "matches_last_14_days": "n_14", "sets_played_last_7_days": "sets_7",
         "sets_played_last_14_days": "sets_14"}
# a single update has no position in a player's series: the live row holds 0 there
POSITIONAL = ["form", "rolling_win_perc_20", "rolling_win_perc_50"]


def elo_after(matches: DataFrame, elo: DataFrame, p: EloParams = EloParams()) -> DataFrame:
    """(player_id, surface, ts, match_id, rating): each player's rating once the match was played."""
    e = elo.select("match_id", "p1_id", "p1_elo", "p2_elo")
    j = matches.select("match_id", "surface", F.col("tourney_date").alias("ts"), "winner_id", "loser_id").join(e, "match_id")
    first = F.col("winner_id") == F.col("p1_id")
    j = j.withColumns({"_w": F.when(first, F.col("p1_elo")).otherwise(F.col("p2_elo")), "_l": F.when(first, F.col("p2_elo")).otherwise(F.col("p1_elo"))})
    gain = F.lit(float(p.k_factor)) * (F.lit(1.0) - elo_prob("_w", "_l"))
    each = F.array(F.struct(F.col("winner_id").alias("player_id"), (F.col("_w") + gain).alias("rating")),
                   F.struct(F.col("loser_id").alias("player_id"), (F.col("_l") - gain).alias("rating")))
    return j.select("surface", "ts", "match_id", F.explode(each).alias("_e")).select("_e.player_id", "surface", "ts", "match_id", "_e.rating")


def _key(*columns: str):
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _share(wins: str, n: str):
    return F.coalesce(F.try_divide(F.col(wins).cast("double"), F.col(n).cast("double")), F.lit(0.0))


def live_features(books: DataFrame, matches: DataFrame, *, rankings: DataFrame | None = None, ratings: DataFrame | None = None,
                  players: DataFrame | None = None) -> DataFrame:
    """One row per two-runner book update with the whole feature row of its market; p1 is the first runner.

    ``matches``: the match log; ``rankings``: player, ranking_date, event_id, rank; ``ratings``: as from
    ``elo_after``; ``players``: player_id, hand. History counts strictly before the update's ``ts``, ranks
    up to it. Without history: shares and counts 0, rank 500, rating 1500, hand 'U'; without a price:
    implied probability 0. The positional features are 0, as a single row has no series. An update
    without a market id or a time has no history. Repeated updates give a row each."""
    m = filter_two_runner(books).select(
        "market_id", "ts", "market_name", "competition", "event_name", "market_time", surface_of_market("market_name").alias("surface"),
        *[F.col("runners")[i][field].alias(f"p{i + 1}_{out}") for i in (0, 1)
          for field, out in (("selection_id", "id"), ("runner_name", "name"), ("best_back", "odds"))])
    m = m.withColumn("_q", F.concat_ws("|", F.coalesce("market_id", F.lit("")), F.coalesce(F.unix_micros("ts").cast("string"), F.lit("")),
                                       "p1_id", "p2_id", "surface"))
    asked = m.select("_q", "ts", "surface", "p1_id", "p2_id").distinct()
    sides = (asked.select("_q", "ts", "surface", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"p{i}_id").alias("player_id"))
                                                                     for i in (1, 2)])).alias("_s"))
             .select(F.concat_ws("|", "_q", "_s.side").alias("_qs"), "ts", "surface", "_s.player_id"))
    on_surface = sides.withColumn("_ps", _key("player_id", "surface"))

    rows = player_rows(matches)
    before = partial(pit.history_before, ts="ts", qid="_qs")
    wins, sets = F.col("won").cast("bigint"), F.col("sets_played").cast("bigint")
    total = before(sides, rows, key="player_id", values={"wins": wins, "sets": sets}, spans={"7": 7 * DAY, "14": 14 * DAY})
    parts = [total.select("_qs", _share("wins", "n").alias("win_perc"), *[F.col(c).cast("bigint").alias(n) for n, c in LOADS.items()]),
             before(on_surface, rows.withColumn("_ps", _key("player_id", "surface")), key="_ps", values={"wins": wins})
             .select("_qs", _share("wins", "n").alias("surface_win_perc"))]
    if rankings is not None:
        asking = sides.select("_qs", "player_id", "ts", F.lit(0).alias("_no"))
        parts.append(pairs.asof_rank_join(asking, rankings, date="ts", left_id="_no").select("_qs", "rank"))
    if ratings is not None:
        r = ratings.select(_key("player_id", "surface").alias("_rs"), F.col("ts").alias("_rt"), F.col("match_id").alias("_rid"), "rating")
        parts.append(pairs.asof_join(on_surface.select("_qs", "_ps", "ts", F.lit(0).alias("_no")), r, left_key="_ps", left_ts="ts", left_id="_no", right_key="_rs",
                                     right_ts="_rt", right_id="_rid", values=["rating"], inclusive=False)
                     .select("_qs", F.coalesce("rating", F.lit(params.ELO_INITIAL_RATING)).alias("elo")))
    if players is not None:
        hands = players.select("player_id", "hand")
        parts.append(sides.join(hands, "player_id", "left").select("_qs", hand_default("hand").alias("hand")))
    each = meet(parts, "_qs")
    names = [c for c in each.columns if c != "_qs"]
    both = each.groupBy(F.expr("substring(_qs, 1, length(_qs) - 2)").alias("_q")).agg(
        *[F.expr(f"max(if(right(_qs, 1) = '{i}', `{c}`, NULL)) AS p{i}_{c}") for c in names for i in (1, 2)])

    met = matches.where("winner_id IS NOT NULL AND loser_id IS NOT NULL").select(F.col("tourney_date").alias("ts"), F.least("winner_id", "loser_id").alias("_lo"),
                         F.greatest("winner_id", "loser_id").alias("_hi"), "winner_id").withColumn("_pair", _key("_lo", "_hi"))
    ask_pair = asked.select("_q", "ts", F.least("p1_id", "p2_id").alias("_lo"), F.greatest("p1_id", "p2_id").alias("_hi")).withColumn("_pair", _key("_lo", "_hi"))
    h2h = pit.history_before(ask_pair, met, key="_pair", ts="ts", qid="_q", values={"_low_wins": (F.col("winner_id") == F.col("_lo")).cast("bigint")})
    out = m.join(meet([both, h2h.select("_q", F.col("n").alias("_met"), "_low_wins")], "_q"), "_q").drop("_q")
    high = F.col("_met") - F.col("_low_wins")
    low_first = F.col("p1_id") < F.col("p2_id")
    out = out.withColumns({"h2h_p1_wins": F.when(low_first, F.col("_low_wins")).otherwise(high),
                           "h2h_p2_wins": F.when(low_first, high).otherwise(F.col("_low_wins")),
                           "p1_implied_prob": implied_prob("p1_odds"), "p2_implied_prob": implied_prob("p2_odds")}).drop("_met", "_low_wins")
    out = out.withColumns({"book_margin": book_margin("p1_implied_prob", "p2_implied_prob"),
                           **{f"p{i}_{c}": F.lit(0.0) for c in POSITIONAL for i in (1, 2)}})
    return diff_features(out)
