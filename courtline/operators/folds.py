"""Ordered stateful folds: Elo ratings, bankroll paths, risk gate, drawdown.

Elo and the capped bankroll are genuinely sequential: each step reads the state the
previous step wrote. They run as grouped folds (``applyInPandas``, iterator form, so a
group streams through in Arrow batches instead of being loaded whole); the state is small
(one rating per player of the surface, one bankroll per scenario). Input is
hash-partitioned by the group key and sorted inside each partition by (group, time, id),
which satisfies the grouping's ordering requirement, so Spark adds no second sort and the
batches arrive in time order; the fold checks the order and fails loudly otherwise.

Everything that is a prefix sum/min/max in disguise (closed-form bankroll growth,
drawdown, daily loss gate) is written with running aggregates instead — pure
Catalyst, no Python, no single-task group.
"""

# no postponed annotations here: the grouped folds are recognised by their runtime type hints
import math
from collections.abc import Iterator
from functools import reduce
from itertools import count
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import EloParams, LiveParams, SimParams
from .running import Agg, running

ELO_SCHEMA = "match_id long, surface string, p1_id long, p2_id long, p1_elo double, p2_elo double"


def _check_order(prev, dates, ids):
    """Batches must arrive in (date, id) order; returns the last key."""
    if len(dates) == 0:
        return prev
    keys = list(zip(dates.tolist(), ids.tolist()))
    if prev is not None and keys[0] < prev:
        raise RuntimeError("fold input is not in time order")
    if any(keys[i + 1] < keys[i] for i in range(len(keys) - 1)):
        raise RuntimeError("fold input is not in time order")
    return keys[-1]


def player_components(edges: DataFrame, *, group: str = "surface", max_iter: int | None = None,
                      checkpoint_every: int = 5) -> DataFrame:
    """Connected components of the player graph per group, by min-label propagation.

    ``edges``: (group, a, b). Returns (group, player, component) with component = smallest
    player id reachable. Each round is one join + one aggregate; it stops when no label
    changes, and raises if ``max_iter`` rounds were not enough (a count per round — one number to the driver), and the label table is
    checkpointed every few rounds so the lineage stays short."""
    from ..session import cut_lineage
    und = (edges.select(group, F.col("a").alias("u"), F.col("b").alias("v"))
           .unionByName(edges.select(group, F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    und = cut_lineage(und)
    labels = und.groupBy(group, F.col("u").alias("player")).agg(F.least(F.col("u"), F.min("v")).alias("component"))
    labels = cut_lineage(labels)
    cached = []
    for i in count():
        if max_iter is not None and i >= max_iter:
            raise RuntimeError(f"labels still change after {max_iter} rounds")
        nb = (und.join(labels.withColumnRenamed("player", "v"), [group, "v"])
              .groupBy(group, F.col("u").alias("player")).agg(F.min("component").alias("_nc")))
        new = (labels.join(nb, [group, "player"], "left")
               .select(group, "player", F.least("component", F.coalesce("_nc", "component")).alias("component")))
        if (i + 1) % checkpoint_every == 0:
            new = cut_lineage(new)
        else:
            new = new.cache()
            cached.append(new)
        old = labels.withColumnRenamed("component", "_old")
        changed = new.join(old, [group, "player"]).where(F.col("component") != F.col("_old")).limit(1).count()
        labels = new
        if changed == 0:
            break
    labels = cut_lineage(labels)
    for c in cached:
        c.unpersist()
    return labels


def elo_ratings(matches: DataFrame, p: EloParams = EloParams(), *, surface: str = "surface",
                date: str = "tourney_date", match_id: str = "match_id", winner: str = "winner_id",
                loser: str = "loser_id", split_components: bool = False) -> DataFrame:
    """Pre-match Elo ratings per surface, reported as (p1 = smaller id, p2 = larger id).

    Rows with a missing id are dropped, duplicate match ids keep their first (earliest) row.
    Update after each match: Δ = K·(1 − P(winner)); winner +Δ, loser −Δ; unseen players start
    at the initial rating. Only five narrow columns cross into Python.
    """
    k, f, init = float(p.k_factor), float(p.rating_diff_factor), float(p.initial_rating)
    m = (matches.where(F.col(winner).isNotNull() & F.col(loser).isNotNull())
         .select(F.col(match_id).alias("match_id"), F.col(surface).alias("surface"), F.col(date).alias("d"),
                 F.col(winner).cast("long").alias("w"), F.col(loser).cast("long").alias("l")))
    first = (m.groupBy("match_id").agg(F.min_by(F.struct("surface", "d", "w", "l"), F.when(F.col("d").isNotNull(), F.struct("d", "w", "l"))).alias("_r"))
             .select("match_id", "_r.*"))
    group_cols = ["surface"]
    if split_components:
        # players of different components never meet, so their ratings evolve independently:
        # one fold per (surface, component) gives the same numbers with more parallel tasks
        comps = player_components(first.select("surface", F.col("w").alias("a"), F.col("l").alias("b")))
        first = first.join(comps.select("surface", F.col("player").alias("w"), F.col("component").alias("_comp")),
                           ["surface", "w"])
        group_cols = ["surface", "_comp"]
    prepared = (first.withColumn("_du", F.unix_micros("d"))
                .repartition(*group_cols).sortWithinPartitions(*group_cols, "_du", "match_id")
                .select(*group_cols, "_du", "match_id", "w", "l"))

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratings: dict[int, float] = {}
        last = None
        for b in batches:
            last = _check_order(last, b["_du"].to_numpy(), b["match_id"].to_numpy())
            w, lo, mid = b["w"].tolist(), b["l"].tolist(), b["match_id"].tolist()
            n = len(w)
            p1, p2 = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            e1, e2 = np.empty(n), np.empty(n)
            for i in range(n):
                a, c = w[i], lo[i]
                ra, rc = ratings.get(a, init), ratings.get(c, init)
                if a < c:
                    p1[i], p2[i], e1[i], e2[i] = a, c, ra, rc
                else:
                    p1[i], p2[i], e1[i], e2[i] = c, a, rc, ra
                delta = k * (1.0 - 1.0 / (1.0 + 10.0 ** ((rc - ra) / f)))
                ratings[a] = ra + delta
                ratings[c] = rc - delta
            yield pd.DataFrame({"match_id": np.asarray(mid, dtype=np.int64), "surface": key[0],
                                "p1_id": p1, "p2_id": p2, "p1_elo": e1, "p2_elo": e2})

    if split_components:
        def fold_component(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from fold((key[0],), batches)
        return prepared.groupBy("surface", "_comp").applyInPandas(fold_component, ELO_SCHEMA)
    return prepared.groupBy("surface").applyInPandas(fold, ELO_SCHEMA)


BANKROLL_SCHEMA = "scenario string, bet_id long, stake double, profit double, bankroll double"


def bankroll_sim(bets: DataFrame, p: SimParams = SimParams(), *, scenario: str = "scenario", date: str = "tourney_date",
                 bet_id: str = "bet_id") -> DataFrame:
    """Bankroll path per scenario, bets in (date, bet_id) order.

    Stake: kelly → B·min(kelly·fraction, max_kelly_fraction); flat → unit; percent → B·unit/100;
    then at most B·max_stake_cap and clamped to [0, B]. A win pays min(stake·(odds − 1),
    max_profit_per_bet), a loss costs the stake; rows with missing inputs stake 0. Rows
    without a date are dropped. Scale comes from the number of scenarios (a grid of
    strategies × fractions × caps × segments), each one a streamed fold with O(1) state.
    """
    share = stake_fraction(p)
    if p.strategy == "flat":
        share, fixed = F.lit(min(float(p.max_stake_cap), 1.0)), F.lit(float(p.stake_unit))
    elif share is not None:
        fixed = F.lit(math.inf)
    else:
        share, fixed = F.lit(0.0), F.lit(0.0)
    needed = ["odds", "kelly_fraction"] if p.strategy == "kelly" else ["odds"]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in needed])
    zero = F.lit(0.0)
    typed = bets.where(F.col(date).isNotNull()).select(
        F.col(scenario).cast("string").alias("scenario"), F.unix_micros(date).alias("_du"), F.col(bet_id).alias("bet_id"),
        F.col("winner").cast("int").alias("winner"), *[F.col(c).cast("double").alias(c) for c in ("odds", "kelly_fraction")])
    gain = F.when(F.col("winner") == 1, F.col("odds") - 1.0).otherwise(F.lit(-1.0))
    prepared = (typed.select("scenario", "_du", "bet_id", F.when(known, share).otherwise(zero).alias("share"),
                             F.when(known, fixed).otherwise(zero).alias("fixed"), F.when(known, gain).otherwise(zero).alias("gain"))
                .repartition("scenario").sortWithinPartitions("scenario", "_du", "bet_id"))
    start, most = float(p.initial_bankroll), float(p.max_profit_per_bet)

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank, last = start, None
        for b in batches:
            last = _check_order(last, b["_du"].to_numpy(), b["bet_id"].to_numpy())
            path = np.empty((len(b), 3))
            for i, (part, fixed, gain) in enumerate(zip(b["share"], b["fixed"], b["gain"])):
                stake = max(0.0, min(fixed, bank * part))
                profit = min(stake * gain, most)
                bank += profit
                path[i] = stake, profit, bank
            yield pd.DataFrame({"scenario": key[0], "bet_id": b["bet_id"].to_numpy(dtype=np.int64),
                                "stake": path[:, 0], "profit": path[:, 1], "bankroll": path[:, 2]})

    return prepared.groupBy("scenario").applyInPandas(fold, BANKROLL_SCHEMA)


def stake_fraction(p: SimParams = SimParams()):
    """Fraction of the current bankroll staked, for the strategies whose stake is
    proportional to it (kelly, percent); NULL for flat."""
    if p.strategy == "kelly":
        f = F.least(F.col("kelly_fraction") * F.lit(p.kelly_fraction), F.lit(p.max_kelly_stake_fraction))
    elif p.strategy == "percent":
        f = F.lit(p.stake_unit / 100.0)
    else:
        return None
    return F.greatest(F.lit(0.0), F.least(F.least(f, F.lit(p.max_stake_cap)), F.lit(1.0)))


def bankroll_closed_form(bets: DataFrame, p: SimParams = SimParams(), *, scenario: str = "scenario",
                         date: str = "tourney_date", bet_id: str = "bet_id") -> DataFrame:
    """Bankroll path when every stake is a fixed fraction of the bankroll and the profit cap
    never binds: B_t = B_0 · Π(1 + r_i), r_i = f_i·(o_i − 1) on a win, −f_i on a loss.

    The product is exp of a running sum of log1p(r) (no Python,
    no single-task scenario); a total loss (r = −1) zeroes every later bankroll via a
    running count. Also reports whether the profit cap would have bound (then the fold in
    ``bankroll_sim`` is the exact answer).
    """
    f = stake_fraction(p)
    if f is None:
        raise ValueError("closed form needs a proportional stake (kelly or percent)")
    r = F.when(F.col("winner") == 1, f * (F.col("odds") - F.lit(1.0))).otherwise(-f)
    base = (bets.where(F.col(date).isNotNull())
            .select(F.col(scenario).cast("string").alias("scenario"), F.col(date).alias("_t"),
                    F.col(bet_id).alias("bet_id"), "odds", "winner", r.alias("_r")))
    run = running(base, ["scenario"], ["_t", "bet_id"],
                  [Agg("_lg", "sum", F.when(F.col("_r") > -1, F.log1p("_r"))),
                   Agg("_ruin", "count", F.when(F.col("_r") <= -1, F.lit(1)))],
                  include_current=True)
    bank = F.when(F.col("_ruin") > 0, F.lit(0.0)).otherwise(F.lit(p.initial_bankroll) * F.exp(F.coalesce("_lg", F.lit(0.0))))
    out = run.select("scenario", "bet_id", bank.alias("bankroll"), F.coalesce("_lg", F.lit(0.0)).alias("log_growth"),
                     (F.col("_ruin") > 0).alias("ruined"), "_r", "odds", "winner")
    prev = out.withColumn("_prev", F.when(F.col("_r") > -1, F.col("bankroll") / (F.lit(1.0) + F.col("_r"))))
    return prev.select("scenario", "bet_id", "bankroll", "log_growth", "ruined",
                       (F.col("winner") == 1).alias("_won"),
                       (F.coalesce(F.col("_prev"), F.lit(0.0)) * F.col("_r") > F.lit(p.max_profit_per_bet)).alias("cap_binds")) \
               .drop("_won")


def max_drawdown(path: DataFrame, *, scenario: str = "scenario", date: str = "tourney_date", bet_id: str = "bet_id",
                 bankroll: str = "bankroll") -> DataFrame:
    """Per scenario: peak bankroll and the most negative (B − running peak) / running peak.
    The running peak includes the current row and (as in the reference) not the initial
    bankroll."""
    run = running(path, [scenario], [date, bet_id], [Agg("_peak", "max", F.col(bankroll))], include_current=True)
    dd = F.try_divide(F.col(bankroll) - F.col("_peak"), F.col("_peak"))
    return run.groupBy(scenario).agg(F.max("_peak").alias("peak_bankroll"),
                                     F.coalesce(F.min(dd), F.lit(0.0)).alias("max_drawdown"))


def risk_gate(bets: DataFrame, p: LiveParams = LiveParams(), *, account: str = "account", ts: str = "ts",
              bet_id: str = "bet_id", stake: str = "stake", pnl: str = "pnl") -> DataFrame:
    """Daily loss limit and exposure cap, per account and calendar day.

    A bet is blocked when its stake alone would exceed the exposure cap, or when the day's
    realised P&L has already reached −max_daily_loss. Blocked bets realise nothing, and
    once the loss limit is hit every later bet of the day is blocked, so the gate is a
    running sum (P&L of placed bets) followed by a running min — no fold needed.
    """
    base = bets.withColumn("_day", F.to_date(ts)).withColumn("_exp_ok", F.col(stake) <= F.lit(p.max_exposure))
    base = base.withColumn("_eff", F.when(F.col("_exp_ok"), F.col(pnl)).otherwise(F.lit(0.0)))
    run = running(base, [account, "_day"], [ts, bet_id], [Agg("_cum", "sum", F.col("_eff"))], include_current=True)
    run2 = running(run, [account, "_day"], [ts, bet_id], [Agg("_low", "min", F.col("_cum"))], include_current=False)
    loss_hit = F.coalesce(F.col("_low") <= F.lit(-p.max_daily_loss), F.lit(False))
    decision = F.when(loss_hit, F.lit("RISK_BLOCKED")).when(~F.col("_exp_ok"), F.lit("EXPOSED")).otherwise(F.lit("PLACE"))
    return run2.withColumn("decision", decision).drop("_cum", "_low", "_eff", "_exp_ok", "_day")


def daily_pnl(bets: DataFrame, *, ts: str = "tourney_date", pnl: str = "pnl") -> DataFrame:
    """Settled profit per calendar day (tumbling one-day windows)."""
    return (bets.groupBy(F.window(ts, "1 day").alias("w")).agg(F.sum(pnl).alias("daily_pnl"), F.count(F.lit(1)).alias("bets"))
            .select(F.col("w.start").alias("day"), "daily_pnl", "bets"))
