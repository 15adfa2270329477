"""Live market stream: eligibility gate, features from snapshot tables, scoring, value bets,
de-duplication, staking decisions, risk state, stale orders, daily P&L, subscription diff,
incremental Elo.

Every stateless step is an ordinary DataFrame transform, so the same function runs on a
batch DataFrame (replay, tests) and on a streaming one. Time is the event time of the
update (``ts``), never the wall clock, so a replay gives the same answer. Stateful steps use
``transformWithState`` (in pandas for Elo) with one state entry per selection or player; watermarks and
timers bound their state. Nothing places an order: decisions are rows in a table.
"""

# no postponed annotations: the stateful functions are recognised by runtime type hints
import json
import os
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import params
from ..functions.pricing import format_pct, kelly_live, live_expected_value, selection_key
from ..functions.text import surface_of_market, tournament_category
from ..params import EloParams, LiveParams
from ..session import checkpoint_dir

RUNNER = T.StructType([T.StructField("selection_id", T.LongType()), T.StructField("runner_name", T.StringType()),
                       T.StructField("best_back", T.DoubleType()), T.StructField("size", T.DoubleType())])
BOOK_SCHEMA = T.StructType([
    T.StructField("market_id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("status", T.StringType()), T.StructField("inplay", T.BooleanType()),
    T.StructField("market_time", T.TimestampType()), T.StructField("market_name", T.StringType()),
    T.StructField("competition", T.StringType()), T.StructField("event_name", T.StringType()),
    T.StructField("runners", T.ArrayType(RUNNER))])
ORDER_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("market_id", T.StringType()),
    T.StructField("selection_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("status", T.StringType()), T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("profit", T.DoubleType())])


# ---------------------------------------------------------------- stateless gates

def filter_market_eligible(books: DataFrame, p: LiveParams = LiveParams()) -> DataFrame:
    """Competition, event and definition present; event name has " v "; OPEN and not in
    play; tournament category in the allow-list (when it is non-empty); start strictly
    between 60 s and 3600 s after the update's event time."""
    secs = (F.unix_micros("market_time") - F.unix_micros("ts")) / F.lit(1_000_000)
    cond = (F.col("competition").isNotNull() & F.col("event_name").isNotNull() & F.col("market_time").isNotNull()
            & F.col("event_name").contains(" v ") & (F.col("status") == "OPEN") & ~F.coalesce(F.col("inplay"), F.lit(False))
            & (secs > p.window_seconds[0]) & (secs < p.window_seconds[1]))
    if p.categories:
        cond = cond & tournament_category(F.coalesce(F.col("competition"), F.lit(""))).isin(*p.categories)
    return books.where(cond)


def filter_two_runner(books: DataFrame) -> DataFrame:
    """Markets whose book carries exactly two runners with ids."""
    return books.where((F.size("runners") == 2) & F.get("runners", F.lit(0))["selection_id"].isNotNull()
                       & F.get("runners", F.lit(1))["selection_id"].isNotNull())


def filter_competition_keyword(df: DataFrame, keywords: list[str], col: str = "competition") -> DataFrame:
    """Competition name contains any keyword (case-sensitive)."""
    arr = F.array(*[F.lit(k) for k in keywords])
    return df.where(F.exists(arr, lambda k: F.col(col).contains(k)))


def filter_poll_window(markets: DataFrame, ref_ts, hours: int = params.POLL_HOURS_AHEAD) -> DataFrame:
    """Markets starting in [ref, ref + hours]."""
    ref = F.lit(ref_ts).cast("timestamp") if not isinstance(ref_ts, F.Column) else ref_ts
    return markets.where(F.col("market_time").between(ref, ref + F.make_dt_interval(hours=F.lit(hours))))


def topk_markets(markets: DataFrame, limit: int = params.STREAM_LIMIT) -> DataFrame:
    """First ``limit`` markets by start time (NULL start removed); ties by id."""
    return markets.where(F.col("market_time").isNotNull()).orderBy("market_time", "market_id").limit(limit)


def subscription_diff(target: DataFrame, current: DataFrame, key: str = "market_id") -> DataFrame:
    """ADDED (target only), REMOVED (current only), KEPT (both) — one full outer join."""
    t = target.select(F.col(key).alias("_t")).distinct()
    c = current.select(F.col(key).alias("_c")).distinct()
    j = t.join(c, t._t == c._c, "full_outer")
    change = F.when(F.col("_c").isNull(), "ADDED").when(F.col("_t").isNull(), "REMOVED").otherwise("KEPT")
    return j.select(F.coalesce("_t", "_c").alias(key), change.alias("change"))


# ---------------------------------------------------------------- catalogue and book

def join_catalogue_book(catalogue: DataFrame, books: DataFrame, *, valid: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Book updates with the catalogue entry of their market, as two streams (or two batches).

    ``catalogue``: market_id, ts, market_name, market_time, competition, event_name, runners
    (selection_id, runner_name). ``books``: market_id, ts, status, inplay, runners (selection_id,
    best_back, size). An update meets the entries published at most ``valid`` before it; both
    sides carry a watermark of ``delay``, so each keeps only the rows that can still meet one, and
    rows that come later than that are lost. Both sides must name exactly two runners, and each
    runner of the catalogue must stand in the book, found by its id: the catalogue's order stays.
    An entry that is published again gives one row for each entry. Missing runners: no row.
    Returns the columns of ``BOOK_SCHEMA``, which the gate and the features read.
    """
    two = lambda c: F.coalesce(F.size(c), F.lit(0)) == 2
    # runners as plain columns: small state rows, and a condition without higher-order functions, which run once for each pair
    flat = lambda side, *fields: [F.get("runners", F.lit(i))[f].alias(f"_{side}{i}_{f}") for i in (0, 1) for f in fields]
    c = catalogue.where(two("runners")).select(
        F.col("market_id").alias("_market"), F.col("ts").alias("_published"), "market_time", "market_name", "competition",
        "event_name", *flat("name", "selection_id", "runner_name")).withWatermark("_published", delay)
    b = books.where(two("runners")).select("market_id", "ts", "status", "inplay", *flat("price", "selection_id", "best_back", "size")).withWatermark("ts", delay)
    at = lambda n, q: F.col(f"_name{n}_selection_id") == F.col(f"_price{q}_selection_id")
    band = F.expr(f"market_id = _market AND ts >= _published AND ts <= _published + INTERVAL {valid}")
    j = b.join(c, band & (at(0, 0) | at(0, 1)) & (at(1, 0) | at(1, 1)))
    priced = lambda n, f: F.when(at(n, 1), F.col(f"_price1_{f}")).otherwise(F.col(f"_price0_{f}")).alias(f)
    runners = F.array(*[F.struct(F.col(f"_name{n}_selection_id").alias("selection_id"), F.col(f"_name{n}_runner_name").alias("runner_name"),
                                 priced(n, "best_back"), priced(n, "size")) for n in (0, 1)])
    return j.select("market_id", "ts", "status", "inplay", "market_time", "market_name", "competition", "event_name", runners.alias("runners"))


# ---------------------------------------------------------------- features, score, value bets

def runner_rows(books: DataFrame) -> DataFrame:
    """Book → one row per runner, keeping the catalogue order (p1 = first runner)."""
    return books.select("*", F.posexplode("runners").alias("runner_pos", "r")).select(
        "market_id", "ts", "market_name", "competition", "event_name", "market_time",
        (F.col("runner_pos") + 1).alias("side"), "r.selection_id", "r.runner_name", F.col("r.best_back").alias("odds"))


def player_snapshot(history_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, surface totals): latest per-player totals from player-perspective history (the live lookup table):
    matches, wins and per-surface counts; live features are read from it by a stream-static
    join instead of scanning history per update."""
    g = history_rows.groupBy("player_id").agg(F.count(F.lit(1)).alias("matches"), F.sum("won").alias("wins"))
    s = (history_rows.groupBy("player_id", "surface").agg(F.count(F.lit(1)).alias("s_matches"), F.sum("won").alias("s_wins")))
    return g, s


def stream_features(books: DataFrame, totals: DataFrame, surface_totals: DataFrame,
                    elo_latest: DataFrame | None = None) -> DataFrame:
    """Two-runner markets → one row with p1/p2 features from snapshot tables (stream-static
    joins; the snapshots are dimension-sized, AQE decides broadcast vs shuffle)."""
    m = filter_two_runner(books).select(
        "market_id", "ts", "market_name", "competition", "event_name", "market_time",
        F.col("runners")[0]["selection_id"].alias("p1_id"), F.col("runners")[1]["selection_id"].alias("p2_id"),
        F.col("runners")[0]["best_back"].alias("p1_odds"), F.col("runners")[1]["best_back"].alias("p2_odds"),
        F.col("runners")[0]["runner_name"].alias("p1_name"), F.col("runners")[1]["runner_name"].alias("p2_name"),
        surface_of_market("market_name").alias("surface"))
    for side in ("p1", "p2"):
        t = totals.select(F.col("player_id").alias(f"_{side}"), F.col("matches").alias(f"{side}_matches"),
                          F.col("wins").alias(f"{side}_wins"))
        m = m.join(t, m[f"{side}_id"] == t[f"_{side}"], "left").drop(f"_{side}")
        st = surface_totals.select(F.col("player_id").alias(f"_{side}s"), F.col("surface").alias(f"_{side}surf"),
                                   F.col("s_matches").alias(f"{side}_s_matches"), F.col("s_wins").alias(f"{side}_s_wins"))
        m = m.join(st, (m[f"{side}_id"] == st[f"_{side}s"]) & (m["surface"] == st[f"_{side}surf"]), "left") \
             .drop(f"_{side}s", f"_{side}surf")
        m = m.withColumn(f"{side}_win_perc", F.coalesce(F.try_divide(F.col(f"{side}_wins").cast("double"),
                                                                    F.col(f"{side}_matches")), F.lit(0.0))) \
             .withColumn(f"{side}_surface_win_perc", F.coalesce(F.try_divide(F.col(f"{side}_s_wins").cast("double"),
                                                                            F.col(f"{side}_s_matches")), F.lit(0.0)))
    if elo_latest is not None:
        for side in ("p1", "p2"):
            e = elo_latest.select(F.col("player_id").alias(f"_{side}e"), F.col("surface").alias(f"_{side}es"),
                                  F.col("rating").alias(f"{side}_elo"))
            m = m.join(e, (m[f"{side}_id"] == e[f"_{side}e"]) & (m["surface"] == e[f"_{side}es"]), "left") \
                 .drop(f"_{side}e", f"_{side}es") \
                 .withColumn(f"{side}_elo", F.coalesce(f"{side}_elo", F.lit(params.ELO_INITIAL_RATING)))
        m = m.withColumn("elo_diff", F.col("p1_elo") - F.col("p2_elo"))
    return m


def stream_value_bets(scored: DataFrame, p: LiveParams = LiveParams(), prob: str = "p1_predicted_prob") -> DataFrame:
    """Scored markets → one bet row per runner whose live EV (p·o − 1) exceeds the threshold
    (and whose probability passes the confidence floor). p2's probability is 1 − p1. Besides the
    numbers a row has the runner's name (NULL where the scored rows carry none) and, as text,
    ``model_prob`` and ``ev_text``."""
    name = lambda side: F.col(f"{side}_name") if f"{side}_name" in scored.columns else F.lit(None).cast("string")
    sides = F.array(*[F.struct(F.col(f"{side}_id").alias("selection_id"), name(side).alias("player_name"), F.col(f"{side}_odds").alias("odds"),
                               p_win.alias("prob")) for side, p_win in (("p1", F.col(prob)), ("p2", F.lit(1.0) - F.col(prob)))])
    rows = scored.select("market_id", "ts", "competition", "event_name", F.explode(sides).alias("b")).select(
        "market_id", "ts", "competition", "event_name", "b.*")
    rows = rows.withColumn("ev", live_expected_value("prob", "odds")).withColumn("kelly_fraction", kelly_live("prob", "odds"))
    return (rows.where(F.col("odds").isNotNull() & (F.col("ev") > p.ev_threshold) & (F.col("prob") > p.confidence_threshold))
            .withColumn("match", F.concat_ws(" - ", F.coalesce("competition", F.lit("N/A")), F.coalesce("event_name", F.lit("N/A"))))
            .withColumns({"selection_key": selection_key("market_id", "selection_id"),
                          "model_prob": format_pct("prob"), "ev_text": format_pct("ev", signed=True)}))


def stream_dedup_selection(bets: DataFrame, delay: str | None = None) -> DataFrame:
    """Each (market, selection) once, over all batches and restarts: keys stay in the state store.
    ``delay`` bounds the state where markets are known to end: a key that comes again later than
    ``delay`` behind the watermark is then new."""
    keys = ["market_id", "selection_id"]
    if delay is None:
        return bets.dropDuplicates(keys)
    return bets.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_stake(bets: DataFrame, p: LiveParams = LiveParams(), bankroll: str | None = None, dry_run: bool = True) -> DataFrame:
    """Stake and decision per bet: PAUSED when the bankroll is under the floor, BELOW_MIN for
    dust stakes, else DRY_RUN / PLACE. Bankroll column optional (fallback: configured)."""
    b = F.coalesce(F.col(bankroll), F.lit(p.bankroll)) if bankroll else F.lit(p.bankroll)
    stake = b * F.least(F.col("kelly_fraction") * F.lit(p.kelly_fraction), F.lit(p.max_kelly_stake_fraction))
    decision = (F.when(b < p.min_bankroll, "PAUSED").when(stake < p.min_stake, "BELOW_MIN")
                .otherwise("DRY_RUN" if dry_run else "PLACE"))
    return bets.withColumn("stake", stake).withColumn("decision", decision)


def stream_stale_orders(orders: DataFrame, p: LiveParams = LiveParams()) -> DataFrame:
    """EXECUTABLE orders older than the timeout → CANCEL rows."""
    return (orders.where((F.col("status") == "EXECUTABLE") & (F.col("elapsed_seconds") > p.order_timeout_seconds))
            .select("order_id", "market_id", "ts", F.lit("CANCEL").alias("action")))


def stream_daily_pnl(orders: DataFrame, delay: str = "2 hours", value: str = "profit") -> DataFrame:
    """Settled profit per UTC day (tumbling window, watermarked)."""
    settled = orders.where((F.col("status") == "EXECUTION_COMPLETE") & (F.col(value) != 0))
    return (settled.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"))
            .agg(F.sum(value).alias("daily_pnl"), F.count(F.lit(1)).alias("orders"))
            .select(F.col("w.start").alias("day"), "daily_pnl", "orders"))


# ---------------------------------------------------------------- stateful: risk, Elo

RISK_OUT = "account string, day int, selection_key string, us long, stake double, pnl double, exposure double, decision string"
UNMARKED = -2  # of a selection that is not handled; -1: handled, without an end


class AccountProcessor(StatefulProcessor):
    """One account's books: the day's P&L and, an entry each, the selections with an open stake or a
    handled mark. Every call to the state store is a round trip, so a batch reads a selection once,
    all of them at once where they are about as few as those it touches, and writes what it changed
    when it is done."""

    FEW = 64

    def __init__(self, p: LiveParams, dry_run: bool, expiring: bool):
        self.p, self.placed, self.expiring = p, "DRY_RUN" if dry_run else "PLACE", expiring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.today = handle.getValueState("today", "day int, pnl double, exposure double, entries long")
        self.selections = handle.getMapState("selections", "selection_key string", "open boolean, stake double, expires long")

    def _decide(self, opened: bool, expires: int, stake: float, pnl: float, exposure: float) -> str:
        if expires != UNMARKED:
            return "DUPLICATE"
        if opened:
            return "EXPOSED"
        if pnl <= -self.p.max_daily_loss:
            return "RISK_BLOCKED"
        if exposure + stake > self.p.max_exposure:
            return "EXPOSED"
        return "BELOW_MIN" if stake < self.p.min_stake else self.placed

    def _known(self, keys: set[str], entries: int) -> dict[str, tuple]:
        """What the store holds of the selections."""
        if not entries:
            return {}
        if entries <= max(self.FEW, 2 * len(keys)):
            return {k[0]: tuple(v) for k, v in self.selections.iterator()}
        found = {k: self.selections.getValue((k,)) for k in keys}
        return {k: tuple(v) for k, v in found.items() if v is not None}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        missing = lambda v: v is None or v != v
        last = lambda v: (True, 0) if missing(v) else (False, v)
        mine = sorted(rows, key=lambda r: (r.us, r.kind, *map(last, (r.selection_key, r.stake, r.profit))))
        day, pnl, exposure, entries = self.today.get() or (None, 0.0, 0.0, 0)
        stored = self._known({r.selection_key for r in mine if r.selection_key is not None}, entries)
        now: dict[str, tuple] = {}
        for r in mine:
            if r.day != day:
                day, pnl = r.day, 0.0
            name = r.selection_key
            opened, staked, expires = now.get(name) or stored.get(name) or (False, 0.0, UNMARKED)
            if r.kind == "settle":
                pnl += 0.0 if missing(r.profit) else r.profit
                if opened:
                    exposure -= staked
                    now[name] = (False, 0.0, expires)
                continue
            decision = self._decide(opened, expires, r.stake, pnl, exposure)
            yield Row(account=key[0], day=r.day, selection_key=name, us=r.us, stake=r.stake, pnl=pnl, exposure=exposure, decision=decision)
            if decision in (self.placed, "BELOW_MIN"):
                ends = r.expires if self.expiring and r.expires is not None else -1
                placed = decision == self.placed
                now[name] = (placed, r.stake if placed else 0.0, ends)
                exposure += r.stake if placed else 0.0
                if ends >= 0:
                    self.handle.registerTimer(ends)
        for name, value in now.items():
            if value[0] or value[2] != UNMARKED:
                self.selections.updateValue((name,), value)
                entries += name not in stored
            elif name in stored:
                self.selections.removeKey((name,))
                entries -= 1
        self.today.update((day, pnl, exposure, entries))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = 0
        for name, (opened, stake, expires) in list(self.selections.iterator()):
            if 0 <= expires <= now:
                if opened:
                    self.selections.updateValue(name, (opened, stake, UNMARKED))
                else:
                    self.selections.removeKey(name)
                    gone += 1
        if gone:
            day, pnl, exposure, entries = self.today.get()
            self.today.update((day, pnl, exposure, entries - gone))
        yield from ()

    def close(self) -> None:
        pass


def stream_risk_state(events: DataFrame, p: LiveParams = LiveParams(), timeout: str = "2 hours", dry_run: bool = True) -> DataFrame:
    """Decisions per account in event-time order, one state machine for staking, dedup and risk.

    ``events``: account, ts, kind ('bet' | 'settle'), selection_key, stake, profit and, optionally,
    ``expires`` (end of the market). A bet is, in this order: DUPLICATE for a selection that was
    handled; EXPOSED while a stake on the selection is open; RISK_BLOCKED when the day's P&L has
    reached the loss limit; EXPOSED when the open stakes and its own pass the cap; BELOW_MIN for a
    dust stake; else DRY_RUN or PLACE. Only the last three mark the selection, so others may be
    retried, and only the last two open their stake (a dry run keeps the books of a real one). A
    settlement adds its profit (missing: 0) to its day and closes the stake on its selection.
    P&L starts anew each day; open stakes and handled selections last, the latter until ``expires``
    where the rows have it (an event-time timer removes them then; ``timeout`` is the watermark's
    delay). ``pnl`` and ``exposure`` are those before the decision. Rows without an account, a time or a
    kind, and bets without a selection or a stake, have no decision and are left out. An account's
    rows of one micro-batch are sorted in one task; what came in earlier batches counts as earlier."""
    bet = (F.col("kind") == "bet") & F.col("selection_key").isNotNull() & F.col("stake").isNotNull() & ~F.isnan("stake")
    known = F.col("account").isNotNull() & F.col("ts").isNotNull() & ((F.col("kind") == "settle") | bet)
    expiring = "expires" in events.columns
    if expiring:
        events = events.withWatermark("ts", timeout)
    e = events.where(known).select("account", *(["ts"] if expiring else []), F.unix_micros("ts").alias("us"), F.unix_date(F.to_date("ts")).alias("day"), "kind", "selection_key",
                                   F.col("stake").cast("double"), F.col("profit").cast("double"),
                                   *([F.unix_millis("expires").alias("expires")] if expiring else []))
    out = e.groupBy("account").transformWithState(
        statefulProcessor=AccountProcessor(p, dry_run, expiring), outputStructType=RISK_OUT, outputMode="Append",
        timeMode="EventTime" if expiring else "None")
    return out.select("account", F.date_from_unix_date("day").alias("day"), "selection_key", F.timestamp_micros("us").alias("ts"), "stake", "pnl", "exposure",
                      "decision")


ELO_OUT = "match_id long, surface string, p1_id long, p2_id long, p1_elo double, p2_elo double"
ELO_STATE = "ratings string"


class EloStateProcessor(StatefulProcessor):
    """Per-surface Elo with one map-state entry per player: a micro-batch reads the ratings
    of the players it touches (once each) and writes them back once — state traffic grows
    with the batch, not with the number of players ever seen."""

    def __init__(self, k: float, f: float, init: float):
        self.k, self.f, self.init0 = k, f, init

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "player long", "rating double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["tourney_date", "match_id"], kind="mergesort")
        local: dict[int, float] = {}

        def rating(pid: int) -> float:
            if pid not in local:
                v = self.ratings.getValue((pid,))
                local[pid] = float(v[0]) if v is not None else self.init0
            return local[pid]
        out = []
        for r in pdf.itertuples(index=False):
            w, lo = int(r.winner_id), int(r.loser_id)
            rw, rl = rating(w), rating(lo)
            p1, p2 = (w, lo) if w < lo else (lo, w)
            e1, e2 = (rw, rl) if w < lo else (rl, rw)
            out.append((int(r.match_id), key[0], p1, p2, e1, e2))
            delta = self.k * (1.0 - 1.0 / (1.0 + 10.0 ** ((rl - rw) / self.f)))
            local[w], local[lo] = rw + delta, rl - delta
        for pid, val in local.items():
            self.ratings.updateValue((pid,), (val,))
        if out:
            yield pd.DataFrame(out, columns=["match_id", "surface", "p1_id", "p2_id", "p1_elo", "p2_elo"])

    def close(self) -> None:
        pass


def stream_elo(matches: DataFrame, p: EloParams = EloParams(), state: str = "map") -> DataFrame:
    """Incremental Elo per surface: each micro-batch's matches in (date, id) order update the
    ratings kept in state; pre-match ratings are emitted.

    ``state='map'`` (default): ``transformWithStateInPandas`` with one map entry per player
    (RocksDB state store). ``state='blob'``: ``applyInPandasWithState`` keeping the surface's
    ratings as one value (simpler, rewrites every rating each batch)."""
    k, f, init = float(p.k_factor), float(p.rating_diff_factor), float(p.initial_rating)
    if state == "map":
        m = matches.select("match_id", "surface", "tourney_date", "winner_id", "loser_id")
        return m.groupBy("surface").transformWithStateInPandas(
            statefulProcessor=EloStateProcessor(k, f, init), outputStructType=ELO_OUT, outputMode="Append",
            timeMode="None")

    def fn(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ratings = {int(a): b for a, b in json.loads(state.get[0]).items()} if state.exists else {}
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["tourney_date", "match_id"], kind="mergesort")
        out = []
        for r in rows.itertuples(index=False):
            w, lo = int(r.winner_id), int(r.loser_id)
            rw, rl = ratings.get(w, init), ratings.get(lo, init)
            p1, p2 = (w, lo) if w < lo else (lo, w)
            e1, e2 = (rw, rl) if w < lo else (rl, rw)
            out.append((int(r.match_id), key[0], p1, p2, e1, e2))
            delta = k * (1.0 - 1.0 / (1.0 + 10.0 ** ((rl - rw) / f)))
            ratings[w], ratings[lo] = rw + delta, rl - delta
        state.update((json.dumps({str(a): b for a, b in ratings.items()}),))
        if out:
            yield pd.DataFrame(out, columns=["match_id", "surface", "p1_id", "p2_id", "p1_elo", "p2_elo"])

    m = matches.select("match_id", "surface", "tourney_date", "winner_id", "loser_id")
    return m.groupBy("surface").applyInPandasWithState(fn, ELO_OUT, ELO_STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- running a stream to a table

def batch_folders(path: str, each: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: ``each(batch)`` into a folder of the batch's own, so that a batch that
    is run again after a failure replaces what it wrote before and nothing else."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        each(batch).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))
        batch.unpersist()
    return write


def _drain(df: DataFrame, base: str, mode: str, each: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Run a streaming DataFrame once over what its sources hold beyond its checkpoint in ``base``."""
    out = os.path.join(base, "table")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(base, "checkpoint")).trigger(availableNow=True)
    if each is not None:
        q = w.foreachBatch(batch_folders(out, each)).start()
    elif mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(lambda batch, _epoch: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out


def _drained(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(schema).parquet(out)
    except AnalysisException as e:  # no batch produced anything: empty result with the stream's schema
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_available(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a streaming DataFrame once (``availableNow``) into a durable table in the shared
    checkpoint folder and return it as a batch DataFrame.

    Append mode uses the Parquet file sink (exactly-once through its metadata log); complete
    / update mode rewrites the whole result table in ``foreachBatch`` (idempotent overwrite).
    Query checkpoints live next to it, so a restarted run resumes where it stopped."""
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    return _drained(spark, _drain(df, base, mode), df.schema)


def run_replay(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]], plan: Callable[..., DataFrame], name: str,
               batches: int = 5, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None,
               idle: bool = True) -> DataFrame:
    """``plan(**streams)`` over tables that land in ``batches`` slices of time, the query being
    stopped and started again from its checkpoint between two slices.

    ``tables``: name → (DataFrame, time column). The slices hold about equal numbers of rows of the
    first table; the others are cut at the same times. Rows without a time land in the first slice.
    ``each``: applied to every micro-batch as a table, for plans that a stream cannot hold. ``idle``:
    whether a slice ends with a micro-batch without rows, which reads all state to clear what the
    watermark has passed. Inner joins and stateless plans give no rows then and do without: the next
    slice's micro-batch clears the same."""
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    (first, ts), *_ = tables.values()
    bounds = first.agg(F.percentile_approx(F.unix_micros(ts), [i / batches for i in range(1, batches)])).first()[0] or []
    streams, out = {}, ""
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    try:
        spark.conf.set(empty, before if idle else "false")
        for i in range(batches):
            for n, (df, t) in tables.items():
                at = reduce(lambda total, b: total + (F.unix_micros(t) > F.lit(b)).cast("int"), bounds, F.lit(0))
                df.where(F.coalesce(at, F.lit(0)) == i).write.mode("append").parquet(os.path.join(base, n))
                streams[n] = spark.readStream.schema(df.schema).parquet(os.path.join(base, n))
            df = plan(**streams)
            out = _drain(df, base, mode, each)
    finally:
        spark.conf.set(empty, before)
    schema = each(spark.createDataFrame([], df.schema)).schema if each else df.schema
    return _drained(spark, out, schema).select(*schema.names)


def _versions(spark: SparkSession, path: str, column: str, schema: T.StructType) -> DataFrame:
    """The rows written so far to folders ``<column>=<number>`` under ``path``, with that number."""
    from pyspark.errors import AnalysisException
    full = T.StructType([*schema.fields, T.StructField(column, T.LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def decision_log_sink(batch: DataFrame, path: str, keys=("market_id", "selection_id"), batch_id: int | None = None) -> None:
    """``foreachBatch`` body: append only keys not yet in the log (left anti join against the keys of
    earlier batches) — each key is persisted once across restarts. A batch writes a folder of its
    own, which a repeated run of the same batch replaces. Without a ``batch_id``, the next number."""
    log = _versions(batch.sparkSession, path, "batch", batch.schema)
    if batch_id is None:
        last = log.agg(F.max("batch")).first()[0]
        batch_id = 0 if last is None else last + 1
    earlier = log.where(F.col("batch") < batch_id).select(*keys)
    new = batch.join(earlier, list(keys), "left_anti").select(*batch.columns).dropDuplicates(list(keys))
    new.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))


def subscription_batch(catalogue: DataFrame, state_path: str, limit: int = params.STREAM_LIMIT, batch_id: int | None = None) -> DataFrame:
    """``foreachBatch`` body of the re-poll (``trigger(processingTime='300 seconds')``): the
    first ``limit`` markets of this poll by start time become the target subscription; the
    diff against the subscription of the latest earlier poll is returned (ADDED / REMOVED / KEPT
    rows). Each poll writes one version (a folder in the checkpoint area) and touches no other, so a
    poll that is repeated, or was cut off while it wrote, gives the same diff. An empty target still
    counts as the latest version. Without a ``batch_id``, the next number."""
    spark = catalogue.sparkSession
    # a row without a market marks a version that exists, however many markets it holds
    target = topk_markets(catalogue, limit).select("market_id")
    marker = spark.createDataFrame([(None,)], target.schema)
    stored = _versions(spark, state_path, "version", target.schema)
    if batch_id is not None:
        stored = stored.where(F.col("version") < batch_id)
    last = stored.agg(F.max("version")).first()[0]
    if batch_id is None:
        batch_id = 0 if last is None else last + 1
    current = stored.where((F.col("version") == F.lit(last)) & F.col("market_id").isNotNull()).select("market_id")
    written = os.path.join(state_path, f"version={batch_id}")
    target.unionByName(marker).write.mode("overwrite").parquet(written)
    return subscription_diff(spark.read.schema(target.schema).parquet(written).where(F.col("market_id").isNotNull()), current)


def stream_market_books(spark: SparkSession, path: str, fmt: str = "json", max_files_per_trigger: int | None = None) -> DataFrame:
    """Book-update source: files landing in ``path`` with the declared book schema (JSON lines
    or Parquet); a malformed record yields NULL fields (and so no bet), not a failed batch."""
    r = spark.readStream.schema(BOOK_SCHEMA).option("mode", "PERMISSIVE")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.format(fmt).load(path)


def stream_eligible(books: DataFrame, p: LiveParams = LiveParams()) -> DataFrame:
    """Stateless gate of the live path: eligibility then exactly two runners."""
    return filter_two_runner(filter_market_eligible(books, p))


def stream_score(features: DataFrame, model, out: str = "p1_predicted_prob") -> DataFrame:
    """Fitted pipeline applied to the (streaming) feature rows; p2 = 1 − p1 downstream."""
    from pyspark.ml.functions import vector_to_array
    return model.transform(features).withColumn(out, vector_to_array("probability")[1]) \
        .drop("features", "rawPrediction", "probability", "prediction")
