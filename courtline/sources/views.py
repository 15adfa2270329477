"""Derived views that give the driver's tables the roles of the pipeline's tables.

The driver's data holds no sports data, so the operators are exercised through these views.
Each one is a plain DataFrame plan over the parquet scans; ``courtline.plans.oracle`` holds
the same definitions as SQL text so that an independent engine can compute the expected
result. Both definitions must stay identical.

runners   lineitem ⋈ orders: one row per runner of a market (the ``odds`` table)
matches   markets with exactly two runners, one WINNER and one LOSER, distinct suppliers
matches_nation  as ``matches`` but the competitor is the supplier's nation (repeat pairs)
outcomes  events as player-perspective rows (player = user, won = purchase)
rankings  events of type 'view' as a ranking time series per user
historical_players / source_players   names for the entity-resolution cascade (from part)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables

SURFACE_BY_STATUS = {"F": "Clay", "O": "Grass"}  # everything else: Hard

# Tournament names given to the five order priorities, so that surface and category
# keywords occur in the data (a fixed renaming of a column, not extra rows).
TOURNEY_BY_PRIORITY = [
    ("1-URGENT", "Wimbledon Grand Slam"),
    ("2-HIGH", "Madrid Masters"),
    ("3-MEDIUM", "Challenger Rome (hard)"),
    ("4-NOT SPECIFIED", "ITF Futures Newport"),
    ("5-LOW", "UTR Pro Series Halle"),
]


def tourney_name_of_priority(priority):
    expr = None
    for p, name in TOURNEY_BY_PRIORITY:
        expr = F.when(priority == p, F.lit(name)) if expr is None else expr.when(priority == p, F.lit(name))
    return expr.otherwise(priority)


def _price():
    return F.lit(1.0) + F.col("l_quantity") / 10


def _orders(t: Tables) -> DataFrame:
    """Date, surface and tournament name of each order."""
    return t.orders.select(
        "o_orderkey", F.col("o_orderdate").alias("tourney_date"),
        F.when(F.col("o_orderstatus") == "F", "Clay")
         .when(F.col("o_orderstatus") == "O", "Grass").otherwise("Hard").alias("surface"),
        tourney_name_of_priority(F.col("o_orderpriority")).alias("tourney_name"))


def runners(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity",
                           "l_discount", "l_returnflag")
    o = _orders(t)
    return (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
            .select(F.col("l_orderkey").alias("market_id"),
                    F.col("l_suppkey").alias("selection_id"),
                    F.col("l_partkey").alias("part_id"),
                    F.col("l_linenumber").alias("line_no"),
                    _price().alias("pp_wap"),
                    F.when(F.col("l_returnflag") == "R", "WINNER")
                     .when(F.col("l_returnflag") == "A", "LOSER").otherwise("VOID").alias("result"),
                    "tourney_date", "surface", "tourney_name",
                    F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.lit(1.0) / _price() + 2 * (F.col("l_discount") - 0.03)))
                     .alias("model_prob")))


def matches(t: Tables) -> DataFrame:
    """One row per market with exactly one WINNER and one LOSER (and no other runner).

    A grouped pass (partial aggregation before the shuffle) instead of a WINNER × LOSER
    self-join, so no market can blow up into pairs. The line items are grouped before they meet
    the orders: what is shuffled and sorted for the join are the matches, not every runner with
    its order's texts. An order key that comes again multiplies its runners, so that its market
    is none with two of them.
    """
    is_w, is_l = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    g = (t.lineitem.groupBy("l_orderkey")
         .agg(F.count(F.lit(1)).alias("_n"),
              F.count_if(is_w).alias("_nw"),
              F.count_if(is_l).alias("_nl"),
              F.max(F.when(is_w, F.col("l_suppkey"))).alias("winner_id"),
              F.max(F.when(is_l, F.col("l_suppkey"))).alias("loser_id"),
              F.max(F.when(is_w, _price())).alias("winner_odds"),
              F.max(F.when(is_l, _price())).alias("loser_odds"),
              F.sum("l_linenumber").alias("_lines")))
    two = (g.where((F.col("_n") == 2) & (F.col("_nw") == 1) & (F.col("_nl") == 1)
                   & (F.col("winner_id") != F.col("loser_id")))
           .select("l_orderkey", "winner_id", "loser_id", "winner_odds", "loser_odds",
                   (F.lit(2) + F.pmod(F.col("_lines"), F.lit(3))).cast("int").alias("sets_played")))
    o = _orders(t)
    columns = ["tourney_date", "tourney_name", "surface", "winner_id", "loser_id", "winner_odds", "loser_odds", "sets_played"]
    return (two.join(o, two.l_orderkey == o.o_orderkey, "inner")
            .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_orders"), *[F.max(c).alias(c) for c in columns])
            .where(F.col("_orders") == 1)
            .select(F.col("l_orderkey").alias("match_id"), *columns))


def matches_nation(t: Tables, matches_df: DataFrame | None = None) -> DataFrame:
    """``matches`` with each supplier replaced by its nation (a role-playing dimension join)."""
    m = matches_df if matches_df is not None else matches(t)
    s = t.supplier.select("s_suppkey", "s_nationkey")
    w = s.select(F.col("s_suppkey").alias("_w"), F.col("s_nationkey").cast("bigint").alias("_wn"))
    lo = s.select(F.col("s_suppkey").alias("_l"), F.col("s_nationkey").cast("bigint").alias("_ln"))
    out = (m.join(w, m.winner_id == w._w).join(lo, m.loser_id == lo._l)
           .where(F.col("_wn") != F.col("_ln")))
    return out.select("match_id", "tourney_date", "tourney_name", "surface",
                      F.col("_wn").alias("winner_id"), F.col("_ln").alias("loser_id"),
                      "winner_odds", "loser_odds", "sets_played")


def outcomes(t: Tables) -> DataFrame:
    e = t.events
    return e.select(F.col("user_id").alias("player_id"), "ts", "event_id",
                    (F.col("event_type") == "purchase").cast("int").alias("won"),
                    F.col("event_type").alias("surface"),
                    F.floor(F.col("value")).cast("bigint").alias("sets_played"))


def rankings(t: Tables) -> DataFrame:
    e = t.events.where(F.col("event_type") == "view")
    return e.select(F.col("user_id").alias("player"), F.col("ts").alias("ranking_date"),
                    F.col("event_id"),
                    (F.lit(1) + F.floor(F.col("value") * 10)).cast("bigint").alias("rank"))


def historical_players(t: Tables) -> DataFrame:
    """Reference-side names: every part, its name title-cased ("red plate" → "Red Plate")."""
    return t.part.select(F.col("p_partkey").alias("historical_id"),
                         F.initcap("p_name").alias("historical_name"))


def source_players(t: Tables) -> DataFrame:
    """Feed-side names: the same entities as seen by another source, spelled by a fixed rule
    on ``p_size`` (exact, hyphenated upper case, accented, initial + last name, typo)."""
    p = t.part.select("p_partkey", "p_size", F.initcap("p_name").alias("n"))
    k = F.pmod(F.col("p_size"), F.lit(5))
    last = F.element_at(F.split(F.col("n"), " "), -1)
    name = (F.when(k == 0, F.col("n"))
             .when(k == 1, F.upper(F.regexp_replace("n", " ", "-")))
             .when(k == 2, F.translate("n", "ae", "àé"))
             .when(k == 3, F.concat(F.substring("n", 1, 1), F.lit(" "), last))
             .otherwise(F.concat(F.col("n"), F.lit("s"))))
    return p.select((F.col("p_partkey") + 1000000).alias("source_id"), name.alias("source_name"))


def players_dim(t: Tables) -> DataFrame:
    """Player dimension (one row per supplier): a handedness code by a fixed rule on the
    nation key, missing for suppliers with a negative balance."""
    s = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    k = F.pmod(F.col("s_nationkey"), F.lit(3))
    hand = F.when(F.col("s_acctbal") < 0, F.lit(None).cast("string")) \
            .when(k == 0, F.lit("R")).when(k == 1, F.lit("L")).otherwise(F.lit("U"))
    return s.select(F.col("s_suppkey").alias("player_id"), hand.alias("hand"))
