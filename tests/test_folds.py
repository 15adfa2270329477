import datetime as dt
import math

from pyspark.sql import functions as F

from courtline.operators import folds
from courtline.params import SimParams


def _bets(spark):
    return spark.createDataFrame(
        [(1, dt.datetime(2023, 1, 1), 2.5, 1, 0.10), (2, dt.datetime(2023, 1, 2), 1.8, 0, 0.05),
         (3, dt.datetime(2023, 1, 3), 3.0, 1, 0.08)],
        "bet_id long, tourney_date timestamp, odds double, winner int, kelly_fraction double").withColumn("scenario", F.lit("s"))


def test_bankroll_flat_golden(spark):
    p = SimParams(initial_bankroll=100.0, strategy="flat", stake_unit=10.0, max_kelly_stake_fraction=0.1)
    path = folds.bankroll_sim(_bets(spark), p).orderBy("bet_id").collect()
    assert [round(r.bankroll, 6) for r in path] == [115.0, 105.0, 125.0]


def test_bankroll_kelly_golden(spark):
    p = SimParams(initial_bankroll=100.0, strategy="kelly", kelly_fraction=0.5, max_kelly_stake_fraction=0.1)
    path = folds.bankroll_sim(_bets(spark), p).orderBy("bet_id").collect()
    assert [round(r.bankroll, 6) for r in path] == [107.5, 104.8125, 113.1975]


def test_closed_form_equals_fold_when_cap_not_binding(spark):
    p = SimParams(initial_bankroll=100.0, strategy="kelly", kelly_fraction=0.5, max_kelly_stake_fraction=0.1)
    cf = folds.bankroll_closed_form(_bets(spark), p).orderBy("bet_id").collect()
    assert [round(r.bankroll, 6) for r in cf] == [107.5, 104.8125, 113.1975]
    assert not any(r.cap_binds for r in cf)


def test_elo_fold_golden(spark):
    m = spark.createDataFrame(
        [(1, dt.datetime(2023, 1, 1), "Clay", 101, 102), (2, dt.datetime(2023, 1, 2), "Clay", 102, 101),
         (3, dt.datetime(2023, 1, 2), "Grass", 201, 202)],
        "match_id long, tourney_date timestamp, surface string, winner_id long, loser_id long")
    e = {r.match_id: r for r in folds.elo_ratings(m).collect()}
    assert (e[1].p1_elo, e[1].p2_elo) == (1500.0, 1500.0)          # unseen players
    assert (e[2].p1_id, e[2].p1_elo, e[2].p2_elo) == (101, 1516.0, 1484.0)  # after an even match
    assert (e[3].p1_elo, e[3].p2_elo) == (1500.0, 1500.0)          # surfaces are independent


def test_elo_rating_sum_conserved(spark):
    from courtline.sources import views
    from courtline.sources.tables import Tables
    e = folds.elo_ratings(views.matches(Tables(spark, "/root/testdata/sf0.001")))
    # every update moves +Δ/−Δ: pre-match ratings of each match sum to 2·1500 + (sum of earlier gains of both) —
    # the simple invariant is that all ratings stay finite and average 1500 over first appearances
    rows = e.collect()
    assert rows and all(math.isfinite(r.p1_elo) and math.isfinite(r.p2_elo) for r in rows)


def test_max_drawdown(spark):
    path = spark.createDataFrame([("s", 1, dt.datetime(2023, 1, 1), 110.0), ("s", 2, dt.datetime(2023, 1, 2), 88.0),
                                  ("s", 3, dt.datetime(2023, 1, 3), 120.0)],
                                 "scenario string, bet_id long, tourney_date timestamp, bankroll double")
    r = folds.max_drawdown(path).collect()[0]
    assert r.peak_bankroll == 120.0 and math.isclose(r.max_drawdown, -0.2)


def test_risk_gate(spark):
    from courtline.params import LiveParams
    b = spark.createDataFrame([("a", 1, dt.datetime(2023, 1, 1, 10), 10.0, -30.0), ("a", 2, dt.datetime(2023, 1, 1, 11), 10.0, -25.0),
                               ("a", 3, dt.datetime(2023, 1, 1, 12), 10.0, 40.0), ("a", 4, dt.datetime(2023, 1, 2, 9), 500.0, 5.0),
                               ("a", 5, dt.datetime(2023, 1, 2, 10), 10.0, 5.0)],
                              "account string, bet_id long, ts timestamp, stake double, pnl double")
    got = {r.bet_id: r.decision for r in folds.risk_gate(b, LiveParams()).collect()}
    assert got == {1: "PLACE", 2: "PLACE", 3: "RISK_BLOCKED", 4: "EXPOSED", 5: "PLACE"}


def test_elo_component_split_is_exact(spark):
    from courtline.sources import views
    from courtline.sources.tables import Tables
    m = views.matches(Tables(spark, "/root/testdata/sf0.001"))
    two = spark.createDataFrame(
        [(1, dt.datetime(2023, 1, 1), "Clay", 1, 2), (2, dt.datetime(2023, 1, 2), "Clay", 3, 4),
         (3, dt.datetime(2023, 1, 3), "Clay", 2, 1), (4, dt.datetime(2023, 1, 4), "Clay", 4, 3),
         (5, dt.datetime(2023, 1, 5), "Clay", 2, 5)],
        "match_id long, tourney_date timestamp, surface string, winner_id long, loser_id long")
    comps = {r.player: r.component for r in folds.player_components(
        two.select("surface", F.col("winner_id").alias("a"), F.col("loser_id").alias("b"))).collect()}
    assert comps == {1: 1, 2: 1, 5: 1, 3: 3, 4: 3}
    for df in (m, two):
        key = ["match_id", "p1_id", "p2_id", "p1_elo", "p2_elo"]
        a = sorted(tuple(r) for r in folds.elo_ratings(df).select(*key).collect())
        b = sorted(tuple(r) for r in folds.elo_ratings(df, split_components=True).select(*key).collect())
        assert a == b
