import math

import pytest
from pyspark.sql import functions as F

from courtline import params
from courtline.functions import pricing as P
from courtline.functions import text as T
from courtline.operators.reshape import normalize_columns, sanitize_feature_names

# every keyword inside a made-up name, then names that hold keywords of two rules
SURFACES = [(f"Old {k.upper()} trophy", "Grass") for k in params.GRASS_KEYWORDS] + \
           [(f"Old {k.title()} trophy", "Clay") for k in params.CLAY_KEYWORDS] + \
           [(f"Halle and Rome {tag}", surface) for tag, surface in params.SURFACE_TAGS] + \
           [("Rome to Halle", "Grass"), ("Clay without brackets", "Hard"), ("", "Hard"), (None, "Unknown")]
CATEGORIES = [(f"x {k.upper()} y", category) for k, category in params.TOURNAMENT_CATEGORIES] + \
             [("US Open Masters", "Grand Slam"), ("ITF Challenger", "Challenger"), ("UTR Masters", "UTR / Pro Series"),
              ("Village Green", params.DEFAULT_CATEGORY), ("", params.DEFAULT_CATEGORY), (None, params.DEFAULT_CATEGORY)]


def test_surface_of(spark):
    df = spark.createDataFrame(SURFACES, "name string, expected string")
    got = df.select(T.surface_of("name").alias("s"), "expected").collect()
    assert [r.s for r in got] == [r.expected for r in got]


def test_tournament_category(spark):
    df = spark.createDataFrame(CATEGORIES, "name string, expected string")
    got = df.select(T.tournament_category("name").alias("c"), "expected").collect()
    assert [r.c for r in got] == [r.expected for r in got]


def test_market_surface(spark):
    df = spark.createDataFrame([("Clay Court Open",), ("Grass thing",), ("x",), (None,)], "n string")
    assert [r.s for r in df.select(T.surface_of_market("n").alias("s")).collect()] == ["Clay", "Grass", "Hard", "Hard"]


def test_ev_and_kelly_golden(spark):
    df = spark.createDataFrame([(0.5, 2.0), (0.2, 6.0), (0.8, 1.2)], "p double, o double")
    got = df.select(P.expected_value("p", "o").alias("ev"), P.kelly_fraction("p", "o").alias("k")).collect()
    assert [round(r.ev, 9) for r in got] == [0.0, 0.2, -0.04]
    assert [round(r.k, 9) for r in got] == [0.0, 0.04, 0.0]


def test_kelly_with_commission_and_edges(spark):
    df = spark.createDataFrame([(0.6, 2.0), (0.6, 1.0), (0.6, None)], "p double, o double")
    got = df.select(P.kelly_fraction("p", "o", commission=0.05).alias("k")).collect()
    assert math.isclose(got[0].k, 0.6 - 0.4 / (1.0 * 0.95))
    assert got[1].k == 0.0 and got[2].k == 0.0


def test_pnl_implied_margin(spark):
    df = spark.createDataFrame([(2.5, 1), (2.0, 0), (0.0, 1)], "o double, w int")
    got = df.select(P.flat_pnl("o", "w").alias("pnl"), P.implied_prob("o").alias("ip")).collect()
    assert [round(r.pnl, 9) for r in got] == [1.425, -1.0, -0.95]
    assert [r.ip for r in got] == [0.4, 0.5, 0.0]


def test_elo_formula():
    # 1400 beats 1600: winner gains 24.312 (golden value)
    p = 1 / (1 + 10 ** ((1600 - 1400) / 400))
    assert round(32 * (1 - p), 3) == 24.312


def test_elo_prob_and_sim_odds(spark):
    df = spark.createDataFrame([(1600.0, 1550.0), (1500.0, 1500.0)], "a double, b double")
    got = df.select(P.elo_prob("a", "b").alias("p"), P.elo_sim_odds(P.elo_prob("a", "b")).alias("o")).collect()
    assert math.isclose(got[1].p, 0.5) and math.isclose(got[1].o, 2 / 1.05)


def test_patch_winner(spark):
    df = spark.createDataFrame([(1.0,), (None,), (0.0,), (1.0,)], "winner double")
    assert [r.w for r in df.select(P.patch_winner("winner").alias("w")).collect()] == [1, 0, 0, 1]


def test_normalize_and_sanitize(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Player Name", "Expected Value (EV)", "rank", "market_id"])
    assert normalize_columns(df).columns == ["player_name", "expected_value_ev", "rank", "market_id"]
    df2 = spark.createDataFrame([(1, 2)], ["a[0]", "b<c"])
    assert sanitize_feature_names(df2).columns == ["a0", "bc"]


def test_name_functions(spark):
    df = spark.createDataFrame([("Novak Djokovic",), ("Jean-Éric Müller",), ("Madonna",), ("",), (None,)], "n string")
    got = df.select(T.clean_name("n").alias("c"), T.initial_lastname("n").alias("i"), T.lastname("n").alias("l"),
                    T.block_key("n").alias("b")).collect()
    assert [r.c for r in got] == ["novak djokovic", "jean eric muller", "madonna", "", ""]
    assert [r.i for r in got][:3] == ["N Djokovic", "J Müller", "Madonna"]
    assert [r.l for r in got][:4] == ["Djokovic", "Müller", "Madonna", ""]
    assert [r.b for r in got][:4] == ["D", "M", "M", ""]


def test_sets_played(spark):
    df = spark.createDataFrame([("6-4 6-3",), ("6-4 3-6 7-6(5)",), ("6-1 RET",), (None,), ("  ",)], "s string")
    assert [r.n for r in df.select(T.sets_played("s").alias("n")).collect()] == [2, 3, 2, 0, 0]


def test_name_similarity(spark):
    df = spark.createDataFrame([("Rafael Nadal", "Nadal Rafael"), ("Camila Osorio", "Camilo Osorio"), ("abc", "xyz")],
                               "a string, b string")
    got = [r.s for r in df.select(T.name_similarity("a", "b").alias("s")).collect()]
    assert got[0] == 100.0 and round(got[1], 4) == round(100 * (1 - 1 / 13), 4) and got[2] == 0.0


def test_book_margin_without_a_price(spark):
    from pyspark.sql import functions as F
    from courtline.functions.pricing import book_margin, implied_prob
    rows = spark.createDataFrame([(2.0, 1.8), (2.0, None), (None, None), (float("nan"), 1.8)], "a double, b double")
    got = [r[0] for r in rows.select(F.round(book_margin(implied_prob("a"), implied_prob("b")), 6)).collect()]
    assert got == [0.055556, 0.0, 0.0, 0.0]


def test_history_fills_missing_names_only(spark):
    import datetime
    from courtline.plans.matchlog import join_history_lookup
    t, d = datetime.datetime(2024, 1, 2, 10), datetime.date(2024, 1, 2)
    matches = spark.createDataFrame([(t, 1, 2, "Market name"), (t, 3, 4, None)],
                                    "tourney_date timestamp, winner_historical_id long, loser_historical_id long, tourney_name string")
    lookup = spark.createDataFrame([(d, 1, 2, "History name", "6-1"), (d, 3, 4, "History name", "6-2")],
                                   "d date, p1_id long, p2_id long, h_tourney_name string, h_score string")
    got = {r.winner_historical_id: r.tourney_name for r in join_history_lookup(matches, lookup).collect()}
    assert got == {1: "Market name", 3: "History name"}
