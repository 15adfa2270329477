"""Small operators of §2.1/2.2/2.13 that are not separate registered queries."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtline.functions import text as TX
from courtline.operators import dq, markets, reports, reshape, resolve
from courtline.sources import files
from courtline.streaming import live


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, None, "x")], "a long, b double, s string")
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("a", T.LongType()),
                           T.StructField("missing", T.DoubleType())])
    assert reshape.project_final(df, schema).columns == ["s", "a", "missing"]
    r = reshape.align_to_model(df, ["b", "a", "zzz"]).collect()[0]
    assert (r.b, r.a, r.zzz) == (0.0, 1.0, 0.0)


def test_coerce_fill_drop(spark):
    df = spark.createDataFrame([("1", None), ("x", 2.0), (None, None)], "a string, b double")
    c = markets.coerce_numeric(df, {"a": "bigint"})
    assert [r.a for r in c.collect()] == [1, None, None]
    f = markets.fill_defaults(c, {"b": 0.0}).collect()
    assert [r.b for r in f] == [0.0, 2.0, 0.0]
    assert markets.drop_null_keys(c, ["a"]).count() == 1


def test_loaders(spark):
    ml = spark.createDataFrame([("m1", "2023-01-05", "101", "102"), ("m2", "bad", "1", "2"), ("m3", "2023-01-06", "x", "2")],
                               "match_id string, tourney_date string, winner_historical_id string, loser_historical_id string")
    assert [r.match_id for r in files.load_match_log(ml).collect()] == ["m1"]
    p = spark.createDataFrame([("1", "R"), ("1", "L"), ("y", "R")], "player_id string, hand string")
    assert files.load_players_dim(p).count() == 1
    rk = spark.createDataFrame([("20230102", 1, 5)], "ranking_date string, rank long, player long")
    assert files.load_rankings(rk).collect()[0].ranking_date == dt.datetime(2023, 1, 2)


def test_text_helpers(spark):
    df = spark.createDataFrame([(None, "ATP Cup", None), ("R", None, "Ev")], "hand string, comp string, ev string")
    got = df.select(TX.hand_default("hand").alias("h"), TX.match_label("comp", "ev").alias("m")).collect()
    assert [(r.h, r.m) for r in got] == [("U", "ATP Cup - N/A"), ("R", "N/A - Ev")]
    d = spark.createDataFrame([("03/01/2023 10:00",), ("3/1/2023",), ("junk",)], "s string")
    assert [r.t.day if r.t else None for r in d.select(files.parse_dayfirst("s").alias("t")).collect()] == [3, 3, None]


def test_live_filters(spark):
    m = spark.createDataFrame([("a", dt.datetime(2023, 1, 1, 10), "ATP Challenger"), ("b", dt.datetime(2023, 1, 2, 10), "WTA Rome"),
                               ("c", None, "ITF")], "market_id string, market_time timestamp, competition string")
    assert [r.market_id for r in live.filter_poll_window(m, "2023-01-01 00:00:00", 12).collect()] == ["a"]
    assert [r.market_id for r in live.filter_competition_keyword(m, ["ATP", "ITF"]).collect()] == ["a", "c"]
    assert [r.market_id for r in live.topk_markets(m, 1).collect()] == ["a"]


def test_dq_rules_and_asserts(spark):
    df = spark.createDataFrame([(1, "Hard", 0.5), (2, "Sand", 1.5), (None, "Clay", 0.2)], "id long, surface string, p double")
    rules = [dq.not_null("id"), dq.isin("surface", ["Hard", "Clay"], False), dq.between("p", 0, 1)]
    s = {(r.column, r.failures) for r in dq.summary(dq.failures(df, rules, ["id"])).collect()}
    assert s == {("id", 1), ("surface", 1), ("p", 1)}
    with pytest.raises(ValueError):
        dq.assert_valid(df, rules, ["id"], "t")
    with pytest.raises(ValueError):
        dq.assert_columns(df, ["nope"], "t")
    with pytest.raises(FileNotFoundError):
        files.assert_input(spark, "/nonexistent/path")
    na = {r.column: r.nulls for r in dq.null_audit(df).collect()}
    assert na == {"id": 1, "surface": 0, "p": 0}


def test_report_helpers(spark):
    bets = spark.createDataFrame([(1, 1, 2.0, 1, 0.2, dt.datetime(2023, 1, 1)), (2, 1, 3.0, 0, 0.1, dt.datetime(2023, 1, 2))],
                                 "market_id long, side int, odds double, winner int, expected_value double, tourney_date timestamp")
    p = reports.with_pnl(bets).collect()
    assert [round(r.pnl, 6) for r in p] == [0.95, -1.0]
    feats = spark.createDataFrame([(1, -30)], "match_id long, rank_diff long")
    r = reports.load_bets_report(bets, feats).orderBy("market_id").collect()
    assert [x.rank_diff for x in r] == [-30, 0]
    b = {(x.bin_lo, x.bin_hi): x.bets for x in reports.bucket_summary(reports.with_pnl(bets), "odds", [1, 2, 3]).collect()}
    assert b == {(1.0, 2.0): 1, (2.0, 3.0): 1}  # right-closed: 2.0 falls in (1, 2]


def test_filter_ambiguous_map(spark):
    m = spark.createDataFrame([(1, 10, "a", "a", 99.0, "Initial+Lastname"), (2, 20, "b", "b", 86.0, "Fuzzy")],
                              "source_id long, historical_id long, source_name string, matched_name string, confidence double, method string")
    assert [r.source_id for r in resolve.filter_ambiguous_map(m, 90.0).collect()] == [2]
    assert resolve.filter_ambiguous_map(m, 100.0, "Fuzzy").count() == 1
