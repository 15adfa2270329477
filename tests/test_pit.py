"""Point-in-time features: golden values of the reference's live feature test, equality of the
bucketed (skew-safe) operators with plain windows on a hot-key fixture, and no-leak."""
import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtline.operators import pairs, pit
from courtline.plans.features import build_match_features, player_features


def _feature_fixture(spark):
    matches = spark.createDataFrame(
        [(1, dt.datetime(2023, 1, 5), "Hard", 101, 102, 3, 1.8, 2.1),
         (2, dt.datetime(2023, 1, 10), "Hard", 101, 102, 2, 1.9, 2.0)],
        "match_id long, tourney_date timestamp, surface string, winner_id long, loser_id long, sets_played int, "
        "winner_odds double, loser_odds double").withColumn("tourney_name", F.lit("Test Open"))
    rankings = spark.createDataFrame([(101, dt.datetime(2023, 1, 1), 1, 10)],
                                     "player long, ranking_date timestamp, event_id long, rank long")
    elo = spark.createDataFrame([(2, 101, 102, 1600.0, 1550.0)], "match_id long, p1_id long, p2_id long, p1_elo double, p2_elo double")
    players = spark.createDataFrame([(101, "R"), (102, "L")], "player_id long, hand string")
    return matches, rankings, elo, players


def test_feature_table_golden(spark):
    matches, rankings, elo, players = _feature_fixture(spark)
    f = build_match_features(matches, elo=elo, rankings=rankings, players=players)
    r = {x.match_id: x for x in f.collect()}[2]
    assert (r.p1_rank, r.p2_rank, r.rank_diff) == (10, 500, -490)
    assert (r.p1_elo, r.p2_elo, r.elo_diff) == (1600.0, 1550.0, 50.0)
    assert (r.p1_win_perc, r.p1_surface_win_perc, r.p2_win_perc) == (1.0, 1.0, 0.0)
    assert (r.p1_matches_last_7_days, r.p1_matches_last_14_days, r.p2_matches_last_7_days) == (1, 1, 1)
    assert r.p1_hand == "R" and r.h2h_p1_wins == 1 and r.h2h_p2_wins == 0
    first = {x.match_id: x for x in f.collect()}[1]
    assert first.p1_win_perc == 0.0 and first.p1_matches_last_7_days == 0  # players' first matches


def _skewed(spark, n=3000, seed=7):
    """A third of all rows belong to one player; ties on timestamps included."""
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        player = 0 if i % 3 == 0 else rnd.randint(1, 40)
        ts = base + dt.timedelta(hours=rnd.randint(0, 24 * 60))
        rows.append((i, player, ts, rnd.randint(0, 1), rnd.choice(["Hard", "Clay"]), rnd.randint(2, 5)))
    return spark.createDataFrame(rows, "row_id long, player_id long, ts timestamp, won int, surface string, sets_played long")


def _plain_windows(df, *, player="player_id", ts="ts", row_id="row_id", won="won",
                          surface="surface", sets="sets_played"):
    """The same features by ordinary windows, one partition per player; only rows with a time."""
    df = df.where(F.col(ts).isNotNull())
    w = Window.partitionBy(player).orderBy(ts, row_id)
    ws = Window.partitionBy(player, surface).orderBy(ts, row_id)
    micros = Window.partitionBy(player).orderBy(F.unix_micros(F.col(ts)))
    day = 86_400_000_000

    def rows(n):
        return w.rowsBetween(-n, -1)
    return df.select(
        "*",
        F.coalesce(F.avg(won).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("win_perc"),
        F.coalesce(F.avg(won).over(rows(10)), F.lit(0.0)).alias("form_10"),
        F.coalesce(F.avg(won).over(rows(20)), F.lit(0.0)).alias("rolling_win_perc_20"),
        F.coalesce(F.avg(won).over(rows(50)), F.lit(0.0)).alias("rolling_win_perc_50"),
        F.coalesce(F.avg(won).over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("surface_win_perc"),
        F.count(F.lit(1)).over(micros.rangeBetween(-7 * day, -1)).alias("matches_last_7_days"),
        F.count(F.lit(1)).over(micros.rangeBetween(-14 * day, -1)).alias("matches_last_14_days"),
        F.coalesce(F.sum(sets).over(micros.rangeBetween(-7 * day, -1)), F.lit(0)).alias("sets_played_last_7_days"),
        F.coalesce(F.sum(sets).over(micros.rangeBetween(-14 * day, -1)), F.lit(0)).alias("sets_played_last_14_days"),
    )


@pytest.fixture
def many_parts(spark):
    """Partitions are not coalesced, so that one player of a small table lies in several."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def _shapes(spark):
    skewed = _skewed(spark, 1500)
    yield skewed
    yield skewed.withColumn("ts", F.date_trunc("month", "ts"))  # dates only: a hot key with three timestamps
    yield skewed.withColumn("ts", F.when(F.col("row_id") % 4 != 1, F.col("ts")))  # a quarter has no time
    yield skewed.withColumn("player_id", F.when(F.col("player_id") > 5, F.col("player_id")))  # hot null player


def test_features_equal_plain_windows(spark, many_parts):
    for df in _shapes(spark):
        plain = {r.row_id: r for r in _plain_windows(df).collect()}
        got = {r.row_id: r.asDict() for r in player_features(df.withColumn("match_id", F.col("row_id"))).collect()}
        f10 = {r.row_id: r.form_10 for r in pit.pit_form_10(df).collect()}
        peak = {r.row_id: r.peak for r in pit.running_peak(df, ["player_id"], "ts", "row_id", "sets_played").collect()}
        assert got.keys() == f10.keys() == peak.keys() and len(got) == 1500
        for k, row in got.items():
            p = plain[k].asDict() if k in plain else {}
            for c, v in row.items():
                if c not in ("row_id", "match_id", "player_id"):
                    want = p.get("form_10" if c == "form" else c, 0)
                    assert v == pytest.approx(want), (k, c)
            assert f10[k] == pytest.approx(p.get("form_10", 0.0))


def test_a_key_over_several_partitions_is_cut(spark, many_parts):
    """The plan reads its input once and no task holds the hot player's rows."""
    df = pit.pit_win_perc(_skewed(spark, 3000))
    tasks = df.where("player_id = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 1 and max(t["count"] for t in tasks) < 900


def test_no_leak(spark):
    """Features of rows before t do not change when rows at or after t are removed."""
    df = _skewed(spark, 1200, seed=3)
    cut = dt.datetime(2024, 2, 1)
    full = {r.row_id: (r.win_perc, r.form_10) for r in
            pit.pit_form_10(pit.pit_win_perc(df)).collect()}
    part = {r.row_id: (r.win_perc, r.form_10) for r in
            pit.pit_form_10(pit.pit_win_perc(df.where(F.col("ts") < cut))).collect()}
    assert part and all(full[k] == v for k, v in part.items())


def test_h2h_excludes_same_day(spark):
    m = spark.createDataFrame([(1, dt.datetime(2023, 1, 1), 5, 9), (2, dt.datetime(2023, 1, 1), 9, 5),
                               (3, dt.datetime(2023, 1, 2), 9, 5), (4, dt.datetime(2023, 1, 3), 5, 9)],
                              "match_id long, tourney_date timestamp, winner_id long, loser_id long")
    got = {r.match_id: (r.h2h_p1_wins, r.h2h_p2_wins) for r in pairs.pit_h2h(m).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 1), 4: (1, 2)}


def test_asof_inclusive_and_default(spark):
    left = spark.createDataFrame([(1, 7, dt.datetime(2023, 1, 5)), (2, 7, dt.datetime(2023, 1, 1)),
                                  (3, 7, dt.datetime(2022, 12, 1)), (4, 8, dt.datetime(2023, 1, 5))],
                                 "match_id long, player_id long, tourney_date timestamp")
    rk = spark.createDataFrame([(7, dt.datetime(2023, 1, 1), 10, 40), (7, dt.datetime(2023, 1, 1), 11, 30),
                                (7, dt.datetime(2023, 1, 4), 12, 20)],
                               "player long, ranking_date timestamp, event_id long, rank long")
    got = {r.match_id: r.rank for r in pairs.asof_rank_join(left, rk).collect()}
    assert got == {1: 20, 2: 30, 3: 500, 4: 500}


def test_named_joins(spark):
    from courtline.plans.features import diff_features, join_odds
    f = spark.createDataFrame([(1, 5, 9, 10, 20)], "match_id long, p1_id long, p2_id long, p1_rank long, p2_rank long")
    m = spark.createDataFrame([(1, 2.0, 2.0)], "match_id long, p1_odds double, p2_odds double")
    r = diff_features(join_odds(f, m)).collect()[0]
    assert (r.rank_diff, r.p1_implied_prob, r.book_margin) == (-10, 0.5, 0.0)


def _brute_h2h(rows):
    out = {}
    for mid, day, w, l in rows:
        lo, hi = min(w, l), max(w, l)
        won = [x for i, d, x, y in rows if {x, y} == {w, l} and None not in (d, day) and d < day]
        out[mid] = (won.count(lo), won.count(hi))
    return out


def test_pairs_and_lookups_equal_brute_force(spark, many_parts):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    # one pair holds a third of all meetings; same-day meetings and meetings without a date included
    rows = []
    for i in range(600):
        a, b = (1, 2) if i % 3 == 0 else (rnd.randint(3, 12), rnd.randint(13, 20))
        w, l = (a, b) if rnd.random() < 0.5 else (b, a)
        rows.append((i, None if i % 50 == 7 else base + dt.timedelta(days=rnd.randint(0, 40)), w, l))
    m = spark.createDataFrame(rows, "match_id long, tourney_date timestamp, winner_id long, loser_id long")
    assert {r.match_id: (r.h2h_p1_wins, r.h2h_p2_wins) for r in pairs.pit_h2h(m).collect()} == _brute_h2h(rows)

    for df in _shapes(spark):
        every = [r.asDict() for r in df.collect()]
        by = {}
        for r in sorted((r for r in every if r["ts"]), key=lambda r: (r["ts"], r["row_id"])):
            by.setdefault(r["player_id"], []).append(r)
        day = dt.timedelta(days=1)

        want = {}
        for r in every:
            own = by.get(r["player_id"], []) if r["ts"] else []
            at = next((i for i, x in enumerate(own) if x is r), 0)
            for d in (7, 14):
                span = [x for x in own[:at] if own[at - 1]["ts"] - d * day < x["ts"]] if at else []
                want.setdefault(r["row_id"], []).extend([len(span), sum(x["sets_played"] for x in span)])
        got = {r.row_id: [r.lagged_matches_7_days, r.lagged_sets_7_days, r.lagged_matches_14_days, r.lagged_sets_14_days]
               for r in pit.lagged_range(df).collect()}
        assert got == want

        # queries: a hot key with many queries, some without a time, some before any history
        q = df.where(F.col("row_id") % 2 == 0).select(F.col("row_id").alias("qid"), "player_id", "ts")
        got = {r.qid: (r.n, r.w, r.n_7, r.w_7) for r in pit.history_before(
            q, df, key="player_id", ts="ts", qid="qid", values={"w": F.col("won")}, spans={"7": 7 * 86400}).collect()}
        for r in every:
            if r["row_id"] % 2 == 0:
                old = [x for x in by.get(r["player_id"], []) if r["ts"] and x["ts"] < r["ts"]]
                new = [x for x in old if x["ts"] >= r["ts"] - 7 * day]
                assert got[r["row_id"]] == (len(old), sum(x["won"] for x in old), len(new), sum(x["won"] for x in new))

        right = df.where(F.col("won") == 1).select(F.col("player_id").alias("player"), F.col("ts").alias("ranking_date"),
                                                   F.col("row_id").alias("event_id"), F.col("sets_played").alias("rank"))
        left = df.where(F.col("won") == 0).select(F.col("row_id").alias("match_id"), "player_id", F.col("ts").alias("tourney_date"))
        got = {r.match_id: r.rank for r in pairs.asof_rank_join(left, right).collect()}
        for r in every:
            if r["won"] == 0:
                old = [x for x in by.get(r["player_id"], []) if x["won"] == 1 and r["ts"] and x["ts"] <= r["ts"]]
                assert got[r["row_id"]] == (old[-1]["sets_played"] if old else 500)
