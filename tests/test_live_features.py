"""The live feature row: golden values, a plain recomputation on random history, streams in slices."""
import datetime as dt
import random

from pyspark.sql import functions as F

from courtline.operators import folds
from courtline.params import DEFAULT_PLAYER_RANK, ELO_INITIAL_RATING
from courtline.plans.live_features import elo_after, live_features
from courtline.streaming import live

MATCHES = ("match_id long, tourney_date timestamp, tourney_name string, surface string, winner_id long, loser_id long, "
           "winner_odds double, loser_odds double, sets_played int")
NOW = dt.datetime(2023, 1, 10)


def _book(market, ts, name, a, b, odds=(2.0, 1.8)):
    return (market, ts, "OPEN", False, ts, name, "ATP", "A v B", [(a, "Player A", odds[0], 1.0), (b, "Player B", odds[1], 1.0)])


def test_golden_row(spark):
    matches = spark.createDataFrame([(1, dt.datetime(2023, 1, 5), "t", "Hard", 101, 102, 2.0, 1.8, 3)], MATCHES)
    ranks = spark.createDataFrame([(101, dt.datetime(2023, 1, 1), 1, 10)], "player long, ranking_date timestamp, event_id long, rank long")
    ratings = spark.createDataFrame([(101, "Hard", dt.datetime(2023, 1, 5), 1, 1600.0), (102, "Hard", dt.datetime(2023, 1, 5), 1, 1550.0)],
                                    "player_id long, surface string, ts timestamp, match_id long, rating double")
    players = spark.createDataFrame([(101, "R"), (102, "L")], "player_id long, hand string")
    books = spark.createDataFrame([_book("m", NOW, "ATP Hard", 101, 102)], live.BOOK_SCHEMA)
    r = live_features(books, matches, rankings=ranks, ratings=ratings, players=players).collect()[0]
    assert (r.p1_rank, r.p2_rank, r.rank_diff, r.elo_diff, r.p1_hand, r.p2_hand) == (10, 500, -490, 50.0, "R", "L")
    assert (r.p1_win_perc, r.p2_win_perc, r.p1_surface_win_perc) == (1.0, 0.0, 1.0)
    assert (r.p1_matches_last_7_days, r.p1_matches_last_14_days, r.p1_sets_played_last_7_days, r.fatigue_diff_7_days) == (1, 1, 3, 0)
    assert (r.h2h_p1_wins, r.h2h_p2_wins, r.p1_implied_prob, r.p1_form) == (1, 0, 0.5, 0.0)
    assert (r.p1_name, r.p2_name, round(r.book_margin, 6)) == ("Player A", "Player B", round(0.5 + 1 / 1.8 - 1, 6))


def _plain(books, matches, ranks, ratings, hands):
    out = []
    for market, ts, *_, name, _, _, ((a, _, o1, _), (b, _, o2, _)) in books:
        surface = "Clay" if "clay" in name.lower() else "Hard"
        row = [market, ts, a, b]
        for p in (a, b):
            mine = [m for m in matches if m[1] is not None and ts is not None and m[1] < ts and p in (m[4], m[5])]
            on = [m for m in mine if m[3] == surface]
            late = [[m for m in mine if m[1] >= ts - dt.timedelta(days=d)] for d in (7, 14)]
            rank = max([(r[1], r[2], r[3]) for r in ranks if r[0] == p and ts is not None and r[1] <= ts], default=(0, 0, DEFAULT_PLAYER_RANK))[2]
            elo = max([(r[2], r[3], r[4]) for r in ratings if r[0] == p and r[1] == surface and r[2] is not None and ts is not None and r[2] < ts],
                      default=(0, 0, ELO_INITIAL_RATING))[2]
            row += [sum(m[4] == p for m in mine) / len(mine) if mine else 0.0, sum(m[4] == p for m in on) / len(on) if on else 0.0,
                    *[len(x) for x in late], *[sum(m[8] for m in x) for x in late], rank, elo, hands.get(p) or "U"]
        row += [sum(m[4] == p and q == m[5] for m in matches if m[1] is not None and ts is not None and m[1] < ts) for p, q in ((a, b), (b, a))]
        out.append((*row, *[1 / o if o else 0.0 for o in (o1, o2)]))
    return sorted(out, key=repr)


COLUMNS = ["win_perc", "surface_win_perc", "matches_last_7_days", "matches_last_14_days", "sets_played_last_7_days",
           "sets_played_last_14_days", "rank", "elo", "hand"]


def _case(spark):
    """One player in half of all matches, ties on every date, rows without a time, a market updated many times."""
    rng = random.Random(3)
    day = lambda: NOW + dt.timedelta(days=rng.randint(-40, 0))
    matches = []
    for i in range(300):
        w, lo = rng.sample(range(1, 9), 2) if rng.random() < 0.5 else rng.choice([(1, rng.randint(2, 8)), (rng.randint(2, 8), 1)])
        matches.append((i, None if i % 41 == 0 else day(), "t", rng.choice(["Hard", "Clay"]), w, lo, 2.0, 1.8, rng.randint(2, 5)))
    books = [_book(f"m{i % 30}", day() + dt.timedelta(hours=rng.choice([0, 5])), rng.choice(["Clay Open", "Open"]), *rng.sample(range(1, 11), 2),
                   odds=(rng.choice([None, 2.0, 1.25]), 1.8)) for i in range(80)]
    books += [_book("m1", None, "Open", 1, 2), books[0]]
    ranks = [(rng.randint(1, 9), day(), i, rng.randint(1, 300)) for i in range(60)]
    hands = {1: "R", 2: None, 3: "L"}
    m = spark.createDataFrame(matches, MATCHES)
    ratings = elo_after(m, folds.elo_ratings(m.where("tourney_date IS NOT NULL")))
    frames = {"rankings": spark.createDataFrame(ranks, "player long, ranking_date timestamp, event_id long, rank long"), "ratings": ratings,
              "players": spark.createDataFrame(list(hands.items()), "player_id long, hand string")}
    want = _plain(books, matches, ranks, [tuple(r) for r in ratings.collect()], hands)
    return spark.createDataFrame(books, live.BOOK_SCHEMA), m, frames, want


def _rows(df):
    df = df.select("market_id", "ts", "p1_id", "p2_id", *[f"p{i}_{c}" for i in (1, 2) for c in COLUMNS], "h2h_p1_wins", "h2h_p2_wins",
                   "p1_implied_prob", "p2_implied_prob")
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_equal_a_plain_recomputation(spark):
    books, m, frames, want = _case(spark)
    assert _rows(live_features(books, m, **frames)) == want


def test_slices_see_what_one_batch_sees(spark):
    books, m, frames, want = _case(spark)
    got = live.run_replay(spark, {"books": (books, "ts")}, lambda books: books, "live_rows", batches=3, each=lambda b: live_features(b, m, **frames))
    assert _rows(got) == want


def test_rating_after_a_match(spark):
    m = spark.createDataFrame([(1, NOW, "t", "Clay", 7, 5, 2.0, 1.8, 3)], MATCHES)
    after = {r.player_id: r.rating for r in elo_after(m, folds.elo_ratings(m)).collect()}
    assert after == {7: 1516.0, 5: 1484.0}


def test_empty_tables_and_extra_columns(spark):
    none = spark.createDataFrame([], MATCHES)
    book = spark.createDataFrame([_book("m", NOW, "Open", 101, 102)], live.BOOK_SCHEMA)
    r = live_features(book.withColumns({"_q": F.lit("x"), "side": F.lit(1), "player_id": F.lit(2)}), none).collect()[0]
    assert (r.p1_win_perc, r.p2_matches_last_7_days, r.h2h_p1_wins, r.h2h_p2_wins) == (0.0, 0, 0, 0)
    assert live_features(spark.createDataFrame([], live.BOOK_SCHEMA), none).count() == 0


def test_a_batch_run_again_replaces_its_own_folder(spark, tmp_path):
    write = live.batch_folders(str(tmp_path / "out"), lambda b: b)
    for batch_id, rows in ((0, [(1,)]), (1, [(2,), (3,)]), (1, [(2,), (3,)]), (0, [(1,)])):
        write(spark.createDataFrame(rows, "k long"), batch_id)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
