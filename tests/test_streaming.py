"""Live operators on the reference's fixtures, and stream = batch on the driver tables."""
import datetime as dt
import math
import os
import random
import tempfile

from pyspark.sql import functions as F

from courtline.operators import folds
from courtline.params import LiveParams
from courtline.streaming import live

T0 = dt.datetime(2023, 10, 26, 11, 0)


def _books(spark, rows):
    return spark.createDataFrame(rows, live.BOOK_SCHEMA)


def _runners(a=2.0, b=1.8):
    return [(101, "Player A", a, 100.0), (102, "Player B", b, 100.0)]


def test_gate(spark):
    start = T0 + dt.timedelta(minutes=30)
    rows = [("ok", T0, "OPEN", False, start, "Match Odds", "Wimbledon Grand Slam", "Player A v Player B", _runners()),
            ("closed", T0, "CLOSED", False, start, "Match Odds", "Wimbledon Grand Slam", "Player A v Player B", _runners()),
            ("inplay", T0, "OPEN", True, start, "Match Odds", "Wimbledon Grand Slam", "Player A v Player B", _runners()),
            ("cat", T0, "OPEN", False, start, "Match Odds", "Local Fun Event", "Player A v Player B", _runners()),
            ("late", T0, "OPEN", False, T0 + dt.timedelta(seconds=30), "Match Odds", "Wimbledon Grand Slam", "A v B", _runners()),
            ("noev", T0, "OPEN", False, start, "Match Odds", "Wimbledon Grand Slam", "Player A vs Player B", _runners())]
    got = [r.market_id for r in live.filter_market_eligible(_books(spark, rows), LiveParams(categories=("Grand Slam",))).collect()]
    assert got == ["ok"]


def _scored(spark, p1):
    books = _books(spark, [("1.123", T0, "OPEN", False, T0 + dt.timedelta(hours=1), "ATP Challenger Hard", "ATP", "A v B", _runners())])
    totals = spark.createDataFrame([], "player_id long, matches long, wins long")
    st = spark.createDataFrame([], "player_id long, surface string, s_matches long, s_wins long")
    return live.stream_features(books, totals, st).withColumn("p1_predicted_prob", F.lit(p1))


def test_value_bets_golden(spark):
    bets = live.stream_value_bets(_scored(spark, 0.6), LiveParams(ev_threshold=0.1)).collect()
    assert [b.selection_id for b in bets] == [101]
    from courtline.functions.pricing import format_pct
    b = live.stream_value_bets(_scored(spark, 0.6)).select(format_pct("ev", signed=True).alias("e")).collect()[0]
    assert b.e == "+20.00%"
    assert live.stream_value_bets(_scored(spark, 0.4)).count() == 0


def test_stake_and_key(spark):
    bets = spark.createDataFrame([("1.234", 567, 2.5, 0.1)], "market_id string, selection_id long, odds double, kelly_fraction double")
    r = live.stream_stake(bets.withColumn("selection_key", F.concat_ws("-", "market_id", F.col("selection_id").cast("string"))),
                          LiveParams(bankroll=1000.0, kelly_fraction=0.1, max_kelly_stake_fraction=0.05)).collect()[0]
    assert (round(r.stake, 6), r.decision, r.selection_key) == (10.0, "DRY_RUN", "1.234-567")
    low = live.stream_stake(bets, LiveParams(bankroll=5.0)).collect()[0]
    assert low.decision == "PAUSED"


def test_stale_orders_and_daily_pnl(spark):
    orders = spark.createDataFrame([("o1", "1.1", 1, T0, "EXECUTABLE", 121.0, 0.0), ("o2", "1.1", 2, T0, "EXECUTION_COMPLETE", 5.0, 10.0),
                                    ("o3", "1.1", 3, T0, "EXECUTABLE", 30.0, 0.0)], live.ORDER_SCHEMA)
    assert [r.order_id for r in live.stream_stale_orders(orders).collect()] == ["o1"]
    d = live.stream_daily_pnl(orders).collect()
    assert len(d) == 1 and d[0].daily_pnl == 10.0


def test_subscription_diff(spark):
    a = spark.createDataFrame([("m1",), ("m2",)], "market_id string")
    b = spark.createDataFrame([("m2",), ("m3",)], "market_id string")
    got = {r.market_id: r.change for r in live.subscription_diff(a, b).collect()}
    assert got == {"m1": "ADDED", "m2": "KEPT", "m3": "REMOVED"}


def test_risk_state_dedup(spark):
    ev = spark.createDataFrame([("acc", T0, "bet", "1.2-5", 10.0, 0.0), ("acc", T0 + dt.timedelta(minutes=1), "bet", "1.2-5", 10.0, 0.0),
                                ("acc", T0 + dt.timedelta(minutes=2), "settle", None, 0.0, -60.0),
                                ("acc", T0 + dt.timedelta(minutes=3), "bet", "1.2-6", 10.0, 0.0),
                                ("acc", T0 + dt.timedelta(minutes=4), "bet", "1.2-7", 500.0, 0.0)],
                               "account string, ts timestamp, kind string, selection_key string, stake double, profit double")
    d = tempfile.mkdtemp(prefix="risk-stream-")
    ev.write.mode("overwrite").parquet(os.path.join(d, "e"))
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(d, "e"))
    out = live.run_available(spark, live.stream_risk_state(stream), "risk_test")
    got = [r.decision for r in out.orderBy("ts").collect()]
    assert got == ["DRY_RUN", "DUPLICATE", "RISK_BLOCKED", "RISK_BLOCKED"]


def test_stream_elo_equals_batch(spark):
    from courtline.sources import views
    from courtline.sources.tables import Tables
    m = views.matches(Tables(spark, "/root/testdata/sf0.001"))
    d = tempfile.mkdtemp(prefix="elo-stream-")
    m.write.mode("overwrite").parquet(os.path.join(d, "m"))
    stream = spark.readStream.schema(m.schema).parquet(os.path.join(d, "m"))
    s = live.run_available(spark, live.stream_elo(stream), "elo_test")
    b = folds.elo_ratings(m)
    key = ["match_id", "p1_id", "p2_id", "p1_elo", "p2_elo"]
    assert sorted(tuple(r) for r in s.select(*key).collect()) == sorted(tuple(r) for r in b.select(*key).collect())


def test_subscription_batch(spark):
    d = tempfile.mkdtemp(prefix="subs-")
    state = os.path.join(d, "subscription")
    cat1 = spark.createDataFrame([("m1", T0), ("m2", T0 + dt.timedelta(hours=1)), ("m3", None)],
                                 "market_id string, market_time timestamp")
    first = {r.market_id: r.change for r in live.subscription_batch(cat1, state, limit=2).collect()}
    assert first == {"m1": "ADDED", "m2": "ADDED"}
    cat2 = spark.createDataFrame([("m2", T0 + dt.timedelta(hours=1)), ("m4", T0 + dt.timedelta(hours=2))],
                                 "market_id string, market_time timestamp")
    second = {r.market_id: r.change for r in live.subscription_batch(cat2, state, limit=2).collect()}
    assert second == {"m1": "REMOVED", "m2": "KEPT", "m4": "ADDED"}


def test_stream_elo_blob_state_equals_batch(spark):
    from courtline.sources import views
    from courtline.sources.tables import Tables
    m = views.matches(Tables(spark, "/root/testdata/sf0.001"))
    d = tempfile.mkdtemp(prefix="elo-blob-")
    m.write.mode("overwrite").parquet(os.path.join(d, "m"))
    stream = spark.readStream.schema(m.schema).parquet(os.path.join(d, "m"))
    s = live.run_available(spark, live.stream_elo(stream, state="blob"), "elo_blob")
    key = ["match_id", "p1_id", "p2_id", "p1_elo", "p2_elo"]
    assert sorted(tuple(r) for r in s.select(*key).collect()) == sorted(tuple(r) for r in folds.elo_ratings(m).select(*key).collect())


def test_dedup_over_batches_a_day_apart(spark):
    d = tempfile.mkdtemp()
    schema = "market_id string, selection_id long, ts timestamp"
    for day in range(3):
        spark.createDataFrame([("m", 1, T0 + dt.timedelta(days=day)), ("m", 10 + day, T0 + dt.timedelta(days=day))], schema) \
            .coalesce(1).write.mode("append").parquet(d)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    out = live.run_available(spark, live.stream_dedup_selection(stream), "dedup_days")
    assert sorted((r.market_id, r.selection_id) for r in out.collect()) == [("m", 1), ("m", 10), ("m", 11), ("m", 12)]


def test_missing_profit_keeps_the_loss_limit(spark):
    at = lambda n: T0 + dt.timedelta(minutes=n)
    rows = [("a", at(0), "settle", "k0", 0.0, None), ("a", at(1), "settle", "k1", 0.0, -500.0), ("a", at(2), "bet", "k2", 10.0, None)]
    schema = "account string, ts timestamp, kind string, selection_key string, stake double, profit double"
    d = tempfile.mkdtemp()
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(d)
    out = live.run_available(spark, live.stream_risk_state(spark.readStream.schema(schema).parquet(d)), "missing_profit")
    assert [r.decision for r in out.collect()] == ["RISK_BLOCKED"]


RISK_EVENTS = "account string, ts timestamp, kind string, selection_key string, stake double, profit double"


def _risk_rows(spark):
    """Three accounts, one with a third of the rows of all; ties in time, null fields, all kinds of decisions."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), T0 + dt.timedelta(minutes=10 * rng.randint(0, 600)), rng.choice(["bet", "bet", "settle"]),
             f"m-{rng.randint(0, 60)}", rng.choice([0.01, 40.0, 90.0, 150.0]), rng.choice([None, -30.0, 12.5])) for _ in range(400)]
    rows += [(None, T0, "bet", "k", 1.0, None), ("a", None, "bet", "k", 1.0, None), ("a", T0, "bet", None, 1.0, None),
             ("a", T0, "bet", "k", None, None), ("a", T0, "other", "k", 1.0, None)]
    return spark.createDataFrame(rows, RISK_EVENTS), rows


def _plain_risk(rows, p):
    out = []
    for account in {r[0] for r in rows} - {None}:
        mine = [r for r in rows if r[0] == account and None not in r[1:4] and (r[2] == "settle" or (r[2] == "bet" and r[4] is not None))]
        mine.sort(key=lambda r: (r[1], r[2], r[3], r[4], math.inf if r[5] is None else r[5]))
        day, pnl, opened, handled = None, 0.0, {}, set()
        for _, ts, kind, key, stake, profit in mine:
            day, pnl = ts.date(), pnl if ts.date() == day else 0.0
            if kind == "settle":
                pnl += profit or 0.0
                opened.pop(key, None)
                continue
            d = ("DUPLICATE" if key in handled else "EXPOSED" if key in opened else "RISK_BLOCKED" if pnl <= -p.max_daily_loss
                 else "EXPOSED" if sum(opened.values()) + stake > p.max_exposure + 1e-9 else "BELOW_MIN" if stake < p.min_stake else "PLACE")
            out.append((account, ts, key, stake, round(pnl, 6), round(sum(opened.values()), 6), d))
            if d in ("PLACE", "BELOW_MIN"):
                handled.add(key)
            if d == "PLACE":
                opened[key] = stake
    return sorted(out)


def test_risk_state_is_the_same_for_one_and_many_batches(spark):
    df, rows = _risk_rows(spark)
    want = _plain_risk(rows, LiveParams())
    assert {r[-1] for r in want} == {"PLACE", "BELOW_MIN", "DUPLICATE", "EXPOSED", "RISK_BLOCKED"}
    for batches in (1, 5):
        out = live.run_replay(spark, {"events": (df, "ts")}, lambda events: live.stream_risk_state(events, dry_run=False), "risk_many", batches)
        got = out.select("account", "ts", "selection_key", "stake", F.round("pnl", 6), F.round("exposure", 6), "decision").collect()
        assert sorted(tuple(r) for r in got) == want


def test_open_stakes_count_under_the_cap(spark):
    at = lambda n: T0 + dt.timedelta(minutes=n)
    rows = [("a", at(i), "bet", f"m-{i}", 90.0, None) for i in range(4)] + [("a", at(5), "settle", "m-0", 0.0, 5.0),
            ("a", at(6), "bet", "m-3", 90.0, None), ("a", at(7), "bet", "m-0", 1.0, None)]
    df = spark.createDataFrame(rows, RISK_EVENTS)
    out = live.run_replay(spark, {"events": (df, "ts")}, lambda events: live.stream_risk_state(events, dry_run=False), "open_stakes", 3)
    got = [(r.selection_key, r.decision) for r in out.orderBy("ts").collect()]
    assert got == [("m-0", "PLACE"), ("m-1", "PLACE"), ("m-2", "EXPOSED"), ("m-3", "EXPOSED"), ("m-3", "PLACE"), ("m-0", "DUPLICATE")]


def test_handled_selections_end_with_their_market(spark):
    """A timer removes the mark once the watermark has passed the market's end; until then it holds."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [("a", at(0), "bet", "m-1", 10.0, None, at(1)), ("a", at(0.5), "bet", "m-1", 10.0, None, at(1)),
            ("a", at(0.6), "settle", "m-1", 0.0, 1.0, None), ("a", at(9), "bet", "m-2", 10.0, None, None),
            ("a", at(18), "bet", "m-3", 10.0, None, at(19)), ("a", at(20), "bet", "m-1", 10.0, None, at(30)), ("a", at(21), "bet", "m-2", 10.0, None, None)]
    df = spark.createDataFrame(rows, RISK_EVENTS + ", expires timestamp")
    out = live.run_replay(spark, {"events": (df, "ts")}, lambda events: live.stream_risk_state(events), "risk_timer", 7)
    got = [(r.selection_key, r.decision) for r in out.orderBy("ts").collect()]
    assert got == [("m-1", "DRY_RUN"), ("m-1", "DUPLICATE"), ("m-2", "DRY_RUN"), ("m-3", "DRY_RUN"), ("m-1", "DRY_RUN"), ("m-2", "DUPLICATE")]


CATALOGUE = ("market_id string, ts timestamp, market_name string, market_time timestamp, competition string, event_name string, "
             "runners array<struct<selection_id: long, runner_name: string>>")
BOOK = ("market_id string, ts timestamp, status string, inplay boolean, "
        "runners array<struct<selection_id: long, best_back: double, size: double>>")


def test_catalogue_meets_book(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    names = [(101, "Player A"), (102, "Player B")]
    entry = lambda m, h, r: (m, at(h), "ATP Challenger Hard", at(h + 3), "ATP", "A v B", r)
    price = lambda m, h, *r: (m, at(h), "OPEN", False, [(i, o, 50.0) for i, o in r])
    catalogue = spark.createDataFrame([entry("ok", 0, names), entry("one", 0, names[:1]), entry("none", 0, None), entry("next", 20, names),
                                       entry("tick", 40, names)], CATALOGUE)
    books = spark.createDataFrame([
        price("ok", 1, (102, 1.8), (101, 2.0)), price("ok", 2, (101, 2.1), (102, None)), price("ok", 3, (101, 2.1), (103, 1.8)),
        price("ok", 4, (101, 2.1)), price("one", 1, (101, 2.0), (102, 1.8)), price("none", 1, (101, 2.0), (102, 1.8)), price("ok", 30, (101, 3.0), (102, 1.2)),
        ("ok", at(5), "OPEN", False, None), price("next", 21, (101, 1.5), (102, 2.5)), price("next", 19, (101, 1.4), (102, 2.4)),
        price("gone", 3, (101, 2.0), (102, 1.8)), price("tick", 41, (101, 1.1), (102, 9.0))], BOOK)
    want = [("next", 21, [(101, "Player A", 1.5, 50.0), (102, "Player B", 2.5, 50.0)]),
            ("ok", 1, [(101, "Player A", 2.0, 50.0), (102, "Player B", 1.8, 50.0)]),
            ("ok", 2, [(101, "Player A", 2.1, 50.0), (102, "Player B", None, 50.0)]),
            ("tick", 41, [(101, "Player A", 1.1, 50.0), (102, "Player B", 9.0, 50.0)])]
    assert live.join_catalogue_book(catalogue, books).columns == [f.name for f in live.BOOK_SCHEMA]
    rows = lambda df: sorted((r.market_id, (r.ts - T0).total_seconds() / 3600, [tuple(x) for x in r.runners]) for r in df.collect())
    assert rows(live.join_catalogue_book(catalogue, books)) == want
    for batches in (1, 5):
        got = live.run_replay(spark, {"books": (books, "ts"), "catalogue": (catalogue, "ts")},
                              lambda catalogue, books: live.join_catalogue_book(catalogue, books), "cat_book", batches)
        assert rows(got) == want


def test_late_book_updates_are_lost_and_only_they(spark):
    """A slice later, an update more than the watermark's delay behind is gone; one within it is not."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    base = tempfile.mkdtemp(prefix="late-")
    names, prices = [(1, "A"), (2, "B")], [(1, 2.0, 1.0), (2, 3.0, 1.0)]
    slices = [([("m", at(0), "n", at(3), "c", "A v B", names)], [("m", at(1), "OPEN", False, prices)]),
              ([("x", at(48), "n", at(50), "c", "A v B", names)], [("x", at(48), "OPEN", False, prices)]),
              ([("y", at(49), "n", at(50), "c", "A v B", names)], [("m", at(2), "OPEN", False, prices), ("y", at(49), "OPEN", False, prices)]),
              ([], [("x", at(48.5), "OPEN", False, prices)])]
    schemas = {"catalogue": CATALOGUE, "books": BOOK}
    for c, b in slices:
        for n, r in (("catalogue", c), ("books", b)):
            spark.createDataFrame(r, schemas[n]).coalesce(1).write.mode("append").parquet(os.path.join(base, n))
        streams = {n: spark.readStream.schema(schemas[n]).parquet(os.path.join(base, n)) for n in schemas}
        out = live._drain(live.join_catalogue_book(**streams), os.path.join(base, "run"), "append")
    got = sorted((r.market_id, (r.ts - T0).total_seconds() / 3600) for r in spark.read.parquet(out).collect())
    assert got == [("m", 1.0), ("x", 48.0), ("x", 48.5), ("y", 49.0)]


def test_bet_rows_carry_names_and_text(spark):
    b = live.stream_value_bets(_scored(spark, 0.6)).collect()[0]
    assert (b.player_name, b.model_prob, b.ev_text, b.selection_key) == ("Player A", "60.00%", "+20.00%", "1.123-101")


def test_decision_log_takes_each_key_once_and_a_batch_again(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *k: spark.createDataFrame([("m", i, f"PLACE {i}") for i in k], "market_id string, selection_id long, decision string")
    for batch_id, keys in ((0, (1, 2, 2)), (1, (2, 3)), (1, (2, 3)), (0, (1, 2, 2)), (2, ())):
        live.decision_log_sink(rows(*keys), path, batch_id=batch_id)
    live.decision_log_sink(rows(3, 4), path)  # no number given: the first one after the rows of the log
    got = spark.read.parquet(path)
    assert sorted((r.selection_id, r.decision, r.batch) for r in got.collect()) == [(1, "PLACE 1", 0), (2, "PLACE 2", 0), (3, "PLACE 3", 1), (4, "PLACE 4", 2)]


def test_a_repeated_poll_gives_the_same_diff(spark, tmp_path):
    state = str(tmp_path / "subscription")
    poll = lambda *ids: spark.createDataFrame([(i, T0) for i in ids], "market_id string, market_time timestamp")
    diff = lambda ids, n: sorted(tuple(r) for r in live.subscription_batch(poll(*ids), state, batch_id=n).collect())
    assert diff(("a", "b"), 0) == [("a", "ADDED"), ("b", "ADDED")]
    second = [("a", "REMOVED"), ("b", "KEPT"), ("c", "ADDED")]
    assert diff(("b", "c"), 1) == second and diff(("b", "c"), 1) == second
    # cut off while writing: files without a commit are replaced by the repeated poll
    (tmp_path / "subscription" / "version=2" / "_temporary").mkdir(parents=True)
    assert diff((), 2) == [("b", "REMOVED"), ("c", "REMOVED")]
    assert diff(("c",), 3) == [("c", "ADDED")]


def test_decision_log_in_a_stream(spark, tmp_path):
    schema = "market_id string, selection_id long, ts timestamp"
    df = spark.createDataFrame([("m", i % 4, T0 + dt.timedelta(hours=i)) for i in range(12)], schema)
    df.write.parquet(str(tmp_path / "in"))
    q = (spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).foreachBatch(lambda b, n: live.decision_log_sink(b, str(tmp_path / "log"), batch_id=n)).start())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
