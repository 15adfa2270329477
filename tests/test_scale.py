"""Steps that read their input once, however many outputs hang on it."""

import datetime as dt

from pyspark.sql import functions as F

DAY = dt.datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_feature_build_reads_rankings_once(spark, tmp_path):
    from courtline.plans.features import build_match_features
    m = spark.createDataFrame(
        [(1, DAY, "a", "Hard", 7, 8, 2.0, 3.0, 2), (2, DAY + dt.timedelta(days=2), "a", "Hard", 9, 7, 2.0, 3.0, 3), (3, None, "a", "Clay", 8, 9, None, 3.0, 2)],
        "match_id long, tourney_date timestamp, tourney_name string, surface string, winner_id long, loser_id long, winner_odds double, loser_odds double, sets_played int")
    spark.createDataFrame([(7, DAY, 1, 40), (7, DAY, 2, 30), (7, DAY + dt.timedelta(days=1), 3, 20), (8, DAY + dt.timedelta(days=1), 4, 10), (9, None, 5, 5)],
                          "player long, ranking_date timestamp, event_id long, rank long").write.parquet(f"{tmp_path}/rankings")
    out = build_match_features(m, rankings=spark.read.parquet(f"{tmp_path}/rankings"))
    assert _plan(out).count("Relation [player") == 1
    got = {r.match_id: (r.p1_rank, r.p2_rank, r.rank_diff) for r in out.select("match_id", "p1_rank", "p2_rank", F.col("rank_diff")).collect()}
    assert got == {1: (30, 500, -470), 2: (20, 500, -480), 3: (500, 500, 0)}


def test_running_keeps_what_is_asked_and_drops_the_rest_early(spark):
    from courtline.operators.running import Agg, running
    rows = [(i % 3 if i % 2 else 0, i // 4 if i % 11 else None, i, i % 5 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t long, id long, asked boolean").repartition(5)
    aggs = [Agg("n", "count", F.lit(1)), Agg("s", "sum", F.col("id")), Agg("at", "last", F.when(~F.col("asked"), F.col("id")))]
    some = running(df, ["k"], ["t", "id"], aggs, keep="asked")
    want = sorted(map(tuple, running(df, ["k"], ["t", "id"], aggs).where("asked").collect()), key=lambda r: r[2])
    assert sorted(map(tuple, some.collect()), key=lambda r: r[2]) == want and len(want) == 80
    plan = _plan(some)  # the condition stands below the step that sends rows on
    assert "asked" in [line for line in plan[plan.index("Generate explode"):].splitlines() if "Filter" in line][0]


class _Store(dict):
    """A map or value state that counts its round trips."""
    calls = 0

    def _call(self, result=None):
        self.calls += 1
        return result

    def getValue(self, key): return self._call(self.get_(key))  # noqa: E704
    def updateValue(self, key, value): self._call(self.__setitem__(key, value))  # noqa: E704
    def removeKey(self, key): self._call(self.pop(key, None))  # noqa: E704
    def iterator(self): return self._call(iter([*self.items()]))  # noqa: E704
    def update(self, value): self._call(self.__setitem__("", value))  # noqa: E704
    def get(self): return self._call(self.get_(""))  # noqa: E704
    def get_(self, key): return dict.get(self, key)  # noqa: E704


def _account(expiring=False):
    from types import SimpleNamespace

    from courtline.params import LiveParams
    from courtline.streaming.live import AccountProcessor
    today, marks = _Store(), _Store()
    a = AccountProcessor(LiveParams(), True, expiring)
    a.init(SimpleNamespace(getValueState=lambda *_: today, getMapState=lambda *_: marks, registerTimer=lambda _: None))
    return a, today, marks


def _bet(i, name, stake=1.0, kind="bet", **more):
    from pyspark.sql import Row
    return Row(account="a", us=i, day=0, kind=kind, selection_key=name, stake=stake, profit=None, **more)


def test_risk_state_reads_a_selection_once_a_batch():
    a, today, marks = _account()
    for batch in range(3):
        today.calls = marks.calls = 0
        got = [r.decision for r in a.handleInputRows(("a",), iter([_bet(i, f"m-{i % 2}") for i in range(50)]), None)]
        assert got == (["DRY_RUN"] * 2 if batch == 0 else ["DUPLICATE"] * 2) + ["DUPLICATE"] * 48
        assert today.calls + marks.calls <= 4
    # many stored selections: only the one that is touched is read
    [*a.handleInputRows(("a",), iter([_bet(i, f"n-{i}", 0.01) for i in range(500)]), None)]
    marks.calls = 0
    assert [r.decision for r in a.handleInputRows(("a",), iter([_bet(0, "n-7")]), None)] == ["DUPLICATE"] and marks.calls == 1


def test_an_open_stake_outlasts_the_mark_of_its_selection():
    from types import SimpleNamespace
    a, today, marks = _account(expiring=True)
    [*a.handleInputRows(("a",), iter([_bet(0, "m", expires=5), _bet(1, "dust", 0.01, expires=5)]), None)]
    [*a.handleExpiredTimer(("a",), None, SimpleNamespace(getExpiryTimeInMs=lambda: 5))]
    assert today[""][3] == len(marks) == 1
    rows = [_bet(2, "m", expires=9), _bet(3, "m", kind="settle", expires=None), _bet(4, "m", expires=9), _bet(5, "dust", 0.01, expires=9)]
    assert [r.decision for r in a.handleInputRows(("a",), iter(rows), None)] == ["EXPOSED", "DRY_RUN", "BELOW_MIN"]
    assert today[""][3] == len(marks) == 2


def test_a_replayed_join_needs_no_empty_batches(spark):
    import glob
    import os

    from courtline.session import checkpoint_dir
    from courtline.streaming import live
    day = lambda i: DAY + dt.timedelta(days=i)
    catalogue = spark.createDataFrame(
        [(f"m{i}", day(i), "Odds", day(i), "Slam", "A v B", [(1, "A"), (2, "B")]) for i in range(9)],
        "market_id string, ts timestamp, market_name string, market_time timestamp, competition string, event_name string, runners array<struct<selection_id:long,runner_name:string>>")
    books = spark.createDataFrame(
        [(f"m{i}", day(i + j), "OPEN", False, [(2, 3.0, 1.0), (1, 2.0, 1.0)]) for i in range(9) for j in range(4)],
        "market_id string, ts timestamp, status string, inplay boolean, runners array<struct<selection_id:long,best_back:double,size:double>>")
    plan = lambda catalogue, books: live.join_catalogue_book(catalogue, books, valid="2 days", delay="3 days")
    found = {}
    for idle in (True, False):
        out = live.run_replay(spark, {"catalogue": (catalogue, "ts"), "books": (books, "ts")}, plan, f"idle_{idle}", 3, idle=idle)
        found[idle] = sorted((r.market_id, r.ts) for r in out.collect())
        [commits] = glob.glob(os.path.join(checkpoint_dir(spark).removeprefix("file:"), "streams", f"idle_{idle}-*", "checkpoint", "commits"))
        assert idle or len([f for f in os.listdir(commits) if f.isdigit()]) == 3
    assert found[True] == found[False] and len(found[True]) == 27
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_a_pair_of_the_join_is_tested_without_higher_order_functions(spark):
    from courtline.streaming import live
    day = lambda i: DAY + dt.timedelta(days=i)
    names = {"ok": [(1, "A"), (2, "B")], "same": [(1, "A"), (1, "A2")], "null": [(None, "A"), (2, "B")], "gone": [None, (2, "B")]}
    prices = [[(2, 3.0, 1.0), (1, 2.0, 5.0)], [(1, 2.1, 1.0), (1, 2.2, 2.0)], [(1, 2.3, 1.0), (None, 9.0, 1.0)], [(1, None, 1.0), (2, 3.1, 4.0)], [None, (1, 2.4, 3.0)],
              [(1, 2.5, 1.0), (7, 9.0, 1.0)]]
    catalogue = spark.createDataFrame(
        [(m, DAY, "Odds", DAY, "Slam", "A v B", r) for m, r in names.items()],
        "market_id string, ts timestamp, market_name string, market_time timestamp, competition string, event_name string, runners array<struct<selection_id:long,runner_name:string>>")
    books = spark.createDataFrame(
        [(m, day(i), "OPEN", False, r) for m in names for i, r in enumerate(prices)],
        "market_id string, ts timestamp, status string, inplay boolean, runners array<struct<selection_id:long,best_back:double,size:double>>")
    j = live.join_catalogue_book(catalogue, books, valid="9 days")
    got = {(r.market_id, (r.ts - DAY).days): [tuple(x) for x in r.runners] for r in j.collect()}
    both = lambda back, size: [(1, "A", back, size), (1, "A2", back, size)]
    assert got == {("ok", 0): [(1, "A", 2.0, 5.0), (2, "B", 3.0, 1.0)], ("ok", 3): [(1, "A", None, 1.0), (2, "B", 3.1, 4.0)],
                   ("same", 0): both(2.0, 5.0), ("same", 1): both(2.2, 2.0), ("same", 2): both(2.3, 1.0), ("same", 3): both(None, 1.0),
                   ("same", 4): both(2.4, 3.0), ("same", 5): both(2.5, 1.0)}
    assert live.filter_two_runner(j).count() == 8
    assert "lambda" not in _plan(live.filter_two_runner(j).select("market_id", "ts", F.col("runners")[0]["best_back"]))


def test_files_with_a_notice_are_not_broadcast(spark):
    from courtline.llm.licenses import license_scan
    files = spark.createDataFrame([("a/x", "Released under the MIT License."), ("a/y", "words only"), ("b/z", None)], "path string, text string")
    out = license_scan(files)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the join of whole texts, which come with the positions of matching lines
    assert any("SortMergeJoin [path" in line and "Inner" in line for line in plan.splitlines())
    assert sorted((r.path, r.license, r.origin) for r in out.collect()) == [("a/x", "MIT", "header"), ("a/y", "MIT", "inherited"), ("b/z", None, "none")]
