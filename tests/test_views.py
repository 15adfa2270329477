"""Derived views on rows of their own, against brute force, and the shape of their plans."""

import datetime as dt

from pyspark.sql import functions as F

from courtline.operators import pairs
from courtline.sources import views
from courtline.sources.tables import Tables


def _tables(spark, folder):
    day = dt.datetime(2024, 1, 1)
    orders = [(k, day + dt.timedelta(days=k or 0), "FOP"[(k or 0) % 3], "2-HIGH") for k in (1, 2, 3, 4, 5, 6, None)]
    orders += [(2, day, "F", "5-LOW"), (2, day, "F", "5-LOW"), (3, None, None, None)]
    lines = [(1, 10, 1, 5.0, "R"), (1, 11, 2, 6.0, "A"),  # a match
             (2, 10, 1, 5.0, "R"), (2, 11, 2, 6.0, "A"),  # its order comes three times
             (3, 10, 1, 5.0, "R"),                        # its order comes twice: two winners
             (4, 10, 1, 5.0, "R"), (4, 11, 2, 6.0, "A"), (4, 12, 3, 6.0, "N"),
             (5, 10, 1, 5.0, "R"), (5, 10, 2, 6.0, "A"),  # one supplier on both sides
             (6, None, 1, 5.0, "R"), (6, 11, 2, 6.0, "A"), (7, 10, 1, 5.0, "R"), (7, 11, 1, 5.0, "A"),  # no supplier, no order
             (None, 10, 1, 5.0, "R"), (None, 11, 2, 6.0, "A")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp, o_orderstatus string, o_orderpriority string") \
        .write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, s, 1, n, q, 0.05, f) for k, s, n, q, f in lines],
                          "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string") \
        .write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(10, 3), (11, 4)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    return Tables(spark, folder)


def test_matches_equal_their_runners_grouped(spark, tmp_path):
    t = _tables(spark, str(tmp_path))
    by = {}
    for r in views.runners(t).collect():
        by.setdefault(r.market_id, []).append(r)
    want = {}
    for k, rs in by.items():
        w, lo = ([r for r in rs if r.result == x] for x in ("WINNER", "LOSER"))
        if len(rs) == 2 and len(w) == len(lo) == 1 and None not in (w[0].selection_id, lo[0].selection_id) and w[0].selection_id != lo[0].selection_id:
            want[k] = (w[0].selection_id, lo[0].selection_id, w[0].pp_wap, lo[0].pp_wap, w[0].tourney_date, w[0].tourney_name, w[0].surface,
                       2 + sum(r.line_no for r in rs) % 3)
    got = {r.match_id: (r.winner_id, r.loser_id, r.winner_odds, r.loser_odds, r.tourney_date, r.tourney_name, r.surface, r.sets_played)
           for r in views.matches(t).collect()}
    assert got == want and set(want) == {1}


def test_line_items_are_grouped_before_they_meet_orders_and_read_once(spark, tmp_path):
    """What a task sorts for the join are matches, not all runners; head-to-head reads them once."""
    t = _tables(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    matches = plan(views.matches(t))
    assert "Aggregate [l_orderkey" in matches[matches.index("Join Inner"):]
    m = views.matches_nation(t)
    h2h = pairs.pit_h2h(m)
    assert plan(h2h).count("Join Inner") == plan(m).count("Join Inner")
    assert h2h.select("match_id", "h2h_p1_wins", F.col("h2h_p2_wins")).collect() == [(1, 0, 0)]
