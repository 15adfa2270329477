"""Registered queries for folds, back-test, reports, data quality, ML and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..operators import folds, markets, reports
from ..params import SimParams
from ..sources import views
from ..sources.tables import Tables
from .catalog import REGISTRY, RUNNER_ORDER, register, r6


def market_data(spark, d):
    md = markets.first_last_runner(views.runners(Tables(spark, d)), RUNNER_ORDER)
    return md.withColumn("p1_predicted_prob", F.col("p1_model_prob"))


def value_bets(spark, d):
    return reports.backtest(market_data(spark, d))


# ---------------------------------------------------------------- back-test

@register("unpivot_bets", """
SELECT market_id, side, player_id, round(odds, 6) AS odds, round(predicted_prob, 6) AS predicted_prob, winner,
       round(expected_value, 6) AS expected_value, round(kelly_fraction, 6) AS kelly_fraction FROM all_bets""", ("all_bets",))
def q_unpivot(spark, d):
    from ..operators.reshape import unpivot_bets
    m = market_data(spark, d).withColumnRenamed("match_id", "market_id")
    b = reports.price_bets(unpivot_bets(m, base=reports.BET_BASE))
    return b.select("market_id", "side", "player_id", r6("odds").alias("odds"), r6("predicted_prob").alias("predicted_prob"),
                    "winner", r6("expected_value").alias("expected_value"), r6("kelly_fraction").alias("kelly_fraction"))


@register("backtest", """
SELECT market_id, side, player_id, round(odds, 6) AS odds, round(predicted_prob, 6) AS predicted_prob, winner,
       round(expected_value, 6) AS expected_value, round(kelly_fraction, 6) AS kelly_fraction, round(pnl, 6) AS pnl
FROM bets""", ("bets",))
def q_backtest(spark, d):
    b = value_bets(spark, d)
    return b.select("market_id", "side", "player_id", r6("odds").alias("odds"), r6("predicted_prob").alias("predicted_prob"),
                    "winner", r6("expected_value").alias("expected_value"), r6("kelly_fraction").alias("kelly_fraction"),
                    r6("pnl").alias("pnl"))


def _category_case(col: str) -> str:
    parts = [f"WHEN contains(lower(coalesce({col}, 'none')), '{k}') THEN '{v}'" for k, v in params.TOURNAMENT_CATEGORIES]
    return "CASE " + " ".join(parts) + f" ELSE '{params.DEFAULT_CATEGORY}' END"


@register("summary_by_category", f"""
SELECT * FROM (
  SELECT tourney_category, surface, count(*) AS total_bets, CAST(sum(winner) AS BIGINT) AS total_wins,
         round(avg(odds), 6) AS avg_odds, round(sum(pnl), 6) AS total_pnl,
         round(sum(winner) / count(*) * 100, 6) AS win_rate, round(sum(pnl) / count(*) * 100, 6) AS roi
  FROM (SELECT *, {_category_case('tourney_name')} AS tourney_category FROM bets WHERE surface IS NOT NULL)
  GROUP BY tourney_category, surface)
WHERE total_bets >= 1""", ("bets",))
def q_summary(spark, d):
    s = reports.summary_by_category(value_bets(spark, d), min_bets=1)
    return s.select("tourney_category", "surface", "total_bets", F.col("total_wins").cast("bigint").alias("total_wins"),
                    r6("avg_odds").alias("avg_odds"), r6("total_pnl").alias("total_pnl"), r6("win_rate").alias("win_rate"),
                    r6("roi").alias("roi"))


@register("kpi_overall", """
SELECT count(*) AS total_bets, round(sum(pnl), 6) AS total_pnl, round(sum(pnl) / count(*) * 100, 6) AS roi,
       round(sum(winner) / count(*) * 100, 6) AS win_rate, round(avg(odds), 6) AS avg_odds FROM bets""", ("bets",))
def q_kpi(spark, d):
    k = reports.kpi_overall(value_bets(spark, d))
    return k.select("total_bets", *[r6(c).alias(c) for c in ("total_pnl", "roi", "win_rate", "avg_odds")])


def _strategies_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, {a} AS min_odds, {b} AS max_odds, {e} AS min_ev"
                              for n, a, b, e in params.STRATEGIES)
    return f"""
WITH s AS ({rows})
SELECT s.name, count(*) AS total_bets, round(sum(pnl), 6) AS total_pnl, round(sum(pnl) / count(*) * 100, 6) AS roi,
       round(sum(winner) / count(*) * 100, 6) AS win_rate, round(avg(odds), 6) AS avg_odds
FROM bets JOIN s ON odds >= s.min_odds AND odds <= s.max_odds AND expected_value >= s.min_ev GROUP BY s.name"""


@register("kpi_by_strategy", _strategies_sql(), ("bets",))
def q_kpi_strategy(spark, d):
    k = reports.kpi_by_strategy(value_bets(spark, d), reports.strategies_frame(spark))
    return k.select("name", "total_bets", *[r6(c).alias(c) for c in ("total_pnl", "roi", "win_rate", "avg_odds")])


def _bins_sql(col: str, bins) -> str:
    edges = reports.bin_edges(bins)

    def lit(x):
        return "'-inf'::DOUBLE" if x == float("-inf") else ("'inf'::DOUBLE" if x == float("inf") else f"{float(x)}::DOUBLE")
    lo = " ".join(f"WHEN {col} > {lit(a)} AND {col} <= {lit(b)} THEN {lit(a)}" for a, b in zip(edges[:-1], edges[1:]))
    hi = " ".join(f"WHEN {col} > {lit(a)} AND {col} <= {lit(b)} THEN {lit(b)}" for a, b in zip(edges[:-1], edges[1:]))
    return f"""
SELECT bin_lo, bin_hi, count(market_id) AS bets, round(sum(pnl), 6) AS pnl, round(sum(pnl) / count(market_id) * 100, 6) AS roi
FROM (SELECT *, CASE {lo} END AS bin_lo, CASE {hi} END AS bin_hi FROM bets)
WHERE bin_lo IS NOT NULL GROUP BY bin_lo, bin_hi HAVING count(market_id) > 0"""


def _bucket_query(name, col, bins):
    @register(name, _bins_sql(col, bins), ("bets",))
    def q(spark, d):
        b = reports.bucket_summary(value_bets(spark, d), col, bins)
        return b.select("bin_lo", "bin_hi", "bets", r6("pnl").alias("pnl"), r6("roi").alias("roi"))
    return q


_bucket_query("bucket_summary_odds", "odds", params.ODDS_BINS)
_bucket_query("bucket_summary_ev", "expected_value", params.EV_BINS)


@register("topk_leaderboard", f"""
SELECT tourney_category, surface, total_bets, round(roi, 6) AS roi FROM (
  SELECT {_category_case('tourney_name')} AS tourney_category, surface, count(*) AS total_bets,
         sum(pnl) / count(*) * 100 AS roi FROM bets WHERE surface IS NOT NULL GROUP BY 1, 2)
ORDER BY roi DESC, tourney_category, surface LIMIT 5""", ("bets",))
def q_leaderboard(spark, d):
    s = reports.summary_by_category(value_bets(spark, d)).select("tourney_category", "surface", "total_bets", "roi")
    top = reports.topk_leaderboard(s, "roi", 5)
    return top.select("tourney_category", "surface", "total_bets", r6("roi").alias("roi"))


@register("list_tournaments", """
SELECT DISTINCT tourney_name FROM runners WHERE tourney_name IS NOT NULL""", ("runners",))
def q_list_tournaments(spark, d):
    return reports.list_tournaments(views.runners(Tables(spark, d)))


@register("filter_year", """
SELECT market_id, selection_id, part_id, line_no FROM runners
WHERE tourney_date >= TIMESTAMP '1997-01-01' AND tourney_date < TIMESTAMP '1998-01-01'""", ("runners",))
def q_filter_year(spark, d):
    r = reports.filter_year(views.runners(Tables(spark, d)), 1997)
    return r.select("market_id", "selection_id", "part_id", "line_no")


@register("filter_report", """
SELECT bet_id FROM bets WHERE tourney_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'
  AND odds BETWEEN 1.5 AND 4.0 AND expected_value BETWEEN 0.12 AND 0.5""", ("bets",))
def q_filter_report(spark, d):
    b = reports.filter_report(value_bets(spark, d), date_range=("1996-01-01", "1999-12-31"), odds_range=(1.5, 4.0),
                              ev_range=(0.12, 0.5))
    return b.select("bet_id")


@register("filter_bettable", """
SELECT market_id, side FROM all_bets WHERE expected_value > 0.1 AND predicted_prob > 0.52""", ("all_bets",))
def q_filter_bettable(spark, d):
    return value_bets(spark, d).select("market_id", "side")


@register("filter_strategy", """
SELECT bet_id FROM bets WHERE odds >= 1.01 AND odds <= 3.0 AND expected_value >= 0.15""", ("bets",))
def q_filter_strategy(spark, d):
    name, lo, hi, ev = params.STRATEGIES[0]
    b = value_bets(spark, d)
    return b.where((F.col("odds") >= lo) & (F.col("odds") <= hi) & (F.col("expected_value") >= ev)).select("bet_id")


@register("tail_history", """
SELECT bet_id, round(pnl, 6) AS pnl FROM bets ORDER BY tourney_date DESC, bet_id DESC LIMIT 200""", ("bets",))
def q_tail(spark, d):
    return reports.tail_history(value_bets(spark, d)).select("bet_id", r6("pnl").alias("pnl"))


@register("sample_n", """
SELECT event_id, player_id FROM outcomes ORDER BY md5('42:' || event_id), event_id LIMIT 1000""", ("outcomes",))
def q_sample(spark, d):
    o = views.outcomes(Tables(spark, d))
    return reports.sample_n(o, 1000, 42, "event_id").select("event_id", "player_id")


@register("daily_pnl", """
SELECT date_trunc('day', tourney_date) AS day, round(sum(pnl), 6) AS daily_pnl, count(*) AS bets FROM bets GROUP BY 1""",
          ("bets",))
def q_daily(spark, d):
    p = folds.daily_pnl(value_bets(spark, d))
    return p.select("day", r6("daily_pnl").alias("daily_pnl"), "bets")


@register("with_pnl", """
SELECT bet_id, round(CASE WHEN winner = 1 THEN (odds - 1.0) * 0.95 ELSE -1.0 END, 6) AS pnl FROM all_bets
JOIN (SELECT market_id AS m, side AS s, market_id * 2 + side - 1 AS bet_id FROM all_bets) k ON k.m = market_id AND k.s = side""",
          ("all_bets",))
def q_with_pnl(spark, d):
    from ..operators.reshape import unpivot_bets
    m = market_data(spark, d).withColumnRenamed("match_id", "market_id")
    b = unpivot_bets(m, base=reports.BET_BASE).withColumn("bet_id", F.col("market_id") * 2 + F.col("side") - 1)
    return reports.with_pnl(b).select("bet_id", r6("pnl").alias("pnl"))


# ---------------------------------------------------------------- folds

ELO_SQL = """
WITH RECURSIVE o AS MATERIALIZED (
  SELECT surface, tourney_date AS d, match_id AS market_id, winner_id AS w, loser_id AS l,
         row_number() OVER (PARTITION BY surface ORDER BY tourney_date, match_id) AS rn FROM matches),
f(surface, rn, market_id, w, l, pw, pl, st) AS (
  SELECT surface, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, MAP([-1::BIGINT], [0::DOUBLE])
  FROM (SELECT DISTINCT surface FROM o)
  UNION ALL
  SELECT f.surface, o.rn, o.market_id, o.w, o.l, x.a, x.b,
         map_concat(f.st, MAP([o.w, o.l], [x.a + 32 * (1 - 1 / (1 + power(10, (x.b - x.a) / 400))),
                                            x.b - 32 * (1 - 1 / (1 + power(10, (x.b - x.a) / 400)))]))
  FROM f JOIN o ON o.surface = f.surface AND o.rn = f.rn + 1,
       LATERAL (SELECT coalesce(f.st[o.w], 1500.0)::DOUBLE AS a, coalesce(f.st[o.l], 1500.0)::DOUBLE AS b) x),
elo AS (SELECT market_id AS match_id, surface, least(w, l) AS p1_id, greatest(w, l) AS p2_id,
               CASE WHEN w < l THEN pw ELSE pl END AS p1_elo, CASE WHEN w < l THEN pl ELSE pw END AS p2_elo
        FROM f WHERE rn > 0)"""


@register("elo_ratings", ELO_SQL + """
SELECT match_id, surface, p1_id, p2_id, round(p1_elo, 6) AS p1_elo, round(p2_elo, 6) AS p2_elo FROM elo""", ("matches",))
def q_elo(spark, d):
    e = folds.elo_ratings(views.matches(Tables(spark, d)))
    return e.select("match_id", "surface", "p1_id", "p2_id", r6("p1_elo").alias("p1_elo"), r6("p2_elo").alias("p2_elo"))


@register("elo_sim_odds", ELO_SQL + """
SELECT match_id, round(1.0 / (1.0 + power(10.0, (p2_elo - p1_elo) / 400.0)), 6) AS p1_elo_prob,
       round(least(CASE WHEN 1.0 / (1.0 + power(10.0, (p2_elo - p1_elo) / 400.0)) > 0
                        THEN (1.0 / (1.0 / (1.0 + power(10.0, (p2_elo - p1_elo) / 400.0)))) / 1.05 ELSE 50.0 END, 50.0), 6) AS p1_odds,
       round(p1_elo - p2_elo, 6) AS elo_diff
FROM elo""", ("matches",))
def q_elo_odds(spark, d):
    from ..functions.pricing import elo_prob, elo_sim_odds
    e = folds.elo_ratings(views.matches(Tables(spark, d)))
    p = elo_prob("p1_elo", "p2_elo")
    return e.select("match_id", r6(p).alias("p1_elo_prob"), r6(elo_sim_odds(p)).alias("p1_odds"),
                    r6(F.col("p1_elo") - F.col("p2_elo")).alias("elo_diff"))


BANKROLL_SQL = """
WITH RECURSIVE o AS MATERIALIZED (
  SELECT surface AS scenario, bet_id, odds, winner, kelly_fraction,
         row_number() OVER (PARTITION BY surface ORDER BY tourney_date, bet_id) AS rn FROM bets WHERE tourney_date IS NOT NULL),
f(scenario, rn, bet_id, stake, profit, bankroll) AS (
  SELECT DISTINCT scenario, 0::BIGINT, NULL::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 1000.0::DOUBLE FROM o
  UNION ALL
  SELECT f.scenario, o.rn, o.bet_id, s.stake,
         CASE WHEN o.winner = 1 THEN least(s.stake * (o.odds - 1.0), 10000.0::DOUBLE) ELSE -s.stake END,
         f.bankroll + CASE WHEN o.winner = 1 THEN least(s.stake * (o.odds - 1.0), 10000.0::DOUBLE) ELSE -s.stake END
  FROM f JOIN o ON o.scenario = f.scenario AND o.rn = f.rn + 1,
       LATERAL (SELECT greatest(0.0::DOUBLE, least(least(f.bankroll * least(o.kelly_fraction * 0.5::DOUBLE, 0.1::DOUBLE),
                                                          f.bankroll * 1.0::DOUBLE), f.bankroll)) AS stake) s),
path AS (SELECT scenario, bet_id, stake, profit, bankroll FROM f WHERE rn > 0)"""


def bets_by_surface(spark, d):
    return value_bets(spark, d).withColumn("scenario", F.col("surface"))


@register("bankroll_sim", BANKROLL_SQL + """
SELECT scenario, bet_id, round(stake, 6) AS stake, round(profit, 6) AS profit, round(bankroll, 6) AS bankroll FROM path""",
          ("bets",))
def q_bankroll(spark, d):
    p = folds.bankroll_sim(bets_by_surface(spark, d), SimParams())
    return p.select("scenario", "bet_id", r6("stake").alias("stake"), r6("profit").alias("profit"), r6("bankroll").alias("bankroll"))


@register("max_drawdown", BANKROLL_SQL + """
SELECT scenario, round(max(peak), 6) AS peak_bankroll, round(coalesce(min((bankroll - peak) / peak), 0), 6) AS max_drawdown
FROM (SELECT p.*, max(bankroll) OVER (PARTITION BY p.scenario ORDER BY o.rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
      FROM path p JOIN o ON o.scenario = p.scenario AND o.bet_id = p.bet_id)
GROUP BY scenario""", ("bets",))
def q_drawdown(spark, d):
    b = bets_by_surface(spark, d)
    path = folds.bankroll_sim(b, SimParams()).join(b.select("scenario", "bet_id", "tourney_date"), ["scenario", "bet_id"])
    m = folds.max_drawdown(path)
    return m.select("scenario", r6("peak_bankroll").alias("peak_bankroll"), r6("max_drawdown").alias("max_drawdown"))


@register("bankroll_closed_form", """
SELECT scenario, bet_id, round(coalesce(lg, 0.0), 6) AS log_growth, ruin > 0 AS ruined FROM (
  SELECT surface AS scenario, bet_id,
         sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER w AS lg, count(CASE WHEN r <= -1 THEN 1 END) OVER w AS ruin
  FROM (SELECT *, CASE WHEN winner = 1 THEN f * (odds - 1.0) ELSE -f END AS r
        FROM (SELECT *, greatest(0.0, least(least(least(kelly_fraction * 0.5, 0.1), 1.0), 1.0)) AS f FROM bets
              WHERE tourney_date IS NOT NULL))
  WINDOW w AS (PARTITION BY surface ORDER BY tourney_date, bet_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
          ("bets",))
def q_closed_form(spark, d):
    c = folds.bankroll_closed_form(bets_by_surface(spark, d), SimParams())
    # the bankroll itself (1000·e^log_growth) spans many orders of magnitude; its exact
    # ingredient, the running log growth, is what is compared
    return c.select("scenario", "bet_id", r6("log_growth").alias("log_growth"), "ruined")


@register("risk_gate", """
SELECT bet_id, CASE WHEN coalesce(low <= -50.0, false) THEN 'RISK_BLOCKED' WHEN stake > 200.0 THEN 'EXPOSED' ELSE 'PLACE' END AS decision
FROM (SELECT *, min(cum) OVER (PARTITION BY account, day ORDER BY tourney_date, bet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
      FROM (SELECT *, sum(CASE WHEN stake <= 200.0 THEN pnl * stake ELSE 0.0 END) OVER (PARTITION BY account, day ORDER BY tourney_date, bet_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
            FROM (SELECT *, surface AS account, CAST(tourney_date AS DATE) AS day,
                         1000.0 * least(kelly_fraction * 0.1, 0.05) AS stake FROM bets)))""", ("bets",))
def q_risk(spark, d):
    from ..params import LiveParams
    lp = LiveParams()
    b = value_bets(spark, d).withColumns({
        "account": F.col("surface"),
        "stake": F.lit(lp.bankroll) * F.least(F.col("kelly_fraction") * F.lit(lp.kelly_fraction), F.lit(lp.max_kelly_stake_fraction))})
    b = b.withColumn("pnl_money", F.col("pnl") * F.col("stake"))
    g = folds.risk_gate(b, lp, account="account", ts="tourney_date", bet_id="bet_id", stake="stake", pnl="pnl_money")
    return g.select("bet_id", "decision")


# ---------------------------------------------------------------- dimension joins, ML inputs

@register("join_player_dim", """
SELECT m.match_id, least(m.winner_id, m.loser_id) AS p1_id, greatest(m.winner_id, m.loser_id) AS p2_id,
       a.hand AS p1_hand, b.hand AS p2_hand
FROM matches m LEFT JOIN players_dim a ON least(m.winner_id, m.loser_id) = a.player_id
LEFT JOIN players_dim b ON greatest(m.winner_id, m.loser_id) = b.player_id""", ("matches", "players_dim"))
def q_join_player_dim(spark, d):
    t = Tables(spark, d)
    m = markets.canonical_pair(views.matches(t)).select("match_id", "p1_id", "p2_id")
    dim = views.players_dim(t)
    for side in ("p1", "p2"):
        p = dim.select(F.col("player_id").alias(f"_{side}"), F.col("hand").alias(f"{side}_hand"))
        m = m.join(p, m[f"{side}_id"] == p[f"_{side}"], "left").drop(f"_{side}")
    return m


@register("one_hot_hand", """
SELECT match_id,
       coalesce(CAST(a.hand = 'R' AS INTEGER), 0) AS p1_hand_R, coalesce(CAST(a.hand = 'U' AS INTEGER), 0) AS p1_hand_U,
       coalesce(CAST(b.hand = 'R' AS INTEGER), 0) AS p2_hand_R, coalesce(CAST(b.hand = 'U' AS INTEGER), 0) AS p2_hand_U
FROM matches m LEFT JOIN players_dim a ON least(m.winner_id, m.loser_id) = a.player_id
LEFT JOIN players_dim b ON greatest(m.winner_id, m.loser_id) = b.player_id""", ("matches", "players_dim"))
def q_one_hot(spark, d):
    from ..operators.ml import one_hot_hand
    return one_hot_hand(q_join_player_dim(spark, d)).select("match_id", "p1_hand_R", "p1_hand_U", "p2_hand_R", "p2_hand_U")


@register("temporal_split", """
SELECT match_id, CASE WHEN pos >= floor(n * 0.8) THEN 'test' WHEN pos >= floor(floor(n * 0.8) * 0.75) THEN 'validation'
                      ELSE 'train' END AS split
FROM (SELECT match_id, row_number() OVER (ORDER BY tourney_date, match_id) - 1 AS pos, count(*) OVER () AS n FROM matches)""",
          ("matches",))
def q_temporal_split(spark, d):
    from ..operators.ml import temporal_split
    return temporal_split(views.matches(Tables(spark, d)).select("match_id", "tourney_date")).select("match_id", "split")


@register("ml_train_eval", None, note="boosted-tree search + refit + test metrics; non-deterministic across engines → rows-only")
def q_ml(spark, d):
    from ..operators.ml import train_eval
    from .catalog import match_features_frame
    feats = match_features_frame(spark, d)
    t = Tables(spark, d)
    m = views.matches(t).select("match_id", "tourney_date", "surface")
    data = feats.join(m, "match_id")
    dim = views.players_dim(t)
    for side in ("p1", "p2"):
        p = dim.select(F.col("player_id").alias(f"_{side}"), F.col("hand").alias(f"{side}_hand"))
        data = data.join(p, data[f"{side}_id"] == p[f"_{side}"], "left").drop(f"_{side}")
    _, metrics, _ = train_eval(data, n_trials=2)
    return metrics


@register("stratified_folds", """
SELECT match_id, winner, CAST((row_number() OVER (PARTITION BY winner ORDER BY md5('42:' || match_id), match_id) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT match_id, CAST(winner_id < loser_id AS INTEGER) AS winner FROM matches)""", ("matches",))
def q_folds(spark, d):
    from ..operators.ml import stratified_folds
    m = markets.canonical_pair(views.matches(Tables(spark, d))).select("match_id", "winner")
    return stratified_folds(m).select("match_id", "winner", "fold")


# ---------------------------------------------------------------- data quality

def _lineitem_rules():
    from ..operators import dq
    return [dq.between("l_discount", None, 0.08), dq.between("l_tax", 0.01, None), dq.isin("l_returnflag", ["R", "A"]),
            dq.between("l_quantity", 1, 50), dq.not_null("l_shipdate")]


@register("dq_failure_summary", """
SELECT "column", "check", failures FROM (
  SELECT 'l_discount' AS "column", 'less_than_or_equal_to(0.08)' AS "check", count(*) FILTER (WHERE NOT coalesce(l_discount IS NULL OR l_discount <= 0.08, false)) AS failures FROM lineitem
  UNION ALL SELECT 'l_tax', 'greater_than_or_equal_to(0.01)', count(*) FILTER (WHERE NOT coalesce(l_tax IS NULL OR l_tax >= 0.01, false)) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'isin([''R'', ''A''])', count(*) FILTER (WHERE NOT coalesce(l_returnflag IS NULL OR l_returnflag IN ('R', 'A'), false)) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'greater_than_or_equal_to(1) & less_than_or_equal_to(50)', count(*) FILTER (WHERE NOT coalesce(l_quantity IS NULL OR (l_quantity >= 1 AND l_quantity <= 50), false)) FROM lineitem
  UNION ALL SELECT 'l_shipdate', 'not_nullable', count(*) FILTER (WHERE l_shipdate IS NULL) FROM lineitem)
WHERE failures > 0""")
def q_dq_summary(spark, d):
    from ..operators import dq
    li = Tables(spark, d).lineitem
    f = dq.failures(li, _lineitem_rules(), ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    return dq.summary(f).select("column", "check", "failures")


@register("validate_table", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, 'l_returnflag' AS column FROM lineitem
WHERE NOT coalesce(l_returnflag IS NULL OR l_returnflag IN ('R', 'A'), false)
UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, 'l_discount' FROM lineitem
WHERE NOT coalesce(l_discount IS NULL OR l_discount <= 0.08, false)""")
def q_validate(spark, d):
    from ..operators import dq
    li = Tables(spark, d).lineitem
    rules = [dq.isin("l_returnflag", ["R", "A"]), dq.between("l_discount", None, 0.08)]
    return dq.failures(li, rules, ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "column")


@register("null_audit", """
SELECT 'p1_hand' AS column, count(*) FILTER (WHERE a.hand IS NULL) AS nulls
FROM matches m LEFT JOIN players_dim a ON least(m.winner_id, m.loser_id) = a.player_id
UNION ALL SELECT 'p2_hand', count(*) FILTER (WHERE b.hand IS NULL)
FROM matches m LEFT JOIN players_dim b ON greatest(m.winner_id, m.loser_id) = b.player_id""", ("matches", "players_dim"))
def q_null_audit(spark, d):
    from ..operators import dq
    return dq.null_audit(q_join_player_dim(spark, d), ["p1_hand", "p2_hand"])


# ---------------------------------------------------------------- streaming (file streams drained once)

def _orders_from_events(ev):
    """Order updates derived from events: views are resting orders (elapsed = 10·value s),
    purchases are settled ones (profit = value)."""
    return ev.select(F.col("event_id").cast("string").alias("order_id"), F.col("user_id").cast("string").alias("market_id"),
                     F.col("user_id").alias("selection_id"), "ts",
                     F.when(F.col("event_type") == "view", "EXECUTABLE")
                      .when(F.col("event_type") == "purchase", "EXECUTION_COMPLETE").otherwise("OTHER").alias("status"),
                     (F.col("value") * 10).alias("elapsed_seconds"), F.col("value").alias("profit"))


@register("stream_value_bets", """
SELECT market_id, selection_id, part_id, line_no, round(model_prob * pp_wap - 1.0, 6) AS ev,
       round(CASE WHEN pp_wap > 1 THEN greatest(0.0, (model_prob * pp_wap - 1.0) / (pp_wap - 1.0)) ELSE 0.0 END, 6) AS kelly_fraction
FROM runners WHERE model_prob * pp_wap - 1.0 > 0.1""", ("runners",))
def q_stream_value_bets(spark, d):
    from ..functions.pricing import kelly_live, live_expected_value
    from ..sources.tables import stream_table
    from ..streaming.live import run_available
    from ..sources.views import tourney_name_of_priority  # noqa: F401  (same runner definition as batch)
    li = stream_table(spark, d, "lineitem")
    orders = Tables(spark, d).orders.select("o_orderkey", "o_orderdate")
    odds = F.lit(1.0) + F.col("l_quantity") / 10
    prob = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.lit(1.0) / odds + 2 * (F.col("l_discount") - 0.03)))
    r = (li.join(orders, li.l_orderkey == orders.o_orderkey)  # stream-static join
         .select(F.col("l_orderkey").alias("market_id"), F.col("l_suppkey").alias("selection_id"),
                 F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("line_no"),
                 odds.alias("odds"), prob.alias("prob")))
    bets = (r.withColumn("ev", live_expected_value("prob", "odds")).withColumn("kelly_fraction", kelly_live("prob", "odds"))
            .where(F.col("ev") > params.EV_THRESHOLD))
    out = run_available(spark, bets.select("market_id", "selection_id", "part_id", "line_no",
                                           r6("ev").alias("ev"), r6("kelly_fraction").alias("kelly_fraction")), "value_bets")
    return out


@register("stream_daily_pnl", """
SELECT date_trunc('day', ts) AS day, round(sum(value), 6) AS daily_pnl, count(*) AS orders
FROM events WHERE event_type = 'purchase' AND value <> 0 GROUP BY 1""")
def q_stream_daily(spark, d):
    from ..sources.tables import stream_table
    from ..streaming.live import run_available, stream_daily_pnl
    agg = stream_daily_pnl(_orders_from_events(stream_table(spark, d, "events")))
    out = run_available(spark, agg, "daily_pnl", mode="complete")
    return out.select("day", r6("daily_pnl").alias("daily_pnl"), "orders")


@register("stream_stale_orders", """
SELECT CAST(event_id AS VARCHAR) AS order_id, 'CANCEL' AS action FROM events WHERE event_type = 'view' AND value * 10 > 120""")
def q_stream_stale(spark, d):
    from ..sources.tables import stream_table
    from ..streaming.live import run_available, stream_stale_orders
    s = stream_stale_orders(_orders_from_events(stream_table(spark, d, "events")))
    return run_available(spark, s.select("order_id", "action"), "stale_orders")


@register("stream_dedup_selection", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS market_id, CAST(floor(value) AS BIGINT) AS selection_id FROM events""")
def q_stream_dedup(spark, d):
    from ..sources.tables import stream_table
    from ..streaming.live import run_available, stream_dedup_selection
    ev = stream_table(spark, d, "events").select(F.col("user_id").cast("string").alias("market_id"),
                                                 F.floor("value").cast("bigint").alias("selection_id"), "ts")
    out = run_available(spark, stream_dedup_selection(ev), "dedup")
    return out.select("market_id", "selection_id")


@register("stream_risk_state", """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT CAST(user_id AS VARCHAR) AS account, ts, CAST(ts AS DATE) AS day, event_type = 'purchase' AS settle,
         user_id || '-' || CAST(floor(value) AS BIGINT) % 40 AS k, value AS stake, value - 60.0 AS profit,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', user_id || '-' || CAST(floor(value) AS BIGINT) % 40, value) AS rn
  FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL),
f(account, rn, day, pnl, exposure, handled, opened, k, ts, stake, seen_pnl, seen_exposure, decision) AS (
  SELECT DISTINCT account, 0::BIGINT, NULL::DATE, 0.0::DOUBLE, 0.0::DOUBLE, []::VARCHAR[], []::STRUCT(k VARCHAR, s DOUBLE)[],
         NULL::VARCHAR, NULL::TIMESTAMP, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR FROM e
  UNION ALL
  SELECT f.account, e.rn, e.day, CASE WHEN e.settle THEN x.pnl + e.profit ELSE x.pnl END,
         CASE WHEN d.decision = 'DRY_RUN' THEN f.exposure + e.stake
              WHEN e.settle AND x.own IS NOT NULL THEN f.exposure - x.own ELSE f.exposure END,
         CASE WHEN d.decision IN ('DRY_RUN', 'BELOW_MIN') THEN list_append(f.handled, e.k) ELSE f.handled END,
         CASE WHEN d.decision = 'DRY_RUN' THEN list_append(f.opened, struct_pack(k := e.k, s := e.stake))
              WHEN e.settle THEN list_filter(f.opened, lambda o: o.k <> e.k) ELSE f.opened END,
         e.k, e.ts, e.stake, x.pnl, f.exposure, d.decision
  FROM f JOIN e ON e.account = f.account AND e.rn = f.rn + 1,
       LATERAL (SELECT CASE WHEN f.day = e.day THEN f.pnl ELSE 0.0 END AS pnl, list_filter(f.opened, lambda o: o.k = e.k)[1].s AS own) x,
       LATERAL (SELECT CASE WHEN e.settle THEN NULL WHEN list_contains(f.handled, e.k) THEN 'DUPLICATE' WHEN x.own IS NOT NULL THEN 'EXPOSED'
                            WHEN x.pnl <= -50.0 THEN 'RISK_BLOCKED' WHEN f.exposure + e.stake > 200.0 THEN 'EXPOSED'
                            WHEN e.stake < 0.03 THEN 'BELOW_MIN' ELSE 'DRY_RUN' END AS decision) d)
SELECT account, CAST(day AS VARCHAR) AS day, k AS selection_key, round(stake, 6) AS stake, round(seen_pnl, 6) AS pnl, round(seen_exposure, 6) AS exposure, decision
FROM f WHERE decision IS NOT NULL""")
def q_stream_risk(spark, d):
    """Purchases settle, other events are bets; five slices of time with a restart after each."""
    from ..streaming.live import run_replay, stream_risk_state
    e = Tables(spark, d).events.select(
        F.col("user_id").cast("string").alias("account"), "ts", F.when(F.col("event_type") == "purchase", "settle").otherwise("bet").alias("kind"),
        F.concat_ws("-", F.col("user_id").cast("string"), (F.floor("value").cast("bigint") % 40).cast("string")).alias("selection_key"),
        F.col("value").alias("stake"), (F.col("value") - 60).alias("profit"))
    out = run_replay(spark, {"events": (e.where(F.col("stake").isNotNull()), "ts")}, lambda events: stream_risk_state(events), "risk")
    return out.select("account", F.col("day").cast("string").alias("day"), "selection_key", r6("stake").alias("stake"), r6("pnl").alias("pnl"), r6("exposure").alias("exposure"),
                      "decision")


def _live_markets(spark, d):
    """Catalogue entries from orders (one runner in every ninth) and book updates from line items,
    by rules on the keys: either order of the runners, a stranger in the book, three runners."""
    t = Tables(spark, d)
    k = F.col("o_orderkey")
    named = lambda i: F.struct(i.alias("selection_id"), F.concat(F.lit("Runner "), i.cast("string")).alias("runner_name"))
    a, b = named(k * 2), named(k * 2 + 1)
    catalogue = t.orders.select(
        k.cast("string").alias("market_id"), F.col("o_orderdate").alias("ts"), F.lit("Match Odds").alias("market_name"),
        F.col("o_orderdate").alias("market_time"), F.col("o_orderpriority").alias("competition"), F.lit("A v B").alias("event_name"),
        F.when(k % 9 == 0, F.array(a)).when(F.col("o_custkey") % 2 == 0, F.array(a, b)).otherwise(F.array(b, a)).alias("runners"))
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    priced = lambda i, price: F.struct(i.alias("selection_id"), price.alias("best_back"), F.lit(100.0).alias("size"))
    a = priced(k * 2, F.lit(1.0) + F.col("l_quantity") / 10)
    b, other = (priced(k * 2 + i, F.lit(1.5) + line) for i in (1, 7))
    books = t.lineitem.select(
        k.cast("string").alias("market_id"), F.col("l_shipdate").alias("ts"), F.lit("OPEN").alias("status"), (line == 6).alias("inplay"),
        F.when(line % 4 == 0, F.array(a, b)).when(line % 4 == 1, F.array(b, a)).when(line % 4 == 2, F.array(a, other))
         .otherwise(F.array(a, b, other)).alias("runners"))
    return {"catalogue": (catalogue, "ts"), "books": (books, "ts")}


_LIVE_SQL = """WITH live AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS market_id, CAST(l_shipdate AS TIMESTAMP) AS ts, 'OPEN' AS status, l_linenumber = 6 AS inplay, o_orderpriority AS competition,
         o_orderkey, o_orderkey * 2 + o_custkey % 2 AS p1_id, o_orderkey * 2 + 1 - o_custkey % 2 AS p2_id,
         CASE WHEN o_custkey % 2 = 0 THEN 1.0 + l_quantity / 10 ELSE 1.5 + l_linenumber END AS p1_odds,
         CASE WHEN o_custkey % 2 = 0 THEN 1.5 + l_linenumber ELSE 1.0 + l_quantity / 10 END AS p2_odds
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderkey % 9 <> 0 AND l_linenumber % 4 IN (0, 1) AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 400 DAYS)"""


def _joined(catalogue, books):
    """The tables span years and land in slices, so the watermark must not overtake any of them."""
    from ..streaming.live import join_catalogue_book
    return join_catalogue_book(catalogue, books, valid="400 days", delay="10000 days")


@register("join_catalogue_book", _LIVE_SQL + """
SELECT market_id, ts, status, inplay, competition, p1_id, 'Runner ' || p1_id AS p1_name, round(p1_odds, 6) AS p1_odds,
       p2_id, 'Runner ' || p2_id AS p2_name, round(p2_odds, 6) AS p2_odds FROM live""")
def q_join_catalogue_book(spark, d):
    from ..streaming.live import run_replay
    j = run_replay(spark, _live_markets(spark, d), _joined, "catalogue_book", idle=False)
    r = lambda i, f: F.col("runners")[i - 1][f]
    return j.select("market_id", "ts", "status", "inplay", "competition",
                    *[c for i in (1, 2) for c in (r(i, "selection_id").alias(f"p{i}_id"), r(i, "runner_name").alias(f"p{i}_name"),
                                                  r6(r(i, "best_back")).alias(f"p{i}_odds"))])


@register("stream_bet_rows", _LIVE_SQL + """
SELECT market_id, ts, selection_id, 'Runner ' || selection_id AS player_name, round(odds, 6) AS odds, round(prob * odds - 1.0, 6) AS ev,
       printf('%.2f%%', prob * 100) AS model_prob, printf('%+.2f%%', (prob * odds - 1.0) * 100) AS ev_text,
       round(greatest(0.0, (prob * odds - 1.0) / (odds - 1.0)), 6) AS kelly_fraction, market_id || '-' || selection_id AS selection_key
FROM (SELECT market_id, ts, p1_id AS selection_id, p1_odds AS odds, (1 + o_orderkey % 97) / 100.0::DOUBLE AS prob FROM live
      UNION ALL SELECT market_id, ts, p2_id, p2_odds, 1.0 - (1 + o_orderkey % 97) / 100.0::DOUBLE FROM live)
WHERE prob * odds - 1.0 > 0.1""")
def q_stream_bet_rows(spark, d):
    """Catalogue and book as streams → features → a probability by a rule on the market → bet rows."""
    from ..streaming.live import player_snapshot, run_replay, stream_features, stream_value_bets
    from .features import player_rows
    totals, surf = player_snapshot(player_rows(views.matches(Tables(spark, d))).withColumnRenamed("ts", "tourney_date"))

    def plan(catalogue, books):
        scored = stream_features(_joined(catalogue, books), totals, surf).withColumn(
            "p1_predicted_prob", (F.lit(1) + F.col("market_id").cast("bigint") % 97) / F.lit(100.0))
        return stream_value_bets(scored).select("market_id", "ts", "selection_id", "player_name", "odds", "ev", "model_prob", "ev_text",
                                                "kelly_fraction", "selection_key")
    out = run_replay(spark, _live_markets(spark, d), plan, "bet_rows", batches=2, idle=False)
    return out.withColumns({c: r6(c) for c in ("odds", "ev", "kelly_fraction")})


# ---------------------------------------------------------------- match log, market table, realistic back-test join

HIST_OFFSET = 100000  # historical ids live in their own id space


def _er_supplier(spark, d):
    """Runner names = supplier names; the player map is the exact-name pass against the
    historical register (same names, ids offset into their own space)."""
    from ..operators import resolve
    t = Tables(spark, d)
    sup = t.supplier.select("s_suppkey", "s_name")
    src = sup.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))
    hist = sup.select((F.col("s_suppkey") + HIST_OFFSET).alias("historical_id"), F.col("s_name").alias("historical_name"))
    r = views.runners(t)
    odds = r.join(sup, r.selection_id == sup.s_suppkey).withColumnRenamed("s_name", "selection_name").drop("s_suppkey")
    return odds, resolve.map_exact(src, hist)


def _history(spark, d):
    t = Tables(spark, d)
    m = views.matches(t)
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    c = t.customer.select("c_custkey", "c_mktsegment")
    return (m.join(o, m.match_id == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
            .select("tourney_date", (F.col("winner_id") + HIST_OFFSET).alias("winner_id"),
                    (F.col("loser_id") + HIST_OFFSET).alias("loser_id"),
                    F.concat(F.initcap("c_mktsegment"), F.lit(" Open")).alias("tourney_name"),
                    F.when(F.col("o_totalprice") > 200000, "6-4 3-6 6-3").otherwise("6-4 6-3").alias("score")))


_PMAP_SQL = f"""pmap AS (SELECT s.s_suppkey AS source_id, min(h.s_suppkey + {HIST_OFFSET}) AS historical_id
                FROM supplier s JOIN supplier h ON s.s_name = h.s_name GROUP BY s.s_suppkey)"""
_HIST_SQL = f"""hist AS (
  SELECT d, p1, p2, tourney_name, score FROM (
    SELECT *, row_number() OVER (PARTITION BY d, p1, p2 ORDER BY tourney_name DESC, score DESC) AS rn FROM (
      SELECT DISTINCT CAST(m.tourney_date AS DATE) AS d, least(m.winner_id, m.loser_id) + {HIST_OFFSET} AS p1,
             greatest(m.winner_id, m.loser_id) + {HIST_OFFSET} AS p2,
             upper(c.c_mktsegment[1]) || lower(c.c_mktsegment[2:]) || ' Open' AS tourney_name,
             CASE WHEN o.o_totalprice > 200000 THEN '6-4 3-6 6-3' ELSE '6-4 6-3' END AS score
      FROM matches m JOIN orders o ON m.match_id = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey))
  WHERE rn = 1)"""


def _surface_sql(col: str) -> str:
    lc = f"lower({col})"
    g = " OR ".join(f"contains({lc}, '{k.replace(chr(39), chr(39) * 2)}')" for k in params.GRASS_KEYWORDS)
    c = " OR ".join(f"contains({lc}, '{k}')" for k in params.CLAY_KEYWORDS)
    return (f"CASE WHEN {col} IS NULL THEN 'Unknown' WHEN contains({lc}, '(clay)') THEN 'Clay' "
            f"WHEN contains({lc}, '(grass)') THEN 'Grass' WHEN contains({lc}, '(hard)') THEN 'Hard' "
            f"WHEN {g} THEN 'Grass' WHEN {c} THEN 'Clay' ELSE 'Hard' END")


@register("build_match_log", f"""
WITH {_PMAP_SQL},
st AS (SELECT r.*, p.historical_id FROM runners r JOIN pmap p ON r.selection_id = p.source_id
       WHERE r.result IN ('WINNER', 'LOSER') AND p.historical_id IS NOT NULL),
wl AS (SELECT market_id AS match_id, max(tourney_date) AS tourney_date, max(tourney_name) AS tourney_name,
              max(CASE WHEN result = 'WINNER' THEN historical_id END) AS w, max(CASE WHEN result = 'LOSER' THEN historical_id END) AS l
       FROM st GROUP BY market_id
       HAVING count(*) = 2 AND sum(CASE WHEN result = 'WINNER' THEN 1 ELSE 0 END) = 1
          AND sum(CASE WHEN result = 'LOSER' THEN 1 ELSE 0 END) = 1),
{_HIST_SQL},
ml AS (SELECT wl.match_id, wl.w, wl.l, coalesce(wl.tourney_name, hist.tourney_name) AS tourney_name, hist.score
       FROM wl LEFT JOIN hist ON CAST(wl.tourney_date AS DATE) = hist.d AND least(wl.w, wl.l) = hist.p1
                              AND greatest(wl.w, wl.l) = hist.p2)
SELECT match_id, w AS winner_historical_id, l AS loser_historical_id, tourney_name, {_surface_sql('tourney_name')} AS surface,
       CAST(coalesce(len(list_filter(string_split_regex(trim(score), '\\s+'), lambda x: x <> '')), 0) AS INTEGER) AS sets_played
FROM ml""", ("matches",))
def q_build_match_log(spark, d):
    from .matchlog import build_match_log
    odds, pmap = _er_supplier(spark, d)
    ml = build_match_log(odds, pmap, _history(spark, d))
    return ml.select("match_id", "winner_historical_id", "loser_historical_id", "tourney_name", "surface", "sets_played")


@register("build_market_data", f"""
WITH {_PMAP_SQL},
mp AS (SELECT r.*, p.historical_id FROM runners r JOIN pmap p ON r.selection_id = p.source_id WHERE p.historical_id IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY line_no, historical_id, part_id) AS rn,
              count(*) OVER (PARTITION BY market_id) AS n FROM mp),
md AS (SELECT a.market_id AS match_id, a.historical_id AS a_id, b.historical_id AS b_id, a.pp_wap AS a_odds, b.pp_wap AS b_odds,
              CAST(a.result = 'WINNER' AS INTEGER) AS a_win
       FROM rk a JOIN rk b ON a.market_id = b.market_id AND a.rn = 1 AND b.rn = 2 WHERE a.n = 2)
SELECT match_id, least(a_id, b_id) AS p1_id, greatest(a_id, b_id) AS p2_id,
       round(CASE WHEN a_id > b_id THEN b_odds ELSE a_odds END, 6) AS p1_odds,
       round(CASE WHEN a_id > b_id THEN a_odds ELSE b_odds END, 6) AS p2_odds,
       CASE WHEN a_id > b_id THEN 1 - a_win ELSE a_win END AS winner,
       round(1.0 / a_odds + 1.0 / b_odds - 1.0, 6) AS book_margin
FROM md""", ("runners",))
def q_build_market_data(spark, d):
    from .matchlog import build_market_data
    odds, pmap = _er_supplier(spark, d)
    md = build_market_data(odds, pmap, ["line_no", "selection_id", "part_id"])
    return md.select("match_id", "p1_id", "p2_id", r6("p1_odds").alias("p1_odds"), r6("p2_odds").alias("p2_odds"),
                     "winner", r6("book_margin").alias("book_margin"))


@register("join_backtest_market", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY line_no, selection_id, part_id) AS rn,
                  count(*) OVER (PARTITION BY market_id) AS n FROM runners),
md AS (SELECT a.market_id AS m_match_id, a.tourney_date, least(a.selection_id, b.selection_id) AS p1_id,
              greatest(a.selection_id, b.selection_id) AS p2_id,
              CASE WHEN a.selection_id > b.selection_id THEN b.pp_wap ELSE a.pp_wap END AS p1_odds,
              CASE WHEN a.selection_id > b.selection_id THEN a.pp_wap ELSE b.pp_wap END AS p2_odds,
              CASE WHEN a.selection_id > b.selection_id THEN 1 - CAST(a.result = 'WINNER' AS INTEGER)
                   ELSE CAST(a.result = 'WINNER' AS INTEGER) END AS winner
       FROM r a JOIN r b ON a.market_id = b.market_id AND a.rn = 1 AND b.rn = 2 WHERE a.n = 2)
SELECT m.match_id, md.m_match_id, md.p1_id, md.p2_id, round(md.p1_odds, 6) AS p1_odds, round(md.p2_odds, 6) AS p2_odds, md.winner
FROM matches m JOIN md ON least(m.winner_id, m.loser_id) = md.p1_id AND greatest(m.winner_id, m.loser_id) = md.p2_id
 AND CAST(m.tourney_date AS DATE) = CAST(md.tourney_date AS DATE)""", ("matches",))
def q_join_backtest_market(spark, d):
    from .features import build_match_features
    from .matchlog import canonical_market, join_backtest_market
    t = Tables(spark, d)
    feats = build_match_features(views.matches(t))
    md = canonical_market(markets.first_last_runner(views.runners(t), RUNNER_ORDER, prob_col=None))
    j = join_backtest_market(feats, md)
    return j.select("match_id", "m_match_id", "p1_id", "p2_id", r6("p1_odds").alias("p1_odds"), r6("p2_odds").alias("p2_odds"),
                    "winner")


def books(spark, d):
    """Book updates derived from orders: market = order, update time = order date + (key mod 50)
    minutes, start = order date + 1 h, status by order status, every 7th in play, competition =
    the tournament name of the order priority, event 'Customer v Clerk-style' names from the
    customer; runners = the market's first and last line (two-runner books)."""
    from ..sources.views import tourney_name_of_priority
    t = Tables(spark, d)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    r = views.runners(t)
    key = F.struct(*[F.col(x) for x in RUNNER_ORDER])
    runner = F.struct(F.col("selection_id").alias("selection_id"), F.lit(None).cast("string").alias("runner_name"),
                      F.col("pp_wap").alias("best_back"), F.lit(100.0).alias("size"))
    rr = r.groupBy("market_id").agg(F.min_by(runner, key).alias("a"), F.max_by(runner, key).alias("b"),
                                    F.count(F.lit(1)).alias("n"))
    b = (o.join(c, o.o_custkey == c.c_custkey)
         .select(F.col("o_orderkey").alias("market_id"),
                 F.timestamp_micros(F.unix_micros("o_orderdate") + F.pmod("o_orderkey", F.lit(50)) * 60_000_000).alias("ts"),
                 F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "CLOSED")
                  .otherwise("SUSPENDED").alias("status"),
                 (F.pmod("o_orderkey", F.lit(7)) == 0).alias("inplay"),
                 F.timestamp_micros(F.unix_micros("o_orderdate") + 3_600_000_000).alias("market_time"),
                 F.concat(F.lit("Match Odds "), F.col("c_mktsegment")).alias("market_name"),
                 tourney_name_of_priority(F.col("o_orderpriority")).alias("competition"),
                 F.when(F.pmod("o_custkey", F.lit(4)) == 0, F.col("c_name"))
                  .otherwise(F.concat(F.col("c_name"), F.lit(" v "), F.col("c_mktsegment"))).alias("event_name")))
    return b.join(rr, "market_id").withColumn(
        "runners", F.when(F.col("n") == 2, F.array("a", "b")).otherwise(F.array("a"))).drop("a", "b", "n") \
        .withColumn("market_id", F.col("market_id").cast("string"))


@register("filter_market_eligible", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority FROM orders),
b AS (SELECT o.o_orderkey AS market_id, o.o_orderdate + (o.o_orderkey % 50) * INTERVAL 1 MINUTE AS ts,
             CASE WHEN o.o_orderstatus = 'O' THEN 'OPEN' WHEN o.o_orderstatus = 'F' THEN 'CLOSED' ELSE 'SUSPENDED' END AS status,
             o.o_orderkey % 7 = 0 AS inplay, o.o_orderdate + INTERVAL 1 HOUR AS market_time,
             CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Wimbledon Grand Slam' WHEN '2-HIGH' THEN 'Madrid Masters'
                  WHEN '3-MEDIUM' THEN 'Challenger Rome (hard)' WHEN '4-NOT SPECIFIED' THEN 'ITF Futures Newport'
                  WHEN '5-LOW' THEN 'UTR Pro Series Halle' ELSE o.o_orderpriority END AS competition,
             CASE WHEN o.o_custkey % 4 = 0 THEN c.c_name ELSE c.c_name || ' v ' || c.c_mktsegment END AS event_name
      FROM o JOIN customer c ON o.o_custkey = c.c_custkey
      WHERE o.o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem))
SELECT CAST(market_id AS VARCHAR) AS market_id FROM b
WHERE competition IS NOT NULL AND event_name IS NOT NULL AND contains(event_name, ' v ') AND status = 'OPEN' AND NOT inplay
  AND epoch_us(market_time) - epoch_us(ts) > 60000000 AND epoch_us(market_time) - epoch_us(ts) < 3600000000
  AND competition IN ('Wimbledon Grand Slam', 'Madrid Masters', 'Challenger Rome (hard)', 'ITF Futures Newport')""")
def q_eligible(spark, d):
    from ..params import LiveParams
    from ..streaming.live import filter_market_eligible
    e = filter_market_eligible(books(spark, d), LiveParams())
    return e.select("market_id")


@register("stream_features_value_bets", """
SELECT CAST(market_id AS VARCHAR) AS market_id, selection_id, round(prob * odds - 1.0, 6) AS ev
FROM (SELECT a.market_id, a.selection_id, a.pp_wap AS odds, a.model_prob AS prob
      FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY line_no, selection_id, part_id) AS rn,
                   count(*) OVER (PARTITION BY market_id) AS n FROM runners) a WHERE a.rn = 1 AND a.n = 2
      UNION ALL
      SELECT a.market_id, b.selection_id, b.pp_wap, 1.0 - a.model_prob
      FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY line_no, selection_id, part_id) AS rn,
                   count(*) OVER (PARTITION BY market_id) AS n FROM runners) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY line_no, selection_id, part_id) AS rn FROM runners) b
        ON a.market_id = b.market_id AND a.rn = 1 AND b.rn = 2 WHERE a.n = 2)
WHERE odds IS NOT NULL AND prob * odds - 1.0 > 0.1""", ("runners",))
def q_stream_feature_bets(spark, d):
    """Two-runner books → features from snapshot tables (stream-static joins) → the p1
    probability (here the runner table's model probability) → live value bets."""
    from ..streaming.live import player_snapshot, stream_features, stream_value_bets
    t = Tables(spark, d)
    bk = books(spark, d)
    from ..plans.features import player_rows
    totals, surf = player_snapshot(player_rows(views.matches(t)).withColumnRenamed("ts", "tourney_date"))
    feats = stream_features(bk, totals, surf)
    r = views.runners(t)
    p1 = markets.first_last_runner(r, RUNNER_ORDER).select(F.col("match_id").cast("string").alias("market_id"),
                                                           F.col("p1_model_prob").alias("p1_predicted_prob"))
    scored = feats.join(p1, "market_id")
    return stream_value_bets(scored).select("market_id", "selection_id", r6("ev").alias("ev"))


@register("live_player_agg", """
WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT q.event_id AS row_id, count(h.event_id) AS n, CAST(coalesce(sum(h.won), 0) AS BIGINT) AS wins,
       round(coalesce(sum(h.won) / count(h.event_id), 0.0), 6) AS win_perc
FROM q LEFT JOIN outcomes h ON h.player_id = q.user_id AND h.ts < q.ts GROUP BY q.event_id""", ("outcomes",))
def q_live_player_agg(spark, d):
    from ..operators.pit import history_before
    t = Tables(spark, d)
    qs = t.events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    h = views.outcomes(t)
    r = history_before(qs.withColumnRenamed("user_id", "player_id"), h, key="player_id", ts="ts", qid="event_id",
                       values={"wins": F.col("won").cast("bigint")})
    return r.select(F.col("event_id").alias("row_id"), "n", "wins",
                    r6(F.coalesce(F.try_divide(F.col("wins").cast("double"), F.col("n").cast("double")), F.lit(0.0))).alias("win_perc"))


@register("live_load_agg", """
WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT q.event_id AS row_id,
       count(h.event_id) FILTER (WHERE h.ts >= q.ts - INTERVAL 7 DAYS) AS matches_last_7_days,
       count(h.event_id) FILTER (WHERE h.ts >= q.ts - INTERVAL 14 DAYS) AS matches_last_14_days,
       CAST(coalesce(sum(h.sets_played) FILTER (WHERE h.ts >= q.ts - INTERVAL 7 DAYS), 0) AS BIGINT) AS sets_played_last_7_days,
       CAST(coalesce(sum(h.sets_played) FILTER (WHERE h.ts >= q.ts - INTERVAL 14 DAYS), 0) AS BIGINT) AS sets_played_last_14_days
FROM q LEFT JOIN outcomes h ON h.player_id = q.user_id AND h.ts < q.ts AND h.ts >= q.ts - INTERVAL 14 DAYS
GROUP BY q.event_id""", ("outcomes",))
def q_live_load_agg(spark, d):
    from ..operators.pit import history_before
    t = Tables(spark, d)
    qs = t.events.where(F.col("event_type") == "purchase").select("event_id", F.col("user_id").alias("player_id"), "ts")
    r = history_before(qs, views.outcomes(t), key="player_id", ts="ts", qid="event_id",
                       values={"sets": F.col("sets_played")}, spans={"7": 7 * 86400, "14": 14 * 86400})
    return r.select(F.col("event_id").alias("row_id"), F.col("n_7").alias("matches_last_7_days"),
                    F.col("n_14").alias("matches_last_14_days"), F.col("sets_7").cast("bigint").alias("sets_played_last_7_days"),
                    F.col("sets_14").cast("bigint").alias("sets_played_last_14_days"))


# ---------------------------------------------------------------- small relational helpers

@register("distinct_runners", """
SELECT DISTINCT r.selection_id AS runner_id, s.s_name AS runner_name FROM runners r JOIN supplier s ON r.selection_id = s.s_suppkey""",
          ("runners",))
def q_distinct_runners(spark, d):
    odds, _ = _er_supplier(spark, d)
    return markets.distinct_runners(odds)


@register("unique_values", """
SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1""")
def q_unique_values(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey")
    return markets.unique_values(li, "l_orderkey")


@register("dedup_keep_first", """
SELECT market_id, selection_id, line_no FROM (
  SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY line_no, selection_id, part_id) AS rn FROM runners) WHERE rn = 1""",
          ("runners",))
def q_dedup_first(spark, d):
    r = views.runners(Tables(spark, d))
    return markets.dedup_keep_first(r, ["market_id"], RUNNER_ORDER).select("market_id", "selection_id", "line_no")


@register("dedup_keep_none", """
SELECT market_id, selection_id FROM runners WHERE market_id IN (SELECT market_id FROM runners GROUP BY 1 HAVING count(*) = 1)""",
          ("runners",))
def q_dedup_none(spark, d):
    r = views.runners(Tables(spark, d))
    return markets.dedup_keep_none(r, ["market_id"]).select("market_id", "selection_id")


@register("day_floor_diff", """
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey,
       CAST(floor((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400000000) AS BIGINT) AS days
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def q_day_floor(spark, d):
    from ..functions.text import day_floor_diff
    t = Tables(spark, d)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                                                            day_floor_diff("l_shipdate", "o_orderdate").alias("days"))


@register("union_with_missing", """
SELECT user_id AS player, event_id, CAST(floor(value) AS BIGINT) AS rank, NULL AS tours FROM events WHERE event_type = 'view'
UNION ALL
SELECT user_id, event_id, CAST(floor(value) AS BIGINT), event_type FROM events WHERE event_type = 'click'""")
def q_union_missing(spark, d):
    from ..operators.reshape import union_tours
    e = Tables(spark, d).events
    four = e.where(F.col("event_type") == "view").select(F.col("user_id").alias("player"), "event_id",
                                                           F.floor("value").cast("bigint").alias("rank"))
    five = e.where(F.col("event_type") == "click").select(F.col("user_id").alias("player"), "event_id",
                                                            F.floor("value").cast("bigint").alias("rank"),
                                                            F.col("event_type").alias("tours"))
    return union_tours([four, five])


@register("match_label", """
SELECT market_id, coalesce(competition, 'N/A') || ' - ' || coalesce(event_name, 'N/A') AS match FROM (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS market_id,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Wimbledon Grand Slam' WHEN '2-HIGH' THEN 'Madrid Masters'
              WHEN '3-MEDIUM' THEN 'Challenger Rome (hard)' WHEN '4-NOT SPECIFIED' THEN 'ITF Futures Newport'
              WHEN '5-LOW' THEN 'UTR Pro Series Halle' ELSE o.o_orderpriority END AS competition,
         CASE WHEN o.o_custkey % 4 = 0 THEN c.c_name ELSE c.c_name || ' v ' || c.c_mktsegment END AS event_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
def q_match_label(spark, d):
    from ..functions.text import match_label
    b = books(spark, d)
    return b.select("market_id", match_label("competition", "event_name").alias("match"))


# ---------------------------------------------------------------- live helpers and projections over derived tables

_BOOKS_SQL = """b AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS market_id, o.o_orderdate + INTERVAL 1 HOUR AS market_time, n.n
  FROM orders o JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) n ON n.l_orderkey = o.o_orderkey)"""


@register("filter_two_runner", f"""
WITH {_BOOKS_SQL}
SELECT market_id FROM b WHERE n = 2""")
def q_filter_two_runner(spark, d):
    from ..streaming.live import filter_two_runner
    return filter_two_runner(books(spark, d)).select("market_id")


@register("topk_markets", f"""
WITH {_BOOKS_SQL}
SELECT market_id FROM b WHERE market_time IS NOT NULL ORDER BY market_time, market_id LIMIT 195""")
def q_topk_markets(spark, d):
    from ..streaming.live import topk_markets
    return topk_markets(books(spark, d), params.STREAM_LIMIT).select("market_id")


@register("subscription_diff", f"""
WITH {_BOOKS_SQL},
t AS (SELECT market_id FROM (SELECT market_id FROM b WHERE market_time IS NOT NULL ORDER BY market_time, market_id LIMIT 195)),
c AS (SELECT market_id FROM (SELECT market_id FROM b WHERE market_time IS NOT NULL ORDER BY market_time, market_id LIMIT 195 OFFSET 100))
SELECT coalesce(t.market_id, c.market_id) AS market_id,
       CASE WHEN c.market_id IS NULL THEN 'ADDED' WHEN t.market_id IS NULL THEN 'REMOVED' ELSE 'KEPT' END AS change
FROM t FULL OUTER JOIN c ON t.market_id = c.market_id""")
def q_subscription_diff(spark, d):
    """Target = the first 195 markets by start; current = the 195 after skipping 100 (a
    subscription taken one poll earlier on a shifted window)."""
    from ..streaming.live import subscription_diff, topk_markets
    b = books(spark, d)
    target = topk_markets(b, params.STREAM_LIMIT)
    first295 = topk_markets(b, params.STREAM_LIMIT + 100)
    current = first295.join(topk_markets(b, 100).select("market_id"), "market_id", "left_anti")
    return subscription_diff(target, current)


@register("stream_stake", """
SELECT market_id, side, round(1000.0 * least(kelly_fraction * 0.1, 0.05), 6) AS stake,
       CASE WHEN 1000.0 * least(kelly_fraction * 0.1, 0.05) < 0.03 THEN 'BELOW_MIN' ELSE 'DRY_RUN' END AS decision
FROM bets""", ("bets",))
def q_stream_stake(spark, d):
    from ..streaming.live import stream_stake
    s = stream_stake(value_bets(spark, d))
    return s.select("market_id", "side", r6("stake").alias("stake"), "decision")




def _ambiguous_sql():
    from .catalog import ER_CASCADE_SQL
    from .oracle_views import with_views
    return with_views(["source_players", "historical_players"], ER_CASCADE_SQL + """
SELECT source_id, historical_id, method FROM allm WHERE confidence < 99.5""")


def q_filter_ambiguous(spark, d):
    from ..operators import resolve
    from .catalog import _er_inputs
    s, h = _er_inputs(spark, d)
    return resolve.filter_ambiguous_map(resolve.map_cascade(s, h), 99.5).select("source_id", "historical_id", "method")


from .catalog import REGISTRY as _R, Query as _Q  # noqa: E402
_R["filter_ambiguous_map"] = _Q("filter_ambiguous_map", q_filter_ambiguous, _ambiguous_sql())


def _topk_sql() -> str:
    """All names of a block scored, best five kept."""
    from .catalog import ER_CASCADE_SQL
    start = ER_CASCADE_SQL.index("\nhn AS")
    scored = ER_CASCADE_SQL[start:ER_CASCADE_SQL.index("\nm5 AS")].rstrip().rstrip(",").replace("FROM r4 s", "FROM source_players s")
    return "WITH " + scored.lstrip() + """
SELECT source_id, source_name, hname AS candidate_name, hid AS candidate_id, round(score, 6) AS score, CAST(rn AS INTEGER) AS candidate_rank
FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, hname, hid) AS rn FROM sc) WHERE rn <= 5"""


@register("topk_candidates", _topk_sql(), ("source_players", "historical_players"))
def q_topk_candidates(spark, d):
    from ..operators import resolve
    from .catalog import _er_inputs
    return resolve.topk_candidates(*_er_inputs(spark, d), k=5).withColumn("score", r6("score"))


@register("hand_default", """
SELECT player_id, coalesce(hand, 'U') AS hand FROM players_dim""", ("players_dim",))
def q_hand_default(spark, d):
    from ..functions.text import hand_default
    return views.players_dim(Tables(spark, d)).select("player_id", hand_default("hand").alias("hand"))


@register("project_final", """
SELECT match_id, tourney_date, tourney_name, surface, CAST(NULL AS VARCHAR) AS score, sets_played FROM matches""",
          ("matches",))
def q_project_final(spark, d):
    from pyspark.sql import types as T
    from ..operators.reshape import project_final
    schema = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("tourney_date", T.TimestampType()),
                           T.StructField("tourney_name", T.StringType()), T.StructField("surface", T.StringType()),
                           T.StructField("score", T.StringType()), T.StructField("sets_played", T.IntegerType())])
    return project_final(views.matches(Tables(spark, d)), schema)


@register("patch_winner", """
SELECT doc_id, CAST(coalesce(TRY_CAST(CAST(quality AS VARCHAR) AS DOUBLE), 0.0) AS INTEGER) AS winner FROM labels""")
def q_patch_winner(spark, d):
    from ..functions.pricing import patch_winner
    return Tables(spark, d).labels.select("doc_id", patch_winner("quality").alias("winner"))


@register("filter_poll_window", """
SELECT CAST(o_orderkey AS VARCHAR) AS market_id FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  AND o_orderdate + INTERVAL 1 HOUR BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-01-01 00:00:00' + INTERVAL 12 HOUR""")
def q_poll_window(spark, d):
    from ..streaming.live import filter_poll_window
    return filter_poll_window(books(spark, d), "1997-01-01 00:00:00", 12).select("market_id")


@register("filter_competition_keyword", """
SELECT CAST(o_orderkey AS VARCHAR) AS market_id FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def q_competition_keyword(spark, d):
    """Keywords 'Slam' and 'Masters' (case-sensitive) hit exactly the first two tournament
    names of the derived books."""
    from ..streaming.live import filter_competition_keyword
    return filter_competition_keyword(books(spark, d), ["Slam", "Masters"]).select("market_id")


@register("stream_eligible", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority FROM orders),
n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT o.o_orderkey AS market_id, o.o_orderdate + (o.o_orderkey % 50) * INTERVAL 1 MINUTE AS ts,
             CASE WHEN o.o_orderstatus = 'O' THEN 'OPEN' WHEN o.o_orderstatus = 'F' THEN 'CLOSED' ELSE 'SUSPENDED' END AS status,
             o.o_orderkey % 7 = 0 AS inplay, o.o_orderdate + INTERVAL 1 HOUR AS market_time,
             CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Wimbledon Grand Slam' WHEN '2-HIGH' THEN 'Madrid Masters'
                  WHEN '3-MEDIUM' THEN 'Challenger Rome (hard)' WHEN '4-NOT SPECIFIED' THEN 'ITF Futures Newport'
                  WHEN '5-LOW' THEN 'UTR Pro Series Halle' ELSE o.o_orderpriority END AS competition,
             CASE WHEN o.o_custkey % 4 = 0 THEN c.c_name ELSE c.c_name || ' v ' || c.c_mktsegment END AS event_name, n.n
      FROM o JOIN customer c ON o.o_custkey = c.c_custkey JOIN n ON n.l_orderkey = o.o_orderkey)
SELECT CAST(market_id AS VARCHAR) AS market_id FROM b
WHERE contains(event_name, ' v ') AND status = 'OPEN' AND NOT inplay AND n = 2
  AND epoch_us(market_time) - epoch_us(ts) > 60000000 AND epoch_us(market_time) - epoch_us(ts) < 3600000000
  AND competition IN ('Wimbledon Grand Slam', 'Madrid Masters', 'Challenger Rome (hard)', 'ITF Futures Newport')""")
def q_stream_eligible(spark, d):
    from ..streaming.live import stream_eligible
    return stream_eligible(books(spark, d)).select("market_id")


@register("coerce_numeric", """
SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def q_coerce_numeric(spark, d):
    e = Tables(spark, d).events.select("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("k"))
    return markets.coerce_numeric(e, {"k": "bigint"})


# ---------------------------------------------------------------- the whole feature row

def _match_features_full_sql() -> str:
    from .oracle_views import with_views
    sides = ", ".join(f"coalesce(r{i}.rank, 500) AS p{i}_rank, h{i}.hand AS p{i}_hand" for i in (1, 2))
    ranks = " ".join(f"ASOF LEFT JOIN ranked r{i} ON f.p{i}_id = r{i}.player AND d.tourney_date >= r{i}.ranking_date" for i in (1, 2))
    hands = " ".join(f"LEFT JOIN hands h{i} ON f.p{i}_id = h{i}.player_id" for i in (1, 2))
    return f"""
WITH f AS ({REGISTRY['match_features'].sql}), elo AS ({REGISTRY['elo_ratings'].sql}),
d AS ({with_views(['matches'], 'SELECT match_id, tourney_date FROM matches')}),
hands AS ({with_views(['players_dim'], 'SELECT player_id, hand FROM players_dim')}),
ranked AS (SELECT l_suppkey AS player, CAST(l_shipdate AS TIMESTAMP) AS ranking_date,
                  CAST(arg_max(1 + l_partkey % 200, l_orderkey * 8 + l_linenumber) AS BIGINT) AS rank FROM lineitem GROUP BY 1, 2),
x AS (SELECT f.*, coalesce(e.p1_elo, 1500.0) AS p1_elo, coalesce(e.p2_elo, 1500.0) AS p2_elo, {sides},
             round(coalesce(1 / nullif(f.p1_odds, 0), 0), 6) AS p1_implied_prob, round(coalesce(1 / nullif(f.p2_odds, 0), 0), 6) AS p2_implied_prob
      FROM f JOIN d USING (match_id) LEFT JOIN elo e ON f.match_id = e.match_id AND f.p1_id = e.p1_id AND f.p2_id = e.p2_id {ranks} {hands})
SELECT *, p1_rank - p2_rank AS rank_diff, round(p1_elo - p2_elo, 6) AS elo_diff FROM x"""


@register("match_features_full", _match_features_full_sql())
def q_match_features_full(spark, d):
    """Every column that the model reads: features, ratings, ranks at the match's time, hands, prices. A supplier's rank
    series is a rule on its line items."""
    from ..session import cut_lineage
    t = Tables(spark, d)
    return _full_features(spark, d, t, cut_lineage(views.matches(t)))


def _full_features(spark, d, t, m):
    """The whole feature row of stored matches ``m``, which features and ratings share."""
    from .catalog import match_features_frame
    more = {"elo": folds.elo_ratings(m), "rankings": _supplier_rankings(t), "players": views.players_dim(t), "materialize": False}
    extra = [r6("p1_elo").alias("p1_elo"), r6("p2_elo").alias("p2_elo"), F.round(r6("p1_elo") - r6("p2_elo"), 6).alias("elo_diff"), "p1_rank", "p2_rank", "rank_diff",
             "p1_hand", "p2_hand", r6("p1_implied_prob").alias("p1_implied_prob"), r6("p2_implied_prob").alias("p2_implied_prob")]
    return match_features_frame(spark, d, m, more=more, extra=extra)


# ---------------------------------------------------------------- the live feature row

def _supplier_rankings(t):
    return t.lineitem.selectExpr("l_suppkey AS player", "CAST(l_shipdate AS timestamp) AS ranking_date",
                                 "l_orderkey * 8 + l_linenumber AS event_id", "CAST(1 + l_partkey % 200 AS bigint) AS rank")


_LIVE_COUNTS = ["matches_last_7_days", "matches_last_14_days", "sets_played_last_7_days", "sets_played_last_14_days"]
_LIVE_SHARES = ["win_perc", "surface_win_perc", "form", "rolling_win_perc_20", "rolling_win_perc_50"]


def _stream_features_sql() -> str:
    from .oracle_views import with_views
    per_side = ["rank", "elo", "hand", *_LIVE_COUNTS, "win_perc", "surface_win_perc"]
    sides = ", ".join(f"max(CASE WHEN side = {i} THEN {c} END) AS p{i}_{c}" for c in per_side for i in (1, 2))
    return f"""
WITH md AS ({with_views(['market_data'], 'SELECT match_id, tourney_date, p1_id, p2_id, p1_odds, p2_odds, p1_implied_prob, p2_implied_prob FROM market_data')}),
mt AS ({with_views(['matches'], 'SELECT * FROM matches')}), elo AS ({REGISTRY['elo_ratings'].sql}),
hands AS ({with_views(['players_dim'], 'SELECT player_id, hand FROM players_dim')}),
q AS (SELECT md.*, tourney_date + (match_id % 50) * INTERVAL 1 MINUTE AS ts FROM md),
sides AS (SELECT match_id, 1 AS side, p1_id AS player, ts FROM q UNION ALL SELECT match_id, 2, p2_id, ts FROM q),
pr AS (SELECT match_id AS mid, tourney_date AS t, surface, sets_played, winner_id AS player, 1 AS won FROM mt
       UNION ALL SELECT match_id, tourney_date, surface, sets_played, loser_id, 0 FROM mt),
h AS (SELECT s.match_id, s.side, coalesce(sum(won) / count(mid), 0.0) AS win_perc,
             coalesce(sum(won) FILTER (WHERE surface = 'Hard') / nullif(count(mid) FILTER (WHERE surface = 'Hard'), 0), 0.0) AS surface_win_perc,
             count(mid) FILTER (WHERE t >= ts - INTERVAL 7 DAYS) AS matches_last_7_days,
             count(mid) FILTER (WHERE t >= ts - INTERVAL 14 DAYS) AS matches_last_14_days,
             CAST(coalesce(sum(sets_played) FILTER (WHERE t >= ts - INTERVAL 7 DAYS), 0) AS BIGINT) AS sets_played_last_7_days,
             CAST(coalesce(sum(sets_played) FILTER (WHERE t >= ts - INTERVAL 14 DAYS), 0) AS BIGINT) AS sets_played_last_14_days
      FROM sides s LEFT JOIN pr ON pr.player = s.player AND pr.t < s.ts GROUP BY 1, 2),
ranked AS (SELECT l_suppkey AS player, CAST(l_shipdate AS TIMESTAMP) AS t,
                  CAST(arg_max(1 + l_partkey % 200, l_orderkey * 8 + l_linenumber) AS BIGINT) AS rank FROM lineitem GROUP BY 1, 2),
played AS (SELECT mt.match_id, mt.tourney_date AS t, winner_id, loser_id, CASE WHEN winner_id = e.p1_id THEN p1_elo ELSE p2_elo END AS w,
                  CASE WHEN winner_id = e.p1_id THEN p2_elo ELSE p1_elo END AS l FROM mt JOIN elo e ON e.match_id = mt.match_id WHERE mt.surface = 'Hard'),
gained AS (SELECT *, 32.0 * (1.0 - 1.0 / (1.0 + power(10.0, (l - w) / 400.0))) AS gain FROM played),
after AS (SELECT player, t, arg_max(rating, match_id) AS rating FROM (
            SELECT winner_id AS player, t, match_id, w + gain AS rating FROM gained
            UNION ALL SELECT loser_id, t, match_id, l - gain FROM gained) GROUP BY 1, 2),
side AS (SELECT s.match_id, s.side, h.* EXCLUDE (match_id, side), coalesce(r.rank, 500) AS rank, coalesce(a.rating, 1500.0) AS elo, coalesce(p.hand, 'U') AS hand
         FROM sides s JOIN h ON h.match_id = s.match_id AND h.side = s.side
         ASOF LEFT JOIN ranked r ON r.player = s.player AND s.ts >= r.t ASOF LEFT JOIN after a ON a.player = s.player AND s.ts > a.t
         LEFT JOIN hands p ON p.player_id = s.player),
wide AS (SELECT match_id, {sides} FROM side GROUP BY 1),
h2h AS (SELECT q.match_id, count(*) FILTER (WHERE mt.winner_id = q.p1_id) AS h2h_p1_wins, count(*) FILTER (WHERE mt.winner_id = q.p2_id) AS h2h_p2_wins
        FROM q LEFT JOIN mt ON least(mt.winner_id, mt.loser_id) = least(q.p1_id, q.p2_id)
                           AND greatest(mt.winner_id, mt.loser_id) = greatest(q.p1_id, q.p2_id) AND mt.tourney_date < q.ts GROUP BY 1)
SELECT CAST(q.match_id AS VARCHAR) AS market_id, q.ts, 'Hard' AS surface, q.p1_id, q.p2_id, round(q.p1_odds, 6) AS p1_odds, round(q.p2_odds, 6) AS p2_odds,
       {", ".join(f"round(w.p{i}_{c}, 6) AS p{i}_{c}" for c in ("win_perc", "surface_win_perc", "elo") for i in (1, 2))},
       {", ".join(f"0.0::DOUBLE AS p{i}_{c}" for c in ("form", "rolling_win_perc_20", "rolling_win_perc_50") for i in (1, 2))},
       {", ".join(f"w.p{i}_{c}" for c in (*_LIVE_COUNTS, "rank", "hand") for i in (1, 2))}, h2h.h2h_p1_wins, h2h.h2h_p2_wins,
       round(q.p1_implied_prob, 6) AS p1_implied_prob, round(q.p2_implied_prob, 6) AS p2_implied_prob,
       round(q.p1_implied_prob + q.p2_implied_prob - 1.0, 6) AS book_margin, w.p1_rank - w.p2_rank AS rank_diff,
       round(round(w.p1_elo, 6) - round(w.p2_elo, 6), 6) AS elo_diff, {", ".join(
           f"w.p1_{c} - w.p2_{c} AS {d}" for c, d in zip(_LIVE_COUNTS, ("fatigue_diff_7_days", "fatigue_diff_14_days",
                                                                      "fatigue_sets_diff_7_days", "fatigue_sets_diff_14_days")))}
FROM q JOIN wide w USING (match_id) JOIN h2h USING (match_id)"""


@register("stream_features", _stream_features_sql())
def q_stream_features(spark, d):
    """Book updates as a stream in two slices, each micro-batch with its whole feature row as of its own time."""
    from ..session import cut_lineage
    from ..streaming.live import run_replay
    from .live_features import elo_after, live_features
    t = Tables(spark, d)
    m = cut_lineage(views.matches(t))
    elo = folds.elo_ratings(m).withColumns({c: r6(c) for c in ("p1_elo", "p2_elo")})
    history = {"rankings": _supplier_rankings(t), "ratings": cut_lineage(elo_after(m, elo)), "players": views.players_dim(t)}
    updates = cut_lineage(books(spark, d), fmt="parquet")  # each slice reads them
    out = run_replay(spark, {"books": (updates, "ts")}, lambda books: books, "features", batches=2,
                     each=lambda batch: live_features(batch, m, **history))
    rounded = [f"p{i}_{c}" for c in (*_LIVE_SHARES, "elo", "odds", "implied_prob") for i in (1, 2)] + ["book_margin"]
    out = out.withColumns({c: r6(c) for c in rounded}).withColumn("elo_diff", F.round(F.col("p1_elo") - F.col("p2_elo"), 6))
    return out.drop("market_name", "competition", "event_name", "market_time", "p1_name", "p2_name")


# ---------------------------------------------------------------- files and table models

def _folder(spark) -> str:
    """A new folder in the shared checkpoint area for files that a query writes and scans."""
    import os
    import uuid
    from ..session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), "files", uuid.uuid4().hex)


@register("scan_rankings", """
SELECT CAST(l_shipdate AS DATE)::VARCHAR AS ranking_date, CAST(l_partkey % 200 AS BIGINT) AS rank, l_suppkey AS player,
       CAST(l_quantity AS BIGINT)::VARCHAR AS points, CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber::VARCHAR END AS tours
FROM lineitem WHERE l_linenumber % 3 IN (0, 1) AND l_orderkey % 17 <> 0 AND l_partkey % 19 <> 0""")
def q_scan_rankings(spark, d):
    """Line items as ranking files of 3, 4 and 5 columns, some with bad dates or ranks, read back by the scan."""
    from ..sources.files import scan_rankings
    base = _folder(spark)
    li = Tables(spark, d).lineitem
    date = F.when(F.col("l_orderkey") % 17 == 0, "unknown").otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    rank = F.when(F.col("l_partkey") % 19 == 0, "n/a").otherwise((F.col("l_partkey") % 200).cast("string"))
    row = [date.alias("ranking_date"), rank.alias("rank"), F.col("l_suppkey").alias("player"), F.col("l_quantity").cast("bigint").alias("points"),
           F.col("l_linenumber").alias("tours")]
    for kind, width in ((0, 4), (1, 5), (2, 3)):
        li.where(F.col("l_linenumber") % 3 == kind).select(*row[:width]).write.option("header", kind != 1).csv(f"{base}/{width}")
    out = scan_rankings(spark, [f"{base}/{w}/*.csv" for w in (3, 4, 5)])
    return out.withColumn("ranking_date", F.date_format("ranking_date", "yyyy-MM-dd"))


@register("scan_match_history", """
SELECT historical_id, historical_name FROM (
  SELECT winner_id AS historical_id, 'Name ' || winner_id AS historical_name FROM matches WHERE match_id % 2 = 0 OR match_id % 3 <> 0
  UNION SELECT loser_id, 'Name ' || loser_id FROM matches WHERE match_id % 2 = 0 OR match_id % 3 <> 0)""", ("matches",))
def q_scan_match_history(spark, d):
    """Matches as history files of two column orders and one without a needed column, scanned; then their players."""
    from ..sources.files import HISTORY_COLS, historical_players, scan_match_history
    base = _folder(spark)
    m = views.matches(Tables(spark, d)).select(
        "match_id", "tourney_name", F.date_format("tourney_date", "yyyyMMdd").alias("tourney_date"), "winner_id",
        F.concat(F.lit("Name "), F.col("winner_id").cast("string")).alias("winner_name"), "loser_id",
        F.concat(F.lit("Name "), F.col("loser_id").cast("string")).alias("loser_name"), F.lit("6-4 6-4").alias("score"))
    odd = F.col("match_id") % 2 == 1
    for name, rows, cols in (("a", ~odd, HISTORY_COLS), ("b", odd & (F.col("match_id") % 3 != 0), HISTORY_COLS[::-1]),
                             ("c", odd & (F.col("match_id") % 3 == 0), HISTORY_COLS[:-1])):
        m.where(rows).select(*cols).write.option("header", True).csv(f"{base}/{name}")
    return historical_players(scan_match_history(spark, f"{base}/*/*.csv"))


def _checked(df, model: str):
    """Failing rows of a table per column and check."""
    from ..operators import dq, models
    return dq.summary(models.failures(df, models.MODELS[model], [])).select("column", "check", "failures")


@register("validate_rankings", """
SELECT * FROM (
  SELECT 'ranking_date' AS "column", 'coerce_dtype(''timestamp'')' AS "check", count(*) FILTER (WHERE l_orderkey % 17 = 0) AS failures FROM lineitem
  UNION ALL SELECT 'rank', 'coerce_dtype(''bigint'')', count(*) FILTER (WHERE l_partkey % 19 = 0) FROM lineitem
  UNION ALL SELECT 'player', 'not_nullable', count(*) FILTER (WHERE l_linenumber = 7) FROM lineitem) WHERE failures > 0""")
def q_validate_rankings(spark, d):
    li = Tables(spark, d).lineitem
    return _checked(li.select(F.when(F.col("l_orderkey") % 17 == 0, "unknown").otherwise(F.col("l_shipdate").cast("string")).alias("ranking_date"),
                              F.when(F.col("l_partkey") % 19 == 0, "n/a").otherwise((F.col("l_partkey") % 200).cast("string")).alias("rank"),
                              F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("player")), "rankings")


@register("validate_players", """
SELECT 'player_id' AS "column", 'not_nullable' AS "check", count(*) AS failures FROM part WHERE p_size % 5 = 0 HAVING count(*) > 0
UNION ALL SELECT 'player_id', 'coerce_dtype(''bigint'')', count(*) FROM part WHERE p_size % 5 = 1 HAVING count(*) > 0""")
def q_validate_players(spark, d):
    p = Tables(spark, d).part
    kind = F.col("p_size") % 5
    name = F.split("p_name", " ")
    return _checked(p.select(F.when(kind == 1, "id").when(kind > 1, F.col("p_partkey").cast("string")).alias("player_id"), name[0].alias("first_name"),
                             name[1].alias("last_name"), *[F.lit(None).cast("string").alias(c) for c in ("hand", "dob", "country_ioc")]), "players")


@register("validate_match_log", """
SELECT 'surface' AS "column", 'isin([''Hard'', ''Clay'', ''Grass'', ''Unknown''])' AS "check", count(*) AS failures FROM matches WHERE match_id % 5 = 0 HAVING count(*) > 0
UNION ALL SELECT 'match_id', 'not_nullable', count(*) FROM matches WHERE match_id % 7 = 0 HAVING count(*) > 0""", ("matches",))
def q_validate_match_log(spark, d):
    k = F.col("match_id")
    m = views.matches(Tables(spark, d)).select(
        F.when(k % 7 != 0, k).alias("match_id"), "tourney_date", "tourney_name", "winner_id", "loser_id",
        *[F.col(f"{w}_id").alias(f"{w}_historical_id") for w in ("winner", "loser")],
        *[F.lit(None).cast("string").alias(f"{w}_name") for w in ("winner", "loser")],
        F.when(k % 5 == 0, "Carpet").otherwise(F.col("surface")).alias("surface"), "sets_played")
    return _checked(m, "match_log")


# ---------------------------------------------------------------- back-test from features to report

def _scored_matches(spark, d):
    """The whole feature row with a probability by a rule on the ranks, in a model's place. The matches are
    stored once for features, ratings and this row."""
    from ..session import cut_lineage
    t = Tables(spark, d)
    matches = cut_lineage(views.matches(t))
    f = _full_features(spark, d, t, matches)
    m = matches.select("match_id", *[c for c in ("tourney_date", "tourney_name", "surface") if c not in f.columns])
    prob = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.lit(0.5) - F.col("rank_diff") / 800))
    return f.join(m, "match_id").withColumn("p1_predicted_prob", prob)


def _scored_bets_sql(p1_odds: str, p2_odds: str, body: str) -> str:
    return f"""
WITH ff AS ({REGISTRY['match_features_full'].sql}),
s AS (SELECT *, greatest(0.01::DOUBLE, least(0.99::DOUBLE, 0.5::DOUBLE - rank_diff / 800)) AS p, 1.0 / (1.0 + power(10.0, (p2_elo - p1_elo) / 400.0)) AS e FROM ff),
b AS (SELECT match_id AS market_id, 1 AS side, {p1_odds} AS odds, p AS predicted_prob, winner, rank_diff FROM s
      UNION ALL SELECT match_id, 2, {p2_odds}, 1.0 - p, 1 - winner, rank_diff FROM s),
bets AS (SELECT *, CASE WHEN winner = 1 THEN (odds - 1.0) * 0.95 ELSE -1.0 END AS pnl FROM b
         WHERE predicted_prob * (odds - 1.0) - (1.0 - predicted_prob) > 0.1 AND predicted_prob > 0.52)
{body}"""


@register("backtest_simulation", _scored_bets_sql("least((1.0 / e) / 1.05, 50.0)", "least((1.0 / (1.0 - e)) / 1.05, 50.0)", """
SELECT market_id, side, round(odds, 6) AS odds, round(predicted_prob, 6) AS predicted_prob, winner, round(pnl, 6) AS pnl FROM bets"""))
def q_backtest_simulation(spark, d):
    """Both sides priced from the ratings, then the same bets, filter and settlement as with market prices."""
    b = reports.backtest(_scored_matches(spark, d), mode="simulation")
    return b.select("market_id", "side", r6("odds").alias("odds"), r6("predicted_prob").alias("predicted_prob"), "winner", r6("pnl").alias("pnl"))


@register("bucket_summary_rank", _scored_bets_sql("p1_odds", "p2_odds", _bins_sql("rank_diff", params.RANK_BINS)))
def q_bucket_summary_rank(spark, d):
    """Bets at market prices joined to the rank differences of their matches, by bins of those. The scored
    matches are stored: bets and rank differences both read them."""
    from ..session import cut_lineage
    scored = cut_lineage(_scored_matches(spark, d), fmt="parquet")
    b = reports.bucket_summary(reports.load_bets_report(reports.backtest(scored), scored.select("match_id", "rank_diff")), "rank_diff", params.RANK_BINS)
    return b.select("bin_lo", "bin_hi", "bets", r6("pnl").alias("pnl"), r6("roi").alias("roi"))
