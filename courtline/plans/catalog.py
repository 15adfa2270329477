"""Registered queries: one per operator of the inventory, each with its oracle SQL.

Every query reads the driver's tables (through the derived views) in full and returns a
DataFrame; every computed column is aliased to the same name in the SQL text. Doubles are
rounded to 6 digits on both sides before comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions import pricing as P
from ..functions import text as T
from ..operators import markets, pairs, pit, reshape, resolve
from ..sources import views
from ..sources.tables import Tables
from .oracle_views import with_views


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, views_needed: tuple = (), note: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, with_views(list(views_needed), sql) if sql else None, note)
        return fn
    return deco


def r6(c) -> "F.Column":
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


RUNNER_ORDER = ["line_no", "selection_id", "part_id"]

# ---------------------------------------------------------------- views / market ops


@register("filter_settled", """
SELECT market_id, selection_id, part_id, line_no, result FROM runners
WHERE result IN ('WINNER', 'LOSER') AND selection_id IS NOT NULL""", ("runners",))
def q_filter_settled(spark, d):
    return markets.filter_settled(views.runners(Tables(spark, d))).select(
        "market_id", "selection_id", "part_id", "line_no", "result")


@register("join_winner_loser", """
SELECT match_id, winner_id, loser_id, round(winner_odds, 6) AS winner_odds, round(loser_odds, 6) AS loser_odds,
       surface, tourney_name, sets_played FROM matches""", ("matches",))
def q_join_winner_loser(spark, d):
    m = views.matches(Tables(spark, d))
    return m.select("match_id", "winner_id", "loser_id", r6("winner_odds").alias("winner_odds"),
                    r6("loser_odds").alias("loser_odds"), "surface", "tourney_name", "sets_played")


@register("count_runners_having2", """
SELECT market_id, count(*) AS runner_count FROM runners GROUP BY market_id HAVING count(*) = 2""", ("runners",))
def q_count_runners(spark, d):
    return markets.runner_counts(views.runners(Tables(spark, d)), 2)


@register("semi_two_runner", """
SELECT market_id, selection_id, part_id, line_no FROM runners
WHERE market_id IN (SELECT market_id FROM runners GROUP BY market_id HAVING count(*) = 2)""", ("runners",))
def q_semi_two_runner(spark, d):
    return markets.semi_two_runner(views.runners(Tables(spark, d))).select("market_id", "selection_id", "part_id", "line_no")


FIRST_LAST_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY line_no, selection_id, part_id) AS rn,
                  count(*) OVER (PARTITION BY market_id) AS n FROM runners),
md AS (
  SELECT a.market_id AS match_id, a.tourney_date, a.tourney_name, a.surface, a.selection_id AS p1_id,
         b.selection_id AS p2_id, a.pp_wap AS p1_odds, b.pp_wap AS p2_odds,
         CAST(a.result = 'WINNER' AS INTEGER) AS winner, a.model_prob AS p1_model_prob,
         CASE WHEN a.pp_wap > 0 THEN 1.0 / a.pp_wap ELSE 0.0 END AS p1_implied_prob,
         CASE WHEN b.pp_wap > 0 THEN 1.0 / b.pp_wap ELSE 0.0 END AS p2_implied_prob
  FROM r a JOIN r b ON a.market_id = b.market_id AND a.rn = 1 AND b.rn = 2 WHERE a.n = 2)"""


@register("first_last_runner", FIRST_LAST_SQL + """
SELECT match_id, p1_id, p2_id, round(p1_odds, 6) AS p1_odds, round(p2_odds, 6) AS p2_odds, winner,
       round(p1_implied_prob, 6) AS p1_implied_prob, round(p2_implied_prob, 6) AS p2_implied_prob,
       round(CASE WHEN p1_implied_prob > 0 AND p2_implied_prob > 0 THEN p1_implied_prob + p2_implied_prob - 1.0 ELSE 0.0 END, 6) AS book_margin FROM md""", ("runners",))
def q_first_last_runner(spark, d):
    md = markets.first_last_runner(views.runners(Tables(spark, d)), RUNNER_ORDER)
    return md.select("match_id", "p1_id", "p2_id", r6("p1_odds").alias("p1_odds"), r6("p2_odds").alias("p2_odds"),
                     "winner", r6("p1_implied_prob").alias("p1_implied_prob"),
                     r6("p2_implied_prob").alias("p2_implied_prob"), r6("book_margin").alias("book_margin"))


@register("canonical_pair", """
SELECT match_id, least(winner_id, loser_id) AS p1_id, greatest(winner_id, loser_id) AS p2_id,
       CAST(winner_id = least(winner_id, loser_id) AS INTEGER) AS winner FROM matches""", ("matches",))
def q_canonical_pair(spark, d):
    return markets.canonical_pair(views.matches(Tables(spark, d))).select("match_id", "p1_id", "p2_id", "winner")


@register("to_player_perspective", """
SELECT match_id, winner_id AS player_id, loser_id AS opponent_id, 1 AS won FROM matches
UNION ALL SELECT match_id, loser_id, winner_id, 0 FROM matches""", ("matches",))
def q_perspective(spark, d):
    m = views.matches(Tables(spark, d))
    return reshape.to_player_perspective(m, keep=["match_id"]).select("match_id", "player_id", "opponent_id", "won")


@register("pivot_to_match", """
WITH pp AS (SELECT match_id, winner_id AS player_id, winner_odds AS odds, least(winner_id, loser_id) AS p1_id,
                   greatest(winner_id, loser_id) AS p2_id FROM matches
            UNION ALL SELECT match_id, loser_id, loser_odds, least(winner_id, loser_id), greatest(winner_id, loser_id) FROM matches)
SELECT match_id, p1_id, p2_id, round(max(CASE WHEN player_id = p1_id THEN odds END), 6) AS p1_odds,
       round(max(CASE WHEN player_id = p2_id THEN odds END), 6) AS p2_odds
FROM pp GROUP BY match_id, p1_id, p2_id""", ("matches",))
def q_pivot(spark, d):
    m = markets.canonical_pair(views.matches(Tables(spark, d)))
    long = m.select("match_id", "p1_id", "p2_id", F.explode(F.array(
        F.struct(F.col("winner_id").alias("player_id"), F.col("winner_odds").alias("odds")),
        F.struct(F.col("loser_id").alias("player_id"), F.col("loser_odds").alias("odds")))).alias("s")) \
        .select("match_id", "p1_id", "p2_id", "s.*")
    w = reshape.pivot_to_match(long, ["odds"])
    return w.select("match_id", "p1_id", "p2_id", r6("p1_odds").alias("p1_odds"), r6("p2_odds").alias("p2_odds"))


# ---------------------------------------------------------------- point-in-time windows (outcomes)

def _outcomes(spark, d):
    return views.outcomes(Tables(spark, d))


def _pit_sql(expr: str) -> str:
    return f"SELECT event_id AS row_id, {expr} FROM outcomes"


W_PLAYER = "PARTITION BY player_id ORDER BY ts, event_id"


@register("pit_win_perc", _pit_sql(
    f"round(coalesce(avg(won) OVER ({W_PLAYER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS win_perc"),
    ("outcomes",))
def q_pit_win_perc(spark, d):
    r = pit.pit_win_perc(_outcomes(spark, d), row_id="event_id")
    return r.select(F.col("event_id").alias("row_id"), r6("win_perc").alias("win_perc"))


def _rolling(qname, n, out):
    @register(qname, _pit_sql(
        f"round(coalesce(avg(won) OVER ({W_PLAYER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0), 6) AS {out}"),
        ("outcomes",))
    def q(spark, d):
        r = pit.pit_rolling_mean(_outcomes(spark, d), n, row_id="event_id", out=out)
        return r.select(F.col("event_id").alias("row_id"), r6(out).alias(out))
    return q


_rolling("pit_form_10", 10, "form_10")
_rolling("pit_rolling_20", 20, "rolling_win_perc_20")
_rolling("pit_rolling_50", 50, "rolling_win_perc_50")


@register("pit_surface_win_perc", _pit_sql(
    "round(coalesce(avg(won) OVER (PARTITION BY player_id, surface ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS surface_win_perc"), ("outcomes",))
def q_pit_surface(spark, d):
    r = pit.pit_surface_win_perc(_outcomes(spark, d), row_id="event_id")
    return r.select(F.col("event_id").alias("row_id"), r6("surface_win_perc").alias("surface_win_perc"))


def _range_sql(days: int) -> str:
    return (f"PARTITION BY player_id ORDER BY ts RANGE BETWEEN INTERVAL {days} DAYS PRECEDING "
            f"AND INTERVAL 1 MICROSECOND PRECEDING")


def _load_query(name, col, days, is_sets):
    sql_expr = (f"CAST(coalesce(sum(sets_played) OVER ({_range_sql(days)}), 0) AS BIGINT) AS {col}" if is_sets
                else f"count(*) OVER ({_range_sql(days)}) AS {col}")

    @register(name, _pit_sql(sql_expr), ("outcomes",))
    def q(spark, d):
        r = pit.pit_load(_outcomes(spark, d), row_id="event_id", days=(days,))
        return r.select(F.col("event_id").alias("row_id"), F.col(col).cast("bigint").alias(col))
    return q


_load_query("pit_matches_7d", "matches_last_7_days", 7, False)
_load_query("pit_matches_14d", "matches_last_14_days", 14, False)
_load_query("pit_sets_7d", "sets_played_last_7_days", 7, True)
_load_query("pit_sets_14d", "sets_played_last_14_days", 14, True)


def _lagged_sql(kind: str) -> str:
    peers = "PARTITION BY player_id, ts ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    cols, outs = [], []
    for d in (7, 14):
        frame = f"PARTITION BY player_id ORDER BY ts RANGE BETWEEN INTERVAL '{d - 1} days 23:59:59.999999' PRECEDING AND CURRENT ROW"
        if kind == "count":
            cols.append(f"count(*) OVER ({frame}) - count(*) OVER ({peers}) AS v{d}")
            outs.append(f"CAST(coalesce(lag(v{d}) OVER ({W_PLAYER}), 0) AS BIGINT) AS lagged_matches_{d}_days")
        else:
            cols.append(f"coalesce(sum(sets_played) OVER ({frame}), 0) - coalesce(sum(sets_played) OVER ({peers}), 0) AS v{d}")
            outs.append(f"CAST(coalesce(lag(v{d}) OVER ({W_PLAYER}), 0) AS BIGINT) AS lagged_sets_{d}_days")
    return (f"WITH v AS (SELECT event_id, player_id, ts, {', '.join(cols)} FROM outcomes)\n"
            f"SELECT event_id AS row_id, {', '.join(outs)} FROM v")


@register("lagged_range_count", _lagged_sql("count"), ("outcomes",))
def q_lagged_count(spark, d):
    r = pit.lagged_range(_outcomes(spark, d), row_id="event_id")
    return r.select(F.col("event_id").alias("row_id"), "lagged_matches_7_days", "lagged_matches_14_days")


@register("lagged_range_sum", _lagged_sql("sum"), ("outcomes",))
def q_lagged_sum(spark, d):
    r = pit.lagged_range(_outcomes(spark, d), row_id="event_id")
    return r.select(F.col("event_id").alias("row_id"), F.col("lagged_sets_7_days").cast("bigint").alias("lagged_sets_7_days"),
                    F.col("lagged_sets_14_days").cast("bigint").alias("lagged_sets_14_days"))


@register("running_peak", _pit_sql(
    f"round(max(CAST(sets_played AS DOUBLE)) OVER ({W_PLAYER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS peak"),
    ("outcomes",))
def q_running_peak(spark, d):
    o = _outcomes(spark, d).withColumn("v", F.col("sets_played").cast("double"))
    r = pit.running_peak(o, ["player_id"], "ts", "event_id", "v")
    return r.select(F.col("event_id").alias("row_id"), r6("peak").alias("peak"))


# ---------------------------------------------------------------- head-to-head, as-of

@register("pit_h2h", """
SELECT match_id, least(winner_id, loser_id) AS p1_id, greatest(winner_id, loser_id) AS p2_id,
  CAST(coalesce(sum(CASE WHEN winner_id < loser_id THEN 1 ELSE 0 END) OVER (PARTITION BY least(winner_id, loser_id),
       greatest(winner_id, loser_id) ORDER BY tourney_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS BIGINT) AS h2h_p1_wins,
  CAST(coalesce(sum(CASE WHEN winner_id > loser_id THEN 1 ELSE 0 END) OVER (PARTITION BY least(winner_id, loser_id),
       greatest(winner_id, loser_id) ORDER BY tourney_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS BIGINT) AS h2h_p2_wins
FROM matches_nation""", ("matches_nation",))
def q_h2h(spark, d):
    t = Tables(spark, d)
    return pairs.pit_h2h(views.matches_nation(t))


@register("asof_rank_join", """
WITH r AS (SELECT player, ranking_date, arg_max(rank, event_id) AS rank FROM rankings GROUP BY player, ranking_date),
p AS (SELECT event_id AS row_id, user_id AS player_id, ts FROM events WHERE event_type = 'purchase')
SELECT p.row_id, p.player_id, coalesce(r.rank, 500) AS rank
FROM p ASOF LEFT JOIN r ON p.player_id = r.player AND p.ts >= r.ranking_date""", ("rankings",))
def q_asof(spark, d):
    t = Tables(spark, d)
    left = t.events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("player_id"), "ts")
    j = pairs.asof_rank_join(left, views.rankings(t), player="player_id", date="ts", left_id="row_id")
    return j.select("row_id", "player_id", F.col("rank").cast("bigint").alias("rank"))


# ---------------------------------------------------------------- scalar functions

@register("surface_of", """
SELECT market_id, selection_id, part_id, line_no,
  CASE WHEN tourney_name IS NULL THEN 'Unknown'
       WHEN contains(lower(tourney_name), '(clay)') THEN 'Clay' WHEN contains(lower(tourney_name), '(grass)') THEN 'Grass'
       WHEN contains(lower(tourney_name), '(hard)') THEN 'Hard'
       WHEN contains(lower(tourney_name), 'wimbledon') OR contains(lower(tourney_name), 'queens club')
         OR contains(lower(tourney_name), 'halle') OR contains(lower(tourney_name), '''s-hertogenbosch')
         OR contains(lower(tourney_name), 'newport') THEN 'Grass'
       WHEN contains(lower(tourney_name), 'roland garros') OR contains(lower(tourney_name), 'french open')
         OR contains(lower(tourney_name), 'monte carlo') OR contains(lower(tourney_name), 'madrid')
         OR contains(lower(tourney_name), 'rome') THEN 'Clay'
       ELSE 'Hard' END AS name_surface
FROM runners""", ("runners",))
def q_surface_of(spark, d):
    r = views.runners(Tables(spark, d))
    return r.select("market_id", "selection_id", "part_id", "line_no", T.surface_of("tourney_name").alias("name_surface"))


def _category_sql(col: str) -> str:
    parts = [f"WHEN contains(lower(coalesce({col}, 'none')), '{k}') THEN '{v}'" for k, v in params.TOURNAMENT_CATEGORIES]
    return "CASE " + " ".join(parts) + f" ELSE '{params.DEFAULT_CATEGORY}' END"


@register("tournament_category", f"""
SELECT doc_id, {_category_sql('text')} AS category FROM documents""")
def q_category(spark, d):
    docs = Tables(spark, d).documents
    return docs.select("doc_id", T.tournament_category("text").alias("category"))


@register("surface_of_text", """
SELECT doc_id, CASE WHEN text IS NULL THEN 'Unknown'
       WHEN contains(lower(text), '(clay)') THEN 'Clay' WHEN contains(lower(text), '(grass)') THEN 'Grass'
       WHEN contains(lower(text), '(hard)') THEN 'Hard'
       WHEN contains(lower(text), 'wimbledon') OR contains(lower(text), 'queens club') OR contains(lower(text), 'halle')
         OR contains(lower(text), '''s-hertogenbosch') OR contains(lower(text), 'newport') THEN 'Grass'
       WHEN contains(lower(text), 'roland garros') OR contains(lower(text), 'french open')
         OR contains(lower(text), 'monte carlo') OR contains(lower(text), 'madrid') OR contains(lower(text), 'rome') THEN 'Clay'
       ELSE 'Hard' END AS surface FROM documents""")
def q_surface_text(spark, d):
    docs = Tables(spark, d).documents
    return docs.select("doc_id", T.surface_of("text").alias("surface"))


@register("sets_played", """
SELECT conv_id, turn, CAST(coalesce(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')), 0) AS INTEGER)
       AS sets_played FROM conversations""")
def q_sets_played(spark, d):
    c = Tables(spark, d).conversations
    return c.select("conv_id", "turn", T.sets_played("text").alias("sets_played"))


NAME_TOKENS = "list_filter(string_split_regex(trim(source_name), '\\s+'), lambda x: x <> '')"


@register("name_keys", f"""
SELECT source_id, lower(replace(strip_accents(source_name), '-', ' ')) AS clean,
  CASE WHEN len({NAME_TOKENS}) > 0 THEN {NAME_TOKENS}[-1] ELSE '' END AS lastname,
  CASE WHEN len({NAME_TOKENS}) = 2 THEN {NAME_TOKENS}[1][1] || ' ' || {NAME_TOKENS}[2] ELSE source_name END AS initial_lastname,
  upper(CASE WHEN len({NAME_TOKENS}) > 0 THEN {NAME_TOKENS}[-1] ELSE '' END[1]) AS block
FROM source_players""", ("source_players",))
def q_name_keys(spark, d):
    s = views.source_players(Tables(spark, d))
    return s.select("source_id", T.clean_name("source_name").alias("clean"), T.lastname("source_name").alias("lastname"),
                    T.initial_lastname("source_name").alias("initial_lastname"), T.block_key("source_name").alias("block"))


def _lev_sql(a: str, b: str) -> str:
    # the oracle engine counts bytes; the fixture's only non-ASCII letters (à, é) become one-byte stand-ins
    def enc(x):
        return f"replace(replace({x}, 'à', chr(1)), 'é', chr(2))"
    return f"levenshtein({enc(a)}, {enc(b)})"


def _sim_sql(a: str, b: str) -> str:
    def one(x, y):
        return (f"CASE WHEN greatest(length({x}), length({y})) > 0 THEN 100.0 * (1.0 - {_lev_sql(x, y)} / "
                f"greatest(length({x}), length({y}))) END")
    ta = f"array_to_string(list_sort(list_filter(string_split_regex(trim({a}), '\\s+'), lambda x: x <> '')), ' ')"
    tb = f"array_to_string(list_sort(list_filter(string_split_regex(trim({b}), '\\s+'), lambda x: x <> '')), ' ')"
    return f"greatest({one(a, b)}, {one(ta, tb)})"


@register("name_similarity", f"""
SELECT s.source_id, h.historical_id, round({_sim_sql('s.source_name', 'h.historical_name')}, 6) AS score
FROM source_players s JOIN historical_players h ON s.source_id - 1000000 = h.historical_id""",
          ("source_players", "historical_players"))
def q_name_similarity(spark, d):
    t = Tables(spark, d)
    s, h = views.source_players(t), views.historical_players(t)
    j = s.join(h, s.source_id - 1000000 == h.historical_id)
    return j.select("source_id", "historical_id", r6(T.name_similarity("source_name", "historical_name")).alias("score"))


# ---------------------------------------------------------------- pricing

@register("pricing", """
SELECT market_id, selection_id, part_id, line_no,
  round(CASE WHEN pp_wap > 0 THEN 1.0 / pp_wap ELSE 0.0 END, 6) AS implied_prob,
  round(model_prob * (pp_wap - 1.0) - (1.0 - model_prob), 6) AS expected_value,
  round(CASE WHEN pp_wap > 1 THEN greatest(0.0, (model_prob * (pp_wap - 1.0) - (1.0 - model_prob)) / (pp_wap - 1.0)) ELSE 0.0 END, 6) AS kelly_fraction,
  round(CASE WHEN pp_wap > 1 THEN greatest(0.0, model_prob - (1.0 - model_prob) / ((pp_wap - 1.0) * 0.95)) ELSE 0.0 END, 6) AS kelly_commission,
  round(CASE WHEN result = 'WINNER' THEN (pp_wap - 1.0) * 0.95 ELSE -1.0 END, 6) AS flat_pnl,
  round(model_prob * pp_wap - 1.0, 6) AS live_ev,
  round(CASE WHEN pp_wap > 1 THEN greatest(0.0, (model_prob * pp_wap - 1.0) / (pp_wap - 1.0)) ELSE 0.0 END, 6) AS kelly_live,
  round(least(CASE WHEN model_prob > 0 THEN (1.0 / model_prob) / 1.05 ELSE 50.0 END, 50.0), 6) AS sim_odds,
  concat_ws('-', CAST(market_id AS VARCHAR), CAST(selection_id AS VARCHAR)) AS selection_key
FROM runners""", ("runners",))
def q_pricing(spark, d):
    r = views.runners(Tables(spark, d))
    won = (F.col("result") == "WINNER").cast("int")
    return r.select("market_id", "selection_id", "part_id", "line_no",
                    r6(P.implied_prob("pp_wap")).alias("implied_prob"),
                    r6(P.expected_value("model_prob", "pp_wap")).alias("expected_value"),
                    r6(P.kelly_fraction("model_prob", "pp_wap")).alias("kelly_fraction"),
                    r6(P.kelly_fraction("model_prob", "pp_wap", commission=params.COMMISSION)).alias("kelly_commission"),
                    r6(P.flat_pnl("pp_wap", won)).alias("flat_pnl"),
                    r6(P.live_expected_value("model_prob", "pp_wap")).alias("live_ev"),
                    r6(P.kelly_live("model_prob", "pp_wap")).alias("kelly_live"),
                    r6(P.elo_sim_odds("model_prob")).alias("sim_odds"),
                    P.selection_key("market_id", "selection_id").alias("selection_key"))


# ---------------------------------------------------------------- entity resolution (part names)

def _er_inputs(spark, d):
    t = Tables(spark, d)
    return views.source_players(t), views.historical_players(t)


ER_EXACT_SQL = """
m1 AS (SELECT s.source_id, min(h.historical_id) AS historical_id, s.source_name, s.source_name AS matched_name,
              100.0 AS confidence, 'Exact' AS method
       FROM source_players s JOIN historical_players h ON s.source_name = h.historical_name
       GROUP BY s.source_id, s.source_name)"""


@register("map_exact", "WITH " + ER_EXACT_SQL + """
SELECT source_id, historical_id, source_name, matched_name, confidence, method FROM m1""",
          ("source_players", "historical_players"))
def q_map_exact(spark, d):
    s, h = _er_inputs(spark, d)
    return resolve.map_exact(s, h)


CLEAN_SQL = "lower(replace(strip_accents({x}), '-', ' '))"
TOK = "list_filter(string_split_regex(trim({x}), '\\s+'), lambda t: t <> '')"


def _initial_sql(x: str) -> str:
    tk = TOK.format(x=x)
    return f"CASE WHEN len({tk}) = 2 THEN {tk}[1][1] || ' ' || {tk}[2] ELSE {x} END"


def _lastname_sql(x: str) -> str:
    tk = TOK.format(x=x)
    return f"CASE WHEN len({tk}) > 0 THEN {tk}[-1] ELSE '' END"


def _guarded_sql(name: str, src: str, key_fn, method: str, conf: float) -> str:
    return f"""
{name} AS (
  WITH s AS (SELECT source_id, source_name, {key_fn('source_name')} AS k FROM {src}),
       h AS (SELECT historical_id, historical_name, {key_fn('historical_name')} AS k FROM historical_players),
       sk AS (SELECT k, count(*) AS nsrc FROM s GROUP BY k),
       hits AS (SELECT h.historical_id, sum(sk.nsrc) AS hits FROM h JOIN sk ON h.k = sk.k GROUP BY h.historical_id),
       ok AS (SELECT * FROM h WHERE historical_id IN (SELECT historical_id FROM hits WHERE hits = 1)),
       best AS (SELECT k, min(historical_id) AS historical_id FROM ok GROUP BY k)
  SELECT s.source_id, best.historical_id, s.source_name, ok.historical_name AS matched_name,
         {conf} AS confidence, '{method}' AS method
  FROM s JOIN best ON s.k = best.k JOIN ok ON ok.historical_id = best.historical_id AND ok.k = best.k)"""


ER_CASCADE_SQL = "WITH " + ER_EXACT_SQL + ",\nr1 AS (SELECT * FROM source_players WHERE source_id NOT IN (SELECT source_id FROM m1)),\n" + \
    _guarded_sql("m2", "r1", lambda x: CLEAN_SQL.format(x=x), "Exact-Cleaned", 99.5) + ",\n" + \
    "r2 AS (SELECT * FROM r1 WHERE source_id NOT IN (SELECT source_id FROM m2)),\n" + \
    _guarded_sql("m3", "r2", _initial_sql, "Initial+Lastname", 99.0) + ",\n" + \
    "r3 AS (SELECT * FROM r2 WHERE source_id NOT IN (SELECT source_id FROM m3)),\n" + f"""
ul AS (SELECT {_lastname_sql('historical_name')} AS k, count(*) AS n, min(historical_id) AS historical_id,
              min(historical_name) AS matched_name FROM historical_players GROUP BY 1 HAVING count(*) = 1),
m4 AS (SELECT s.source_id, ul.historical_id, s.source_name, ul.matched_name, 98.0 AS confidence, 'Unique Lastname' AS method
       FROM r3 s JOIN ul ON {_lastname_sql('s.source_name')} = ul.k),
r4 AS (SELECT * FROM r3 WHERE source_id NOT IN (SELECT source_id FROM m4)),
hn AS (SELECT historical_name AS hname, min(historical_id) AS hid FROM historical_players GROUP BY 1),
sc AS (SELECT s.source_id, s.source_name, hn.hname, hn.hid, {_sim_sql('s.source_name', 'hn.hname')} AS score
       FROM r4 s JOIN hn ON upper({_lastname_sql('s.source_name')}[1]) = upper({_lastname_sql('hn.hname')}[1])
       WHERE length(trim(s.source_name)) > 0 AND {_lastname_sql('s.source_name')} <> ''),
m5 AS (SELECT source_id, arg_min(hid, (-score, hname, hid)) AS historical_id, arg_min(source_name, (-score, hname, hid)) AS source_name,
              arg_min(hname, (-score, hname, hid)) AS matched_name, max(score) AS confidence, 'Fuzzy' AS method
       FROM sc WHERE score >= 85 GROUP BY source_id),
allm AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4 UNION ALL SELECT * FROM m5)"""


@register("map_cascade", ER_CASCADE_SQL + """
SELECT source_id, historical_id, source_name, matched_name, round(confidence, 6) AS confidence, method FROM allm""",
          ("source_players", "historical_players"))
def q_map_cascade(spark, d):
    s, h = _er_inputs(spark, d)
    m = resolve.map_cascade(s, h)
    return m.select("source_id", "historical_id", "source_name", "matched_name", r6("confidence").alias("confidence"), "method")


@register("map_resolve", ER_CASCADE_SQL + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC,
           CASE method WHEN 'Exact' THEN 1 WHEN 'Exact-Cleaned' THEN 2 WHEN 'Initial+Lastname' THEN 3
                       WHEN 'Unique Lastname' THEN 4 ELSE 5 END, historical_id) AS rn FROM allm)
SELECT source_id, historical_id, method FROM ranked WHERE rn = 1""", ("source_players", "historical_players"))
def q_map_resolve(spark, d):
    s, h = _er_inputs(spark, d)
    return resolve.map_resolve(resolve.map_cascade(s, h)).select("source_id", "historical_id", "method")


@register("map_fuzzy", ER_CASCADE_SQL + """
SELECT source_id, historical_id, matched_name, round(confidence, 6) AS confidence FROM m5""",
          ("source_players", "historical_players"))
def q_map_fuzzy(spark, d):
    s, h = _er_inputs(spark, d)
    m = resolve.map_cascade(s, h).where(F.col("method") == "Fuzzy")
    return m.select("source_id", "historical_id", "matched_name", r6("confidence").alias("confidence"))


# ---------------------------------------------------------------- flagship: match feature table

def _match_features_sql() -> str:
    w = "PARTITION BY player_id ORDER BY ts, row_id"
    ws = "PARTITION BY player_id, surface ORDER BY ts, row_id"

    def rng(d):
        return f"PARTITION BY player_id ORDER BY ts RANGE BETWEEN INTERVAL {d} DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
    feats = {
        "win_perc": f"coalesce(avg(won) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)",
        "form": f"coalesce(avg(won) OVER ({w} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0)",
        "rolling_win_perc_20": f"coalesce(avg(won) OVER ({w} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)",
        "rolling_win_perc_50": f"coalesce(avg(won) OVER ({w} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 0)",
        "surface_win_perc": f"coalesce(avg(won) OVER ({ws} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)",
        "matches_last_7_days": f"count(*) OVER ({rng(7)})",
        "matches_last_14_days": f"count(*) OVER ({rng(14)})",
        "sets_played_last_7_days": f"coalesce(sum(sets_played) OVER ({rng(7)}), 0)",
        "sets_played_last_14_days": f"coalesce(sum(sets_played) OVER ({rng(14)}), 0)",
    }
    fcols = ", ".join(f"{e} AS {n}" for n, e in feats.items())
    piv = []
    for n in feats:
        for side in ("p1", "p2"):
            e = f"max(CASE WHEN f.player_id = c.{side}_id THEN f.{n} END)"
            piv.append(f"round({e}, 6) AS {side}_{n}" if "perc" in n or n == "form" else f"CAST({e} AS BIGINT) AS {side}_{n}")
    h2h = ("PARTITION BY least(winner_id, loser_id), greatest(winner_id, loser_id) ORDER BY tourney_date "
           "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING")
    return f"""
WITH pm AS (SELECT match_id, tourney_date AS ts, surface, sets_played, winner_id AS player_id, 1 AS won, match_id * 2 AS row_id FROM matches
            UNION ALL SELECT match_id, tourney_date, surface, sets_played, loser_id, 0, match_id * 2 + 1 FROM matches),
f AS (SELECT match_id, player_id, {fcols} FROM pm),
c AS (SELECT match_id, least(winner_id, loser_id) AS p1_id, greatest(winner_id, loser_id) AS p2_id,
             CAST(winner_id < loser_id AS INTEGER) AS winner,
             CASE WHEN winner_id < loser_id THEN winner_odds ELSE loser_odds END AS p1_odds,
             CASE WHEN winner_id < loser_id THEN loser_odds ELSE winner_odds END AS p2_odds,
             coalesce(sum(CASE WHEN winner_id < loser_id THEN 1 ELSE 0 END) OVER ({h2h}), 0) AS h2h_p1_wins,
             coalesce(sum(CASE WHEN winner_id > loser_id THEN 1 ELSE 0 END) OVER ({h2h}), 0) AS h2h_p2_wins
      FROM matches),
x AS (SELECT c.match_id, c.p1_id, c.p2_id, c.winner, c.p1_odds, c.p2_odds, c.h2h_p1_wins, c.h2h_p2_wins, {', '.join(piv)}
      FROM c JOIN f ON f.match_id = c.match_id
      GROUP BY c.match_id, c.p1_id, c.p2_id, c.winner, c.p1_odds, c.p2_odds, c.h2h_p1_wins, c.h2h_p2_wins)
SELECT match_id, p1_id, p2_id, winner, round(p1_odds, 6) AS p1_odds, round(p2_odds, 6) AS p2_odds,
       CAST(h2h_p1_wins AS BIGINT) AS h2h_p1_wins, CAST(h2h_p2_wins AS BIGINT) AS h2h_p2_wins,
       {', '.join(f'{s}_{n}' for n in feats for s in ('p1', 'p2'))},
       round(CASE WHEN p1_odds > 0 AND p2_odds > 0 THEN 1.0 / p1_odds + 1.0 / p2_odds - 1.0 ELSE 0.0 END, 6) AS book_margin,
       p1_matches_last_7_days - p2_matches_last_7_days AS fatigue_diff_7_days,
       p1_matches_last_14_days - p2_matches_last_14_days AS fatigue_diff_14_days,
       p1_sets_played_last_7_days - p2_sets_played_last_7_days AS fatigue_sets_diff_7_days,
       p1_sets_played_last_14_days - p2_sets_played_last_14_days AS fatigue_sets_diff_14_days
FROM x"""


MATCH_FEATURE_COLS = None


def match_features_frame(spark, d, matches_df=None, more: dict | None = None, extra: list | None = None):
    from .features import PLAYER_FEATURES, build_match_features
    t = Tables(spark, d)
    out = build_match_features(matches_df if matches_df is not None else views.matches(t), **(more or {}))
    cols = ["match_id", "p1_id", "p2_id", "winner", r6("p1_odds").alias("p1_odds"), r6("p2_odds").alias("p2_odds"),
            F.col("h2h_p1_wins").cast("bigint").alias("h2h_p1_wins"), F.col("h2h_p2_wins").cast("bigint").alias("h2h_p2_wins")]
    for n in PLAYER_FEATURES:
        for s in ("p1", "p2"):
            c = f"{s}_{n}"
            cols.append(r6(c).alias(c) if ("perc" in n or n == "form") else F.col(c).cast("bigint").alias(c))
    cols += [r6("book_margin").alias("book_margin")]
    cols += [F.col(c).cast("bigint").alias(c) for c in ("fatigue_diff_7_days", "fatigue_diff_14_days",
                                                       "fatigue_sets_diff_7_days", "fatigue_sets_diff_14_days")]
    return out.select(*cols, *(extra or []))


@register("match_features", _match_features_sql(), ("matches",))
def q_match_features(spark, d):
    return match_features_frame(spark, d)


# the remaining operators register themselves on import (kept in their own module)
from . import registry_extra  # noqa: E402,F401
