"""SQL text of the derived views (see ``courtline.sources.views``) for the oracle engine.

Each view is a CTE; ``with_views`` prepends the ones a query needs, in dependency order.
The definitions mirror the DataFrame plans one for one.
"""

from __future__ import annotations

VIEW_SQL = {
    "runners": """runners AS (
  SELECT l.l_orderkey AS market_id, l.l_suppkey AS selection_id, l.l_partkey AS part_id, l.l_linenumber AS line_no,
         1.0 + l.l_quantity / 10 AS pp_wap,
         CASE WHEN l.l_returnflag = 'R' THEN 'WINNER' WHEN l.l_returnflag = 'A' THEN 'LOSER' ELSE 'VOID' END AS result,
         o.o_orderdate AS tourney_date,
         CASE WHEN o.o_orderstatus = 'F' THEN 'Clay' WHEN o.o_orderstatus = 'O' THEN 'Grass' ELSE 'Hard' END AS surface,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Wimbledon Grand Slam' WHEN '2-HIGH' THEN 'Madrid Masters'
              WHEN '3-MEDIUM' THEN 'Challenger Rome (hard)' WHEN '4-NOT SPECIFIED' THEN 'ITF Futures Newport'
              WHEN '5-LOW' THEN 'UTR Pro Series Halle' ELSE o.o_orderpriority END AS tourney_name,
         least(0.99, greatest(0.01, 1.0 / (1.0 + l.l_quantity / 10) + 2 * (l.l_discount - 0.03))) AS model_prob
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "matches": """matches AS (
  SELECT market_id AS match_id, max(tourney_date) AS tourney_date, max(tourney_name) AS tourney_name,
         max(surface) AS surface,
         max(CASE WHEN result = 'WINNER' THEN selection_id END) AS winner_id,
         max(CASE WHEN result = 'LOSER' THEN selection_id END) AS loser_id,
         max(CASE WHEN result = 'WINNER' THEN pp_wap END) AS winner_odds,
         max(CASE WHEN result = 'LOSER' THEN pp_wap END) AS loser_odds,
         CAST(2 + (sum(line_no) % 3) AS INTEGER) AS sets_played
  FROM runners GROUP BY market_id
  HAVING count(*) = 2 AND sum(CASE WHEN result = 'WINNER' THEN 1 ELSE 0 END) = 1
     AND sum(CASE WHEN result = 'LOSER' THEN 1 ELSE 0 END) = 1
     AND max(CASE WHEN result = 'WINNER' THEN selection_id END) <> max(CASE WHEN result = 'LOSER' THEN selection_id END))""",
    "matches_nation": """matches_nation AS (
  SELECT m.match_id, m.tourney_date, m.tourney_name, m.surface,
         CAST(w.s_nationkey AS BIGINT) AS winner_id, CAST(l.s_nationkey AS BIGINT) AS loser_id,
         m.winner_odds, m.loser_odds, m.sets_played
  FROM matches m JOIN supplier w ON m.winner_id = w.s_suppkey JOIN supplier l ON m.loser_id = l.s_suppkey
  WHERE w.s_nationkey <> l.s_nationkey)""",
    "outcomes": """outcomes AS (
  SELECT user_id AS player_id, ts, event_id, CAST(event_type = 'purchase' AS INTEGER) AS won,
         event_type AS surface, CAST(floor(value) AS BIGINT) AS sets_played FROM events)""",
    "rankings": """rankings AS (
  SELECT user_id AS player, ts AS ranking_date, event_id, CAST(1 + floor(value * 10) AS BIGINT) AS rank
  FROM events WHERE event_type = 'view')""",
    "historical_players": """historical_players AS (
  SELECT p_partkey AS historical_id,
         array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS historical_name
  FROM part)""",
    "source_players": """source_players AS (
  SELECT p_partkey + 1000000 AS source_id,
         CASE p_size % 5 WHEN 0 THEN n WHEN 1 THEN upper(replace(n, ' ', '-')) WHEN 2 THEN translate(n, 'ae', 'àé')
              WHEN 3 THEN n[1] || ' ' || string_split(n, ' ')[-1] ELSE n || 's' END AS source_name
  FROM (SELECT p_partkey, p_size,
               array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS n
        FROM part))""",
    "players_dim": """players_dim AS (
  SELECT s_suppkey AS player_id,
         CASE WHEN s_acctbal < 0 THEN NULL WHEN s_nationkey % 3 = 0 THEN 'R' WHEN s_nationkey % 3 = 1 THEN 'L' ELSE 'U' END AS hand
  FROM supplier)""",
    "market_data": """market_data AS (
  SELECT a.market_id AS match_id, a.tourney_date, a.tourney_name, a.surface, a.selection_id AS p1_id,
         b.selection_id AS p2_id, a.pp_wap AS p1_odds, b.pp_wap AS p2_odds,
         CAST(a.result = 'WINNER' AS INTEGER) AS winner, a.model_prob AS p1_model_prob,
         CASE WHEN a.pp_wap > 0 THEN 1.0 / a.pp_wap ELSE 0.0 END AS p1_implied_prob,
         CASE WHEN b.pp_wap > 0 THEN 1.0 / b.pp_wap ELSE 0.0 END AS p2_implied_prob
  FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY line_no, selection_id, part_id) AS rn,
               count(*) OVER (PARTITION BY market_id) AS n FROM runners) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY line_no, selection_id, part_id) AS rn FROM runners) b
    ON a.market_id = b.market_id AND a.rn = 1 AND b.rn = 2
  WHERE a.n = 2)""",
    "all_bets": """all_bets AS (
  SELECT *, predicted_prob * (odds - 1.0) - (1.0 - predicted_prob) AS expected_value,
         CASE WHEN odds > 1 THEN greatest(0.0, (predicted_prob * (odds - 1.0) - (1.0 - predicted_prob)) / (odds - 1.0))
              ELSE 0.0 END AS kelly_fraction
  FROM (SELECT match_id AS market_id, tourney_name, tourney_date, surface, 1 AS side, p1_id AS player_id,
               p1_odds AS odds, p1_model_prob AS predicted_prob, winner FROM market_data
        UNION ALL
        SELECT match_id, tourney_name, tourney_date, surface, 2, p2_id, p2_odds, 1.0 - p1_model_prob, 1 - winner
        FROM market_data))""",
    "bets": """bets AS (
  SELECT *, CASE WHEN winner = 1 THEN (odds - 1.0) * 0.95 ELSE -1.0 END AS pnl, market_id * 2 + side - 1 AS bet_id
  FROM all_bets WHERE expected_value > 0.1 AND predicted_prob > 0.52)""",
}

DEPENDS = {
    "matches": ["runners"],
    "matches_nation": ["runners", "matches"],
    "market_data": ["runners"],
    "all_bets": ["runners", "market_data"],
    "bets": ["runners", "market_data", "all_bets"],
}


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []
    for n in names:
        for d in DEPENDS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    if not order:
        return body
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(VIEW_SQL[n] for n in order) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(VIEW_SQL[n] for n in order) + ",\n" + body[5:]
    return "WITH " + ",\n".join(VIEW_SQL[n] for n in order) + "\n" + body
