"""Head-to-head and as-of operators (no pair-scans, no range joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from .running import Agg, running


def pit_h2h(matches: DataFrame, *, match_id="match_id", ts="tourney_date", winner="winner_id", loser="loser_id") -> DataFrame:
    """Earlier wins of each side in meetings of the same unordered pair, counting only
    meetings on strictly earlier dates (same-day meetings do not count).

    p1 = smaller id. Instead of scanning all earlier meetings per row (quadratic in the
    pair's history), every match emits a probe at its own time that sorts before the real
    rows of that instant; a running sum at the probe is the answer.
    A meeting without a date has no history and is none.
    Returns ``match_id, p1_id, p2_id, h2h_p1_wins, h2h_p2_wins``.
    """
    base = matches.select(F.col(match_id).alias("_mid"), F.col(ts).alias("_t"),
                          F.least(winner, loser).alias("p1_id"), F.greatest(winner, loser).alias("p2_id"),
                          F.col(winner).alias("_w"))
    # both from one reading of the matches: a union would work them out once for each side
    won = lambda p: (F.col("_w") == F.col(p)).cast("int")
    no = F.lit(None).cast("int")
    both = base.select("p1_id", "p2_id", "_t", "_mid", F.inline(F.array(
        F.struct(F.lit(0).alias("_kind"), no.alias("_a"), no.alias("_b")),
        F.struct(F.lit(1).alias("_kind"), won("p1_id").alias("_a"), won("p2_id").alias("_b")))))
    run = running(both, ["p1_id", "p2_id"], ["_t", "_kind", "_mid"],
                  [Agg("_sa", "sum", F.col("_a")), Agg("_sb", "sum", F.col("_b"))], keep="_kind = 0")
    return run.select(F.col("_mid").alias(match_id), "p1_id", "p2_id",
                      F.coalesce(F.col("_sa"), F.lit(0)).cast("bigint").alias("h2h_p1_wins"),
                      F.coalesce(F.col("_sb"), F.lit(0)).cast("bigint").alias("h2h_p2_wins"))


def asof_join(left: DataFrame, right: DataFrame, *, left_key: str, left_ts: str, left_id: str,
              right_key: str, right_ts: str, right_id: str, values: list[str], inclusive: bool = True) -> DataFrame:
    """Backward as-of join: for each left row, ``values`` of the latest right row of the
    same key with ``right_ts ≤ left_ts`` (``<`` when not ``inclusive``). Right rows with
    equal timestamps resolve to the one with the largest ``right_id``.

    Both sides are unioned into one timeline per key and a running "last non-null" carries the
    latest right values forward — O(n log n), left row count preserved, and a hot key (on either
    side) is cut like any other instead of forming a range join's pair product.
    Returns the left columns plus ``values`` (NULL when no earlier right row).
    """
    lcols = left.columns
    lk = F.col(left_key).alias("_k")
    # right rows sort before left rows at the same instant for an inclusive match
    r_kind, l_kind = (0, 1) if inclusive else (1, 0)
    l = left.select(lk, F.col(left_ts).alias("_t"), F.lit(l_kind).alias("_kind"),
                    F.col(left_id).cast(right.schema[right_id].dataType).alias("_oid"),
                    F.struct(*[F.col(c) for c in lcols]).alias("_left"),
                    *[F.lit(None).cast(right.schema[v].dataType).alias(f"_r_{v}") for v in values])
    r = right.select(F.col(right_key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(r_kind).alias("_kind"),
                     F.col(right_id).alias("_oid"),
                     F.lit(None).cast(left.select(F.struct(*[F.col(c) for c in lcols])).schema[0].dataType).alias("_left"),
                     *[F.col(v).alias(f"_r_{v}") for v in values])
    # carry one struct so that all values come from the same right row
    both = l.unionByName(r).withColumn("_rv", F.when(F.col("_kind") == r_kind, F.struct(*[F.col(f"_r_{v}") for v in values])))
    run = running(both, ["_k"], ["_t", "_kind", "_oid"], [Agg("_last", "last", F.col("_rv"))], keep=f"_kind = {l_kind}")
    return run.select("_left.*", *[F.col(f"_last._r_{v}").alias(v) for v in values])


def asof_rank_join(left: DataFrame, rankings: DataFrame, *, player="player_id", date="tourney_date", left_id="match_id",
                   default_rank: int = params.DEFAULT_PLAYER_RANK, out="rank") -> DataFrame:
    """Latest ranking with ``ranking_date ≤ date`` for each (player, date); default rank when none."""
    j = asof_join(left, rankings.select("player", "ranking_date", "event_id", "rank"), left_key=player, left_ts=date,
                  left_id=left_id, right_key="player", right_ts="ranking_date", right_id="event_id",
                  values=["rank"], inclusive=True)
    return j.withColumn(out, F.coalesce(F.col("rank"), F.lit(default_rank).cast("bigint")))
