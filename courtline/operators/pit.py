"""Point-in-time (leak-free) player features over player-perspective rows.

Every feature of a row only sees rows strictly before it in the key's total order
``(ts, row_id)`` — a feature at time t is unchanged when rows at or after t are removed.
A player's first row gets 0 (``min_periods_1`` + fill).

Every feature goes through the running aggregates of ``courtline.operators.running``: one plan
for every input, which splits a hot player wherever its rows are cut, and no job at plan time.
A row without a time has no history and is none for other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import DAY_SECONDS, Agg, counts_in_spans, previous, rows_before, running


def _mean_or_zero(s: Column, c: Column) -> Column:
    return F.coalesce(F.try_divide(s.cast("double"), c.cast("double")), F.lit(0.0))


def pit_expanding_mean(df: DataFrame, keys: list[str], ts: str, row_id: str, value: str, out: str) -> DataFrame:
    """mean(value) over all earlier rows of the key (``pit_win_perc``, ``pit_surface_win_perc``)."""
    r = running(df, keys, [ts, row_id], [Agg("_pe_s", "sum", F.col(value)), Agg("_pe_c", "count", F.col(value))])
    return r.withColumn(out, _mean_or_zero(F.col("_pe_s"), F.col("_pe_c"))).drop("_pe_s", "_pe_c")


def pit_win_perc(df: DataFrame, *, player="player_id", ts="ts", row_id="row_id", won="won", out="win_perc") -> DataFrame:
    return pit_expanding_mean(df, [player], ts, row_id, won, out)


def pit_surface_win_perc(df: DataFrame, *, player="player_id", surface="surface", ts="ts", row_id="row_id",
                         won="won", out="surface_win_perc") -> DataFrame:
    return pit_expanding_mean(df, [player, surface], ts, row_id, won, out)


def pit_rolling_mean(df: DataFrame, n: int, *, player="player_id", ts="ts", row_id="row_id", won="won",
                     out: str | None = None) -> DataFrame:
    """mean(won) over the last ``n`` earlier rows (``pit_form_10``, ``pit_rolling_20/50``)."""
    out = out or f"rolling_win_perc_{n}"
    r = rows_before(df, [player], [ts, row_id], won, [n], prefix="_rm")
    return r.select(*df.columns, _mean_or_zero(F.col(f"_rm_sum_{n}"), F.col(f"_rm_cnt_{n}")).alias(out))


def pit_form_10(df: DataFrame, **kw) -> DataFrame:
    return pit_rolling_mean(df, 10, out=kw.pop("out", "form_10"), **kw)


def pit_load(df: DataFrame, *, player="player_id", ts="ts", row_id="row_id", sets="sets_played",
             days=(7, 14)) -> DataFrame:
    """Matches and sets in ``[t - d days, t)`` for each d (``pit_matches_7d/14d``, ``pit_sets_7d/14d``).

    Returns ``row_id, matches_last_<d>_days, sets_played_last_<d>_days``.
    """
    spans = {str(d): d * DAY_SECONDS for d in days}
    r = counts_in_spans(df, [player], ts, row_id, spans, {"sets": F.col(sets)})
    cols = [F.col(row_id)]
    for d in days:
        cols += [F.col(f"cnt_{d}").alias(f"matches_last_{d}_days"), F.col(f"sets_{d}").alias(f"sets_played_last_{d}_days")]
    return r.select(*cols)


def lagged_range(df: DataFrame, *, player="player_id", ts="ts", row_id="row_id", sets="sets_played",
                 days=(7, 14)) -> DataFrame:
    """Literal variant of the day-range load: the value of ``(t - d, t]`` (later peers
    excluded) *as of the player's previous row* — i.e. it lags by one row (``lagged_range_*``).

    Each row sends its value to the next position of its player, so no window holds a player.
    """
    spans = {str(d): d * DAY_SECONDS for d in days}
    v = counts_in_spans(df, [player], ts, row_id, spans, {"sets": F.col(sets)}, through_row=True)
    j = previous(df.select(player, ts, row_id).join(v, row_id), [player], [ts, row_id], row_id,
                 [f"{k}_{d}" for d in days for k in ("cnt", "sets")])
    cols = [F.col(row_id)]
    for d in days:
        cols += [F.coalesce(F.col(f"cnt_{d}"), F.lit(0)).cast("bigint").alias(f"lagged_matches_{d}_days"),
                 F.coalesce(F.col(f"sets_{d}"), F.lit(0)).alias(f"lagged_sets_{d}_days")]
    return j.select(*cols)


def running_peak(df: DataFrame, keys: list[str], ts: str, row_id: str, value: str, out: str = "peak") -> DataFrame:
    """Running max of ``value`` including the current row."""
    return running(df, keys, [ts, row_id], [Agg(out, "max", F.col(value))], include_current=True)


def history_before(queries: DataFrame, history: DataFrame, *, key: str, ts: str, qid: str,
                   values: dict[str, Column], spans: dict[str, int] | None = None) -> DataFrame:
    """Live lookups (``live_player_agg`` / ``live_load_agg``): for each query row (key, ts)
    the count and sums of the key's history rows strictly before ts, and per span d the
    same over ``[ts - d, ts)``.

    Query rows become probes on the history timeline (sorted before history rows of the
    same instant), so one running pass answers every query — no join of each query against
    the key's whole history. Returns ``qid, n, <value>`` and ``n_<span>, <value>_<span>``.
    """
    spans = spans or {}
    kind_real, kind_probe = 1, 0
    real = history.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(kind_real).alias("_kind"),
                          F.lit(None).cast(queries.schema[qid].dataType).alias("_q"), F.lit(None).cast("string").alias("_span"),
                          F.lit(1).alias("_real"), *[e.alias(f"_x_{n}") for n, e in values.items()])
    specs = [F.struct(F.lit("0").alias("s"), F.lit(0).cast("bigint").alias("us"))] + \
            [F.struct(F.lit(k).alias("s"), F.lit(int(v) * 1_000_000).cast("bigint").alias("us")) for k, v in spans.items()]
    probes = (queries.select(F.col(key).alias("_k"), F.col(ts).alias("_pt"), F.col(qid).alias("_q"),
                             F.explode(F.array(*specs)).alias("_p"))
              .select("_k", F.timestamp_micros(F.unix_micros("_pt") - F.col("_p.us")).alias("_t"),
                      F.lit(kind_probe).alias("_kind"), "_q", F.col("_p.s").alias("_span"),
                      F.lit(None).cast("int").alias("_real"),
                      *[F.lit(None).cast(real.schema[f"_x_{n}"].dataType).alias(f"_x_{n}") for n in values]))
    both = real.unionByName(probes)
    aggs = [Agg("_n", "count", F.col("_real"))] + [Agg(f"_s_{n}", "sum", F.col(f"_x_{n}")) for n in values]
    at = running(both, ["_k"], ["_t", "_kind", "_q", "_span"], aggs, keep=f"_kind = {kind_probe}")

    def val(col, span):
        return F.max(F.when(F.col("_span") == span, F.col(col)))
    outs = [val("_n", "0").alias("n")] + [F.coalesce(val(f"_s_{n}", "0"), F.lit(0)).alias(n) for n in values]
    for k in spans:
        outs.append((val("_n", "0") - val("_n", k)).alias(f"n_{k}"))
        outs += [(F.coalesce(val(f"_s_{n}", "0"), F.lit(0)) - F.coalesce(val(f"_s_{n}", k), F.lit(0))).alias(f"{n}_{k}")
                 for n in values]
    return at.groupBy(F.col("_q").alias(qid)).agg(*outs)
