"""Market-level operators: settled runners, two-runner markets, first/last runner → market table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import book_margin, implied_prob

SETTLED = ("WINNER", "LOSER")


def filter_settled(runners: DataFrame, mapped_id: str = "selection_id") -> DataFrame:
    """Runners whose result is WINNER or LOSER and whose mapped id is present."""
    return runners.where(F.col("result").isin(*SETTLED) & F.col(mapped_id).isNotNull())


def join_player_map(runners: DataFrame, player_map: DataFrame, *, runner_id: str = "selection_id",
                    source_id: str = "source_id", historical_id: str = "historical_id") -> DataFrame:
    """Attach the historical id of each runner (rows without a mapping are dropped).

    The map has one row per feed id; its size grows with the player universe, not with the
    market history, so no broadcast is forced — AQE broadcasts it when its measured size
    is under the threshold and falls back to a shuffle join otherwise.
    """
    m = player_map.select(F.col(source_id).alias("_map_src"), F.col(historical_id).alias("historical_id"))
    return (runners.join(m, runners[runner_id] == m["_map_src"], "inner").drop("_map_src")
            .where(F.col("historical_id").isNotNull()))


def runner_counts(runners: DataFrame, n: int = 2) -> DataFrame:
    """Markets with exactly ``n`` runners (``count_runners_having2``)."""
    return runners.groupBy("market_id").agg(F.count(F.lit(1)).alias("runner_count")).where(F.col("runner_count") == n)


def semi_two_runner(runners: DataFrame, n: int = 2) -> DataFrame:
    """Rows of markets that have exactly ``n`` runners.

    Written as a grouped count + left-semi join; Catalyst plans the count as a partial
    aggregate, so a market with many runners is combined map-side.
    """
    return runners.join(runner_counts(runners, n).select("market_id"), "market_id", "left_semi")


def join_winner_loser(runners: DataFrame) -> DataFrame:
    """One row per market with exactly one WINNER and one LOSER (and nothing else).

    The reference pairs every WINNER row with every LOSER row of a market; markets with
    several of either are exactly the ones it multiplies. We keep the well-formed markets
    and form the pair by conditional aggregation — one shuffle, no pairs.
    """
    is_w, is_l = F.col("result") == "WINNER", F.col("result") == "LOSER"
    g = runners.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(is_w).alias("_nw"), F.count_if(is_l).alias("_nl"),
        F.max("tourney_date").alias("tourney_date"), F.max("tourney_name").alias("tourney_name"),
        F.max("surface").alias("surface"),
        F.max(F.when(is_w, F.col("selection_id"))).alias("winner_id"),
        F.max(F.when(is_l, F.col("selection_id"))).alias("loser_id"),
        F.max(F.when(is_w, F.col("pp_wap"))).alias("winner_odds"),
        F.max(F.when(is_l, F.col("pp_wap"))).alias("loser_odds"))
    return (g.where((F.col("_n") == 2) & (F.col("_nw") == 1) & (F.col("_nl") == 1))
            .withColumnRenamed("market_id", "match_id").drop("_n", "_nw", "_nl"))


def first_last_runner(runners: DataFrame, order: list[str], *, id_col: str = "selection_id",
                      prob_col: str | None = "model_prob") -> DataFrame:
    """Market table: the first runner (by ``order``) is p1, the last is p2.

    Whole-row pick via ``min_by``/``max_by`` of a struct, so a missing p1 price stays missing
    instead of silently taking p2's (as a per-column first-non-null would). Only markets
    with exactly two runners are kept. One grouped pass, map-side combined.
    """
    key = F.struct(*[F.col(c) for c in order])
    fields = [F.col(id_col).alias("id"), F.col("pp_wap").alias("odds"), F.col("result").alias("result")]
    if prob_col:
        fields.append(F.col(prob_col).alias("prob"))
    row = F.struct(*fields)
    g = (runners.groupBy("market_id")
         .agg(F.count(F.lit(1)).alias("_n"), F.max("tourney_date").alias("tourney_date"),
              F.max("tourney_name").alias("tourney_name"), F.max("surface").alias("surface"),
              F.min_by(row, key).alias("_p1"), F.max_by(row, key).alias("_p2"))
         .where(F.col("_n") == 2))
    cols = [F.col("market_id").alias("match_id"), "tourney_date", "tourney_name", "surface",
            F.col("_p1.id").alias("p1_id"), F.col("_p2.id").alias("p2_id"),
            F.col("_p1.odds").alias("p1_odds"), F.col("_p2.odds").alias("p2_odds"),
            (F.col("_p1.result") == "WINNER").cast("int").alias("winner")]
    if prob_col:
        cols.append(F.col("_p1.prob").alias("p1_model_prob"))
    out = g.select(*cols)
    return out.withColumns({"p1_implied_prob": implied_prob("p1_odds"), "p2_implied_prob": implied_prob("p2_odds")}) \
              .withColumn("book_margin", book_margin("p1_implied_prob", "p2_implied_prob"))


def canonical_pair(matches: DataFrame, a: str = "winner_id", b: str = "loser_id") -> DataFrame:
    """p1 = smaller id, p2 = larger id; ``winner`` = 1 when p1 won."""
    return matches.withColumns({"p1_id": F.least(a, b), "p2_id": F.greatest(a, b)}) \
                  .withColumn("winner", (F.col(a) == F.col("p1_id")).cast("int"))


def dedup_keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key by an explicit total order (ascending columns).

    A ``min_by`` aggregate, not a per-key window: it combines map-side, so a key holding a
    large share of the rows is reduced in every task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("_first")).select(*keys, "_first.*")


def dedup_keep_none(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every row whose key occurs more than once (grouped count + semi join, no window)."""
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") == 1).drop("_c")
    return df.join(once, keys, "left_semi")


def distinct_runners(odds: DataFrame, id_col: str = "selection_id", name_col: str = "selection_name") -> DataFrame:
    """Distinct (id, name) pairs of the feed."""
    return odds.select(F.col(id_col).alias("runner_id"), F.col(name_col).alias("runner_name")).distinct()


def unique_values(df: DataFrame, col: str) -> DataFrame:
    """Values occurring exactly once (grouped count, map-side combined)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") == 1).drop("_c")


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def coerce_numeric(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Lenient casts: values that do not convert become NULL (ANSI-safe)."""
    return df.withColumns({c: F.col(c).cast("string").try_cast(t) for c, t in cols.items()})


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Column-wise defaults (never a whole-row fill)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
