"""Data quality: declared rules checked in one pass, all failures collected (lazy mode).

A rule is (column, check name, predicate that must hold). ``failures`` returns one row per
(row, failed rule) — an ``explode`` of the failing rules, no per-rule scan; ``summary``
aggregates them per (column, check); ``assert_valid`` raises with the summary. Nothing
is collected except the summary, whose size is bounded by the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    column: str
    check: str
    ok: Column  # must be true (NULL counts as a failure unless the rule allows it)


def not_null(c: str) -> Rule:
    return Rule(c, "not_nullable", F.col(c).isNotNull())


def isin(c: str, values, nullable: bool = True) -> Rule:
    ok = F.col(c).isin(*values)
    return Rule(c, f"isin({list(values)})", (F.col(c).isNull() | ok) if nullable else F.coalesce(ok, F.lit(False)))


def between(c: str, lo=None, hi=None, nullable: bool = True) -> Rule:
    ok = F.lit(True)
    name = []
    if lo is not None:
        ok = ok & (F.col(c) >= lo)
        name.append(f"greater_than_or_equal_to({lo})")
    if hi is not None:
        ok = ok & (F.col(c) <= hi)
        name.append(f"less_than_or_equal_to({hi})")
    return Rule(c, " & ".join(name), (F.col(c).isNull() | ok) if nullable else F.coalesce(ok, F.lit(False)))


def coercible(c: str, dtype: str) -> Rule:
    """The value (if any) converts to ``dtype``."""
    return Rule(c, f"coerce_dtype('{dtype}')", F.col(c).isNull() | F.col(c).cast("string").try_cast(dtype).isNotNull())


def failures(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """One row per failing (row, rule): keys, column, check, failure_case (as text)."""
    fails = F.filter(F.array(*[F.when(~F.coalesce(r.ok, F.lit(False)), F.struct(
        F.lit(r.column).alias("column"), F.lit(r.check).alias("check"),
        F.col(r.column).cast("string").alias("failure_case"))) for r in rules]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(fails).alias("_f")).select(*keys, "_f.*")


def summary(fails: DataFrame) -> DataFrame:
    """First failing value (smallest, as text) and count per (column, check)."""
    return fails.groupBy("column", "check").agg(F.min("failure_case").alias("failure_case"),
                                                F.count(F.lit(1)).alias("failures"))


def check_columns(df: DataFrame, schema: T.StructType, strict: bool = True) -> list[str]:
    """Schema-level problems (driver-side, no data read): missing / extra columns."""
    have = set(df.columns)
    problems = [f"missing column {f.name}" for f in schema.fields if f.name not in have and f.nullable is False]
    if strict:
        want = {f.name for f in schema.fields}
        problems += [f"unexpected column {c}" for c in df.columns if c not in want]
    return problems


def assert_columns(df: DataFrame, columns: list[str], context: str = "") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{context}: missing columns {missing}")


def assert_valid(df: DataFrame, rules: list[Rule], keys: list[str], context: str = "",
                 failure_path: str | None = None) -> DataFrame:
    """Raise with the per-rule summary when any rule fails; optionally write every failure
    row first (``failure_report_sink``). Returns ``df`` unchanged otherwise."""
    f = failures(df, rules, keys)
    s = summary(f).collect()  # bounded: one row per rule
    if s:
        if failure_path:
            f.write.mode("overwrite").parquet(failure_path)
        lines = "; ".join(f"{r['column']}/{r['check']}: {r['failures']} (e.g. {r['failure_case']})" for r in s)
        raise ValueError(f"validation failed for {context}: {lines}")
    return df


def null_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count per column in one aggregate, returned as (column, nulls) rows."""
    cols = columns or df.columns
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols]))
    return agg.select(stack.alias("_s")).select("_s.*")


# Rule sets of the pipeline's tables (fixed values: domains and ranges of the table models)
def match_log_rules() -> list[Rule]:
    return [not_null("match_id"), not_null("tourney_date"), isin("surface", ["Hard", "Clay", "Grass", "Unknown"], False)]


def features_rules() -> list[Rule]:
    rules = [not_null("market_id"), not_null("tourney_date"), isin("surface", ["Hard", "Clay", "Grass", "Unknown"], False),
             isin("winner", [0, 1], False)]
    for side in ("p1", "p2"):
        for c in ("win_perc", "surface_win_perc", "form", "implied_prob"):
            rules.append(between(f"{side}_{c}", 0, 1))
        for c in ("matches_last_7_days", "matches_last_14_days", "sets_played_last_7_days", "sets_played_last_14_days"):
            rules.append(between(f"{side}_{c}", 0, None))
    rules += [between("h2h_p1_wins", 0, None), between("h2h_p2_wins", 0, None)]
    return rules


def player_map_rules() -> list[Rule]:
    return [not_null("source_id"), between("confidence", 0, 100)]
