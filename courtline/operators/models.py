"""Table models: columns, types, ranges and domains of the pipeline's tables, checked while a table is written.

A value is first converted to its column's type (a value that cannot be is a failure); then come
nullability, ranges and domains. All failures of all rows are counted, by an ``Observation`` in the
pass that writes the table, so a valid table costs no second look.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params
from . import dq


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str
    nullable: bool = False
    required: bool = True
    low: float | None = None
    high: float | None = None
    values: tuple | None = None


@dataclass(frozen=True)
class TableModel:
    """``strict``: other columns are an error."""
    name: str
    fields: tuple[Field, ...]
    strict: bool = True


class ValidationError(ValueError):
    """``failures``: (column, check, number of rows) of every failed check."""

    def __init__(self, name: str, failures: list[tuple[str, str, int]]):
        self.failures = failures
        super().__init__(f"{name}: " + "; ".join(f"{c}/{k}: {n}" for c, k, n in failures))


def _all(names: Iterable[str], dtype: str, **more) -> tuple[Field, ...]:
    return tuple(Field(n, dtype, **more) for n in names)


def _sides(*names: str) -> list[str]:
    return [f"p{i}_{n}" for n in names for i in (1, 2)]


SURFACE = Field("surface", "string", values=tuple(params.SURFACES))
LOADS = [f"{what}_last_{days}_days" for what in ("matches", "sets_played") for days in (7, 14)]
MODELS = {m.name: m for m in (
    TableModel("match_log", (
        Field("match_id", "string"), Field("tourney_date", "timestamp"), Field("tourney_name", "string", nullable=True),
        *_all(("winner_id", "loser_id"), "bigint"), *_all(("winner_historical_id", "loser_historical_id"), "double", nullable=True),
        *_all(("winner_name", "loser_name"), "string", nullable=True), SURFACE,
        Field("score", "string", nullable=True, required=False), Field("sets_played", "int", nullable=True, required=False))),
    TableModel("features", (
        Field("match_id", "string"), Field("tourney_date", "timestamp"), Field("tourney_name", "string", nullable=True), SURFACE,
        *_all(_sides("id"), "bigint"), *_all([*_sides("rank"), "rank_diff", "book_margin"], "double"),
        *_all([*_sides("elo"), "elo_diff"], "double", nullable=True),
        *_all(_sides("win_perc", "surface_win_perc", "form", "implied_prob"), "double", low=0, high=1),
        *_all([*_sides(*LOADS), "h2h_p1_wins", "h2h_p2_wins"], "bigint", low=0),
        *_all([f"fatigue_{s}diff_{d}_days" for s in ("", "sets_") for d in (7, 14)], "bigint"),
        Field("winner", "int", values=(0, 1)),
        *_all(_sides("hand_R", "hand_U"), "int", required=False, values=(0, 1))), strict=False),
    TableModel("rankings", (
        Field("ranking_date", "timestamp"), *_all(("rank", "player"), "bigint"),
        *_all(("points", "tours"), "string", nullable=True, required=False))),
    TableModel("players", (
        Field("player_id", "bigint"), *_all(("first_name", "last_name", "hand", "dob", "country_ioc"), "string", nullable=True))),
    TableModel("player_map", (
        Field("source_id", "bigint"), Field("historical_id", "double", nullable=True),
        *_all(("source_name", "matched_name", "method"), "string"), Field("confidence", "double", low=0, high=100))),
)}


def _value(df: DataFrame, f: Field):
    """The column in its model's type; NULL where it cannot be."""
    c = F.col(f"`{f.name}`")
    numeric = isinstance(df.schema[f.name].dataType, T.NumericType)
    return c.try_cast(f.dtype) if numeric or df.schema[f.name].dataType.simpleString() == f.dtype else c.cast("string").try_cast(f.dtype)


def _present(df: DataFrame, model: TableModel) -> list[Field]:
    have = set(df.columns)
    problems = [f"missing column {f.name}" for f in model.fields if f.required and f.name not in have]
    if model.strict:
        problems += [f"unexpected column {c}" for c in df.columns if c not in {f.name for f in model.fields}]
    if problems:
        raise ValueError(f"{model.name}: {', '.join(problems)}")
    return [f for f in model.fields if f.name in have]


def rules(df: DataFrame, model: TableModel) -> list[dq.Rule]:
    """The model's checks as rules on ``df``; raises when its columns are not the model's."""
    out = []
    for f in _present(df, model):
        raw, v = F.col(f"`{f.name}`"), _value(df, f)
        out.append(dq.Rule(f.name, f"coerce_dtype('{f.dtype}')", raw.isNull() | v.isNotNull()))
        if not f.nullable:
            out.append(dq.Rule(f.name, "not_nullable", raw.isNotNull()))
        if f.low is not None:
            out.append(dq.Rule(f.name, f"greater_than_or_equal_to({f.low})", v.isNull() | ((v >= f.low) & ~F.isnan(v.cast("double")))))
        if f.high is not None:
            out.append(dq.Rule(f.name, f"less_than_or_equal_to({f.high})", v.isNull() | (v <= f.high)))
        if f.values is not None:
            out.append(dq.Rule(f.name, f"isin({list(f.values)})", v.isNull() | v.isin(*f.values)))
    return out


def coerced(df: DataFrame, model: TableModel) -> DataFrame:
    """The model's columns in its types; a model that is not strict lets others through."""
    known = {f.name: _value(df, f).alias(f.name) for f in _present(df, model)}
    return df.select(*[known.get(c, F.col(f"`{c}`")) for c in df.columns])


def failures(df: DataFrame, model: TableModel, keys: list[str]) -> DataFrame:
    """One row per failing row and check: keys, column, check, failure_case."""
    return dq.failures(df, rules(df, model), keys)


def write_valid(df: DataFrame, model: TableModel, path: str, *, failure_path: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Write ``df`` in the model's types and return the written table.

    The checks are counted in the writing pass. If any fails, the failing rows (``keys``, default:
    all columns of the model) are written to ``failure_path``, the table is replaced by an empty one,
    so that nobody reads it as valid, and ``ValidationError`` says what failed. An empty table is valid."""
    spark, checks, seen = df.sparkSession, rules(df, model), Observation()
    out = coerced(df.observe(seen, *[F.count_if(~F.coalesce(r.ok, F.lit(False))).alias(f"r{i}") for i, r in enumerate(checks)]), model)
    out.write.mode("overwrite").parquet(path)
    counts = seen.get
    failed = [(r.column, r.check, counts[f"r{i}"]) for i, r in enumerate(checks) if counts[f"r{i}"]]
    if failed:
        if failure_path:
            dq.failures(df, checks, keys or [f.name for f in _present(df, model)]).write.mode("overwrite").parquet(failure_path)
        spark.createDataFrame([], out.schema).write.mode("overwrite").parquet(path)
        raise ValidationError(model.name, failed)
    return spark.read.parquet(path)
