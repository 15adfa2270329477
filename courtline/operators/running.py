"""Running aggregates ("everything before this row, per key") on one plan for every input.

A plain ``Window.partitionBy(key)`` puts every row of a key in one task. ``running`` cuts the
order itself instead, in one straight plan without a job at plan time:

1. the rows are range-partitioned by (key, order): Spark samples the bounds, so partitions are
   even, and a hot key, even one with a single timestamp, lies in as many as it fills;
2. a window inside each (partition, key) gives the aggregate over the rows of that partition;
3. only the last key of a partition can go on in later ones: its last row goes to each of them
   as well, with the partition's total; at most P²/2 rows for P partitions, however large the table;
4. a window over (key, partition) adds up the totals that arrived.

The aggregates are associative, so carried ⊕ within equals the plain window. Every step reads its
predecessor only; nothing is joined to a second reading whose sampled bounds could differ.

A row whose first order column is NULL has no place in time: it counts for no other row and has
no earlier rows itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


@dataclass(frozen=True)
class Agg:
    name: str
    kind: str  # count | sum | max | min | last
    expr: Column


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _quoted(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def _fold(kind: str, v: str) -> str:
    """The aggregate of a kind over values in order."""
    return f"last({v}, true)" if kind == "last" else f"{kind}({v})"


def _combine(kind: str, earlier: str, later: str) -> str:
    """Two adjacent partial results as one; NULL stands for no rows."""
    if kind == "count":
        return f"coalesce({earlier}, 0) + coalesce({later}, 0)"
    if kind == "sum":
        return f"coalesce({earlier} + {later}, {earlier}, {later})"
    if kind == "last":
        return f"coalesce({later}, {earlier})"
    return f"{'greatest' if kind == 'max' else 'least'}({earlier}, {later})"


def _own(kind: str, v: str) -> str:
    """A single row's value as a partial result."""
    return f"cast({v} IS NOT NULL AS bigint)" if kind == "count" else v


def running(df: DataFrame, keys: list[str], order: list[str], aggs: list[Agg], *, include_current: bool = False,
            keep: str | None = None) -> DataFrame:
    """Add one column per ``Agg``: the aggregate over the earlier rows of the same key.

    ``order`` must be a total order inside each key (rows that tie in it may swap their places).
    Rows are "earlier" by that order; ``include_current`` adds the row itself. ``count`` of no
    rows is 0; other aggregates of no rows are NULL. No keys: one timeline of all rows. ``keep`` (a
    condition): only these rows come back; the others count, but go no further than their partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns, timed = df.columns, f"`{order[0]}` IS NOT NULL"
    by, along = "".join(f", `{k}`" for k in keys), _quoted(order)
    v = {a.name: f"if({timed}, `_v_{a.name}`, NULL)" for a in aggs}
    ranged = (df.select("*", *[a.expr.alias(f"_v_{a.name}") for a in aggs])
              .repartitionByRange(*keys, *order).selectExpr("*", "spark_partition_id() AS _part"))
    before = f"OVER (PARTITION BY _part{by} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    within = ranged.selectExpr("*", f"lead(_part) OVER (PARTITION BY _part ORDER BY {_quoted([*keys, *order])}) IS NULL AS _last",
                               *[f"{_fold(a.kind, v[a.name])} {before} AS `_w_{a.name}`" for a in aggs])

    # a row goes to its own partition; the last one also, as a total, to all later ones
    sent = (within.where(f"({keep}) OR _last") if keep else within).selectExpr("*", f"explode(if(_last, sequence(_part, {parts - 1}), array(_part))) AS _at")

    def arrived(a: Agg) -> str:
        total = f"if(_at > _part, {_combine(a.kind, f'`_w_{a.name}`', _own(a.kind, v[a.name]))}, NULL)"
        over = f"OVER (PARTITION BY _at{by})"
        if a.kind == "last":  # of the latest partition that has one
            return f"max(if({total} IS NULL, NULL, struct(_part, {total} AS total))) {over}.total AS `_c_{a.name}`"
        return f"{'sum' if a.kind in ('count', 'sum') else a.kind}({total}) {over} AS `_c_{a.name}`"

    def result(a: Agg) -> str:
        out = f"if({timed}, {_combine(a.kind, f'`_c_{a.name}`', f'`_w_{a.name}`')}, NULL)"
        if include_current or a.kind == "count":
            out = _combine(a.kind, out, _own(a.kind, f"`_v_{a.name}`") if include_current else "0L")
        return f"{out} AS `{a.name}`"

    return (sent.selectExpr("*", *[arrived(a) for a in aggs]).where(f"_at = _part AND ({keep})" if keep else "_at = _part")
            .selectExpr(*[f"`{c}`" for c in columns], *[result(a) for a in aggs]))


def rows_before(df: DataFrame, keys: list[str], order: list[str], value: str | Column, sizes: list[int], *,
                prefix: str = "_rb") -> DataFrame:
    """Per row: position in its key (``<prefix>_pos``), sum and non-null count of ``value`` over all
    earlier rows (``_sum``, ``_cnt``) and over the ``n`` rows before it for each n of ``sizes``
    (``_sum_<n>``, ``_cnt_<n>``).

    A row at position p with running sum S(p) sends S(p) to position p + n of its key; a row that
    gets one has the frame sum S(p) − S(p − n), another has fewer than n rows before it. Each
    (key, position) holds one row and one value per n, so no group is hot, and all sizes share
    one shuffle.
    """
    r = running(df, keys, order, [Agg("_pos", "count", F.lit(1)), Agg("_s", "sum", _col(value)), Agg("_c", "count", _col(value))])
    # rows without a time stand at position -1, told apart by a number
    timed = f"`{order[0]}` IS NOT NULL"
    others = [c for c in df.columns if c not in keys]
    to = ", ".join(f"struct({n} AS n, if({timed}, _pos + {n}, NULL) AS at)" for n in sizes)
    sent = r.selectExpr("*", f"if({timed}, NULL, monotonically_increasing_id()) AS _odd",
                        f"explode(filter(array(struct(0 AS n, if({timed}, _pos, -1L) AS at), {to}), g -> g.at IS NOT NULL)) AS _go")
    each = sent.groupBy(*keys, "_go.at", "_odd").agg(
        F.expr("max(_go.n = 0) AS _here"),
        *[F.expr(f"first(if(_go.n = 0, `{c}`, NULL), true) AS `_r_{c}`") for c in [*others, "_s", "_c"]],
        *[F.expr(f"max(if(_go.n = {n}, {c}, NULL)) AS {c}_{n}") for n in sizes for c in ("_s", "_c")])
    outs = [f"greatest(at, 0L) AS {prefix}_pos", f"coalesce(_r__s, 0) AS {prefix}_sum", f"_r__c AS {prefix}_cnt"]
    for n in sizes:
        outs += [f"coalesce(_r__s, 0) - coalesce(_s_{n}, 0) AS {prefix}_sum_{n}", f"_r__c - coalesce(_c_{n}, 0) AS {prefix}_cnt_{n}"]
    return each.where("_here").selectExpr(*[f"`{c}`" if c in keys else f"`_r_{c}` AS `{c}`" for c in df.columns], *outs)


def counts_in_spans(df: DataFrame, keys: list[str], ts: str, row_id: str, spans: dict[str, int],
                    sums: dict[str, Column] | None = None, *, through_row: bool = False) -> DataFrame:
    """Per row: count (and sums) of the key's rows whose ``ts`` lies in a span before the row.

    Default: ``[t - span, t)`` — strictly earlier timestamps. With ``through_row``:
    ``(t - span, t]`` restricted to rows up to and including this one in (ts, row_id) order
    (the shape of a pandas time-offset rolling window, which excludes later peers). A row
    without a time lies in no span and has none.

    Implemented as probes on one running pass: each row emits a probe at ``t - span`` per
    span (and one at ``t``); a probe sorts before (or, for exclusive lower ends, after) the
    real rows with the same timestamp, so the running count at a probe counts exactly the
    rows on the required side. Window value = upper probe − lower probe. No pairs are formed.
    Returns ``row_id`` plus ``cnt_<span>`` and ``<sum>_<span>``.
    """
    sums = sums or {}
    low_kind = 2 if through_row else 0
    specs = ["struct(1 AS kind, CAST(NULL AS string) AS span, 0L AS us)"] + ([] if through_row else ["struct(0 AS kind, '0' AS span, 0L AS us)"])
    specs += [f"struct({low_kind} AS kind, '{k}' AS span, {int(s) * 1_000_000}L AS us)" for k, s in spans.items()]
    both = (df.select(*keys, F.col(ts).alias("_ts"), F.col(row_id).alias("_id"), *[e.alias(f"_e_{n}") for n, e in sums.items()])
            .selectExpr("*", f"explode(array({', '.join(specs)})) AS _p")
            .selectExpr(*[f"`{k}`" for k in keys], "unix_micros(_ts) - _p.us AS _t", "_id", "_p.kind AS _kind", "_p.span AS _span",
                        "if(_p.kind = 1, 1, NULL) AS _real", *[f"if(_p.kind = 1, `_e_{n}`, NULL) AS `_x_{n}`" for n in sums]))
    run = running(both, keys, ["_t", "_kind", "_id", "_span"],
                  [Agg("_cnt", "count", F.col("_real"))] + [Agg(f"_sx_{n}", "sum", F.col(f"_x_{n}")) for n in sums],
                  keep=None if through_row else "_kind <> 1")
    if through_row:  # the row itself: everything strictly before it in total order, plus itself
        up_cnt = "max(if(_kind = 1, _cnt + if(_t IS NULL, 0, 1), NULL))"
        up_sum = {n: f"max(if(_kind = 1 AND _t IS NOT NULL, coalesce(`_sx_{n}`, 0) + coalesce(`_x_{n}`, 0), NULL))" for n in sums}
    else:
        up_cnt, up_sum = "max(if(_span = '0', _cnt, NULL))", {n: f"max(if(_span = '0', `_sx_{n}`, NULL))" for n in sums}
    outs = []
    for k in spans:
        outs.append(f"{up_cnt} - max(if(_span = '{k}', _cnt, NULL)) AS `cnt_{k}`")
        outs += [f"coalesce({up_sum[n]}, 0) - coalesce(max(if(_span = '{k}', `_sx_{n}`, NULL)), 0) AS `{n}_{k}`" for n in sums]
    return run.groupBy(F.col("_id").alias(row_id)).agg(*[F.expr(o) for o in outs])


def previous(df: DataFrame, keys: list[str], order: list[str], row_id: str, values: list[str]) -> DataFrame:
    """``row_id`` and ``values`` of the key's row just before it in ``order`` (NULL for the first row
    and for rows without a time): each row sends its values to the next position of its key."""
    timed = F.col(order[0]).isNotNull()
    r = running(df.select(*dict.fromkeys([*keys, *order, row_id, *values])), keys, order, [Agg("_pos", "count", F.lit(1))])
    go = F.explode(F.when(timed, F.array(F.col("_pos"), F.col("_pos") + 1)).otherwise(F.array(F.lit(-1).cast("bigint"))))
    sent = r.withColumn("_at", go).withColumns({"_here": ~timed | (F.col("_at") == F.col("_pos")),
                                                "_odd": F.when(~timed, F.col(row_id))})
    each = sent.groupBy(*keys, "_at", "_odd").agg(
        F.max(F.when(F.col("_here"), F.struct(F.col(row_id).alias("id")))).alias("_row"),
        *[F.max(F.when(~F.col("_here"), F.col(v))).alias(v) for v in values])
    return each.where(F.col("_row").isNotNull()).select(F.col("_row.id").alias(row_id), *values)
