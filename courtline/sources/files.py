"""File sources and sinks of the pipeline (CSV inputs, Parquet/CSV/JSON outputs).

CSV is always read with a declared schema (never inferred); bad values become NULL through
``try_*`` casts rather than failing the job (ANSI mode is on).
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure

PLAYERS_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                               ("player_id", "first_name", "last_name", "hand", "dob", "country_ioc")])
RANKINGS_RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("ranking_date", "rank", "player", "points", "tours")])
ODDS_RAW = T.StructType([T.StructField(n, T.StringType()) for n in
                         ("market_id", "selection_id", "selection_name", "competition_name", "event_date", "pp_wap", "result")])
HISTORY_COLS = ["tourney_name", "tourney_date", "winner_id", "winner_name", "loser_id", "loser_name", "score"]


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """The files that match, as Spark resolves them on any file system (only names are read)."""
    try:
        found = spark.read.format("binaryFile").load(pattern).select("path").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if not found:
        raise FileNotFoundError(f"no files match {pattern}")
    return sorted(r.path for r in found)


def scan_csv_glob(spark: SparkSession, pattern: str, schema: T.StructType, *, header: bool = True,
                  add_source: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """All CSV files matching ``pattern`` as one DataFrame (declared schema; optional
    ``source_file`` column from the file metadata). Raises when nothing matches."""
    configure(spark)
    df = (spark.read.schema(schema).option("header", header).option("encoding", encoding)
          .option("mode", "PERMISSIVE").csv(_paths(spark, pattern)))
    if add_source:
        df = df.withColumn("source_file", F.col("_metadata.file_name"))
    return df


def scan_players(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Headerless latin-1 player files (first six columns), ids coerced (bad ids and header
    lines drop out), first row per id kept in file order then line order."""
    configure(spark)
    frames = []
    for i, p in enumerate(paths):
        df = (spark.read.schema(PLAYERS_SCHEMA).option("header", False).option("encoding", "ISO-8859-1")
              .option("mode", "PERMISSIVE").csv(p))
        frames.append(df.withColumn("_file", F.lit(i)).withColumn("_line", F.monotonically_increasing_id()))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    df = df.withColumn("player_id", F.col("player_id").try_cast("bigint")).where(F.col("player_id").isNotNull())
    first = df.groupBy("player_id").agg(F.min_by(F.struct(*[c for c in PLAYERS_SCHEMA.fieldNames() if c != "player_id"]),
                                                 F.struct("_file", "_line")).alias("_r"))
    return first.select("player_id", "_r.*")


def _first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Path → first line of each file, by one job over the files' first blocks (one line a file
    comes to the driver, as its name does)."""
    head = (spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_n"))
            .where(F.col("file_block_start") == 0).groupBy("file_path").agg(F.min_by("value", "_n").alias("line")))
    return {r.file_path: r.line for r in head.collect()}


def scan_rankings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Ranking files with 4 or 5 columns (short rows get NULL ``tours``), embedded header
    rows removed, dates ``yyyyMMdd`` → UTC timestamp, lenient numeric casts, NULL keys dropped.
    Files of another width, told by their first line, and empty files are skipped; raises when none is left."""
    configure(spark)
    kept = sorted(path for path, line in _first_lines(spark, paths).items() if line.count(",") in (3, 4))
    if not kept:
        raise FileNotFoundError(f"no ranking file of 4 or 5 columns among {paths}")
    df = (spark.read.schema(RANKINGS_RAW).option("header", False).option("mode", "PERMISSIVE").csv(kept)
          .where(F.col("ranking_date") != "ranking_date"))
    return (df.select(F.try_to_timestamp("ranking_date", F.lit("yyyyMMdd")).alias("ranking_date"),
                      F.col("rank").try_cast("bigint").alias("rank"), F.col("player").try_cast("bigint").alias("player"),
                      "points", "tours")
            .dropna(subset=["ranking_date", "rank", "player"]))


DAYFIRST_FORMATS = ["dd/MM/yyyy HH:mm", "dd/MM/yyyy H:mm", "dd/MM/yyyy", "d/M/yyyy HH:mm", "d/M/yyyy"]


def parse_dayfirst(col) -> F.Column:
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DAYFIRST_FORMATS])


def parse_yyyymmdd(col) -> F.Column:
    return F.try_to_timestamp(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("yyyyMMdd"))


def scan_odds(spark: SparkSession, pattern: str) -> DataFrame:
    """Exchange price summaries: ids kept as text, day-first event dates parsed to UTC
    ``tourney_date``; rows without date, market or selection dropped."""
    df = scan_csv_glob(spark, pattern, ODDS_RAW)
    return (df.withColumn("tourney_date", parse_dayfirst("event_date"))
            .withColumn("pp_wap", F.col("pp_wap").try_cast("double"))
            .dropna(subset=["tourney_date", "market_id", "selection_id"]))


def scan_match_history(spark: SparkSession, pattern: str) -> DataFrame:
    """History files with a header; only the needed columns. Files lacking a needed column are
    skipped. Files of one header are read together, as columns of a CSV are found by position."""
    configure(spark)
    groups: dict[str, list[str]] = {}
    for path, line in sorted(_first_lines(spark, _paths(spark, pattern)).items()):
        names = [n.strip().strip('"') for n in line.lstrip("\ufeff").split(",")]
        if set(HISTORY_COLS) <= set(names):
            groups.setdefault(",".join(names), []).append(path)
    if not groups:
        raise FileNotFoundError(f"no history file under {pattern} has the columns {HISTORY_COLS}")
    frames = []
    for header, paths in groups.items():
        schema = T.StructType([T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(header.split(","))])
        frames.append(spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(paths).select(*HISTORY_COLS))
    df = reduce(DataFrame.unionByName, frames)
    return df.select(F.col("tourney_name"), parse_yyyymmdd(F.col("tourney_date")).alias("tourney_date"),
                     F.col("winner_id").try_cast("bigint").alias("winner_id"), "winner_name",
                     F.col("loser_id").try_cast("bigint").alias("loser_id"), "loser_name", "score")


def historical_players(history: DataFrame) -> DataFrame:
    """Distinct non-null (id, name) of winners and losers (one pass, ``stack``)."""
    return (history.select(F.expr("stack(2, winner_id, winner_name, loser_id, loser_name) AS (historical_id, historical_name)"))
            .dropna().distinct())


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a step-boundary table. An empty DataFrame still writes its schema."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def sink_metrics_json(spark: SparkSession, metrics: dict, path: str) -> None:
    """One-row JSON document of metrics and parameters."""
    import json
    spark.createDataFrame([(json.dumps(metrics, default=str),)], "doc string").coalesce(1) \
        .write.mode("overwrite").text(path)


def assert_input(spark: SparkSession, path: str) -> None:
    """Raises FileNotFoundError unless Spark finds ``path``."""
    _paths(spark, path)


def load_match_log(df: DataFrame) -> DataFrame:
    """Typed match log: date as UTC timestamp, ids coerced; rows missing any of them dropped.
    ``operators.models.write_valid`` with the model ``match_log`` checks and stores it."""
    return (df.withColumn("tourney_date", F.col("tourney_date").cast("string").try_cast("timestamp"))
            .withColumn("winner_historical_id", F.col("winner_historical_id").cast("string").try_cast("bigint"))
            .withColumn("loser_historical_id", F.col("loser_historical_id").cast("string").try_cast("bigint"))
            .dropna(subset=["match_id", "tourney_date", "winner_historical_id", "loser_historical_id"]))


def load_players_dim(players: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Player dimension: bad ids dropped, the first row per id kept, by ``order`` (columns that say
    where a row stood, not returned); without it, the smallest row."""
    p = players.withColumn("player_id", F.col("player_id").cast("string").try_cast("bigint")).where(F.col("player_id").isNotNull())
    order = order or []
    cols = [c for c in p.columns if c != "player_id" and c not in order]
    return (p.groupBy("player_id").agg(F.min_by(F.struct(*cols), F.struct(*order, *cols)).alias("_r")).select("player_id", "_r.*"))


def load_rankings(rankings: DataFrame) -> DataFrame:
    """Rankings with a parsed UTC date (no global sort: the as-of join orders per key)."""
    return rankings.withColumn("ranking_date", F.coalesce(F.col("ranking_date").cast("string").try_cast("timestamp"),
                                                          parse_yyyymmdd("ranking_date")))
