import os
import tempfile

import pytest

from pyspark.sql import functions as F

from courtline.operators import models
from courtline.sources import files


def _write(d, name, text, encoding="utf-8"):
    p = os.path.join(d, name)
    with open(p, "w", encoding=encoding) as fh:
        fh.write(text)
    return p


def test_scan_players_keeps_first_and_drops_bad_ids(spark):
    d = tempfile.mkdtemp()
    a = _write(d, "atp.csv", "player_id,name_first,name_last,hand,dob,ioc\n1,Rafael,Nadal,L,19860603,ESP\n2,Novak,Djokovic,R,19870522,SRB\n",
               "latin-1")
    b = _write(d, "wta.csv", "1,Other,Person,R,1990,XXX\nx,Bad,Id,R,1990,XXX\n3,Iga,Swiatek,R,20010531,POL\n", "latin-1")
    got = {r.player_id: r.last_name for r in files.scan_players(spark, [a, b]).collect()}
    assert got == {1: "Nadal", 2: "Djokovic", 3: "Swiatek"}


def test_scan_rankings_ragged(spark):
    d = tempfile.mkdtemp()
    a = _write(d, "r1.csv", "ranking_date,rank,player,points\n20230102,1,101,9000\n20230102,2,102,8000\n")
    b = _write(d, "r2.csv", "20230109,1,102,8500,12\nbad,x,103,1\n")
    rows = files.scan_rankings(spark, [a, b]).orderBy("ranking_date", "rank").collect()
    assert [(r.rank, r.player, r.tours) for r in rows] == [(1, 101, None), (2, 102, None), (1, 102, "12")]


def test_scan_odds_dayfirst(spark):
    d = tempfile.mkdtemp()
    _write(d, "a_ProTennis.csv", "market_id,selection_id,selection_name,competition_name,event_date,pp_wap,result\n"
                                 "1.100,5,A B,Open,03/01/2023 10:00,2.5,WINNER\n1.100,6,C D,Open,bad,1.5,LOSER\n")
    rows = files.scan_odds(spark, os.path.join(d, "*_ProTennis.csv")).collect()
    assert len(rows) == 1 and rows[0].market_id == "1.100" and rows[0].tourney_date.day == 3


def test_scan_history_skips_incomplete_files(spark):
    d = tempfile.mkdtemp()
    _write(d, "atp_matches_2023.csv", "tourney_name,tourney_date,winner_id,winner_name,loser_id,loser_name,score,x\n"
                                      "Wimbledon,20230703,1,A,2,B,6-4 6-4,0\n")
    _write(d, "atp_matches_bad.csv", "tourney_name,winner_id\nX,1\n")
    h = files.scan_match_history(spark, os.path.join(d, "atp_matches_*.csv"))
    assert h.count() == 1
    assert sorted(r.historical_id for r in files.historical_players(h).collect()) == [1, 2]


def test_scan_history_of_files_with_other_column_orders(spark):
    d = tempfile.mkdtemp()
    _write(d, "h_1.csv", "tourney_name,tourney_date,winner_id,winner_name,loser_id,loser_name,score\nAlpha,20230703,1,A,2,B,6-4 6-4\n")
    _write(d, "h_2.csv", "score,tourney_name,loser_name,winner_name,loser_id,winner_id,tourney_date\n6-2 6-2,Beta,D,C,4,3,20230704\n")
    got = {(r.tourney_name, r.winner_id, r.winner_name, r.loser_id, r.score, r.tourney_date.day)
           for r in files.scan_match_history(spark, os.path.join(d, "h_*.csv")).collect()}
    assert got == {("Alpha", 1, "A", 2, "6-4 6-4", 3), ("Beta", 3, "C", 4, "6-2 6-2", 4)}


def test_missing_input(spark):
    with pytest.raises(FileNotFoundError):
        files.assert_input(spark, "/nonexistent/*.csv")
    with pytest.raises(FileNotFoundError):
        files.scan_csv_glob(spark, "/nonexistent/*.csv", files.ODDS_RAW)


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp()
    empty = spark.createDataFrame([], "a long, b string")
    files.sink_table(empty, os.path.join(d, "t"))
    assert spark.read.parquet(os.path.join(d, "t")).columns == ["a", "b"]
    files.sink_metrics_json(spark, {"auc": 0.9}, os.path.join(d, "m"))
    assert "0.9" in spark.read.text(os.path.join(d, "m")).collect()[0].value


def test_rankings_of_other_widths_are_skipped(spark):
    d = tempfile.mkdtemp()
    _write(d, "a.csv", "20230102,1,101,9000\n")
    _write(d, "b.csv", "20230109,1,102,8500,12\n")
    _write(d, "c.csv", "20230109,1,103\n")
    _write(d, "d.csv", "20230109,1,104,1,2,3\n")
    _write(d, "e.csv", "")
    assert sorted(r.player for r in files.scan_rankings(spark, [os.path.join(d, "*.csv")]).collect()) == [101, 102]
    with pytest.raises(FileNotFoundError):
        files.scan_rankings(spark, [os.path.join(d, "[cd].csv")])


def test_players_keep_the_first_row_by_its_place(spark):
    p = spark.createDataFrame([("1", "Zoe", 0), ("1", "Ann", 1), ("x", "Bad", 2)], "player_id string, first_name string, line int")
    assert [tuple(r) for r in files.load_players_dim(p, ["line"]).collect()] == [(1, "Zoe")]


def test_write_valid_checks_in_the_writing_pass(spark):
    d, model = tempfile.mkdtemp(), models.MODELS["rankings"]
    path, report = os.path.join(d, "t"), os.path.join(d, "f")
    schema = "ranking_date string, rank string, player double"
    good = models.write_valid(spark.createDataFrame([("2023-01-02", "1", 101.0)], schema), model, path)
    assert [f.dataType.simpleString() for f in good.schema] == ["timestamp", "bigint", "bigint"] and good.collect()[0].player == 101
    bad = spark.createDataFrame([("2023-01-02", "one", 101.0), (None, None, 102.0), ("2023-01-03", "2", None), ("soon", "3", 4.0)], schema)
    with pytest.raises(models.ValidationError) as e:
        models.write_valid(bad, model, path, failure_path=report)
    assert sorted(e.value.failures) == [("player", "not_nullable", 1), ("rank", "coerce_dtype('bigint')", 1), ("rank", "not_nullable", 1),
                                        ("ranking_date", "coerce_dtype('timestamp')", 1), ("ranking_date", "not_nullable", 1)]
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(report).count() == 5
    assert models.write_valid(bad.limit(0), model, path).count() == 0


def test_columns_that_are_not_the_models(spark):
    model = models.MODELS["player_map"]
    with pytest.raises(ValueError, match="missing column source_id"):
        models.rules(spark.range(1).withColumnRenamed("id", "x"), model)
    with pytest.raises(ValueError, match="unexpected column x"):
        models.rules(spark.createDataFrame([(1, 2.0, "a", "b", "Exact", 100.0, 1)], "source_id long, historical_id double, source_name string, "
                                           "matched_name string, method string, confidence double, x long"), model)


def test_match_features_keep_their_model(spark):
    from courtline.plans.registry_extra import q_match_features_full
    f = q_match_features_full(spark, "/root/testdata/sf0.001").withColumn("tourney_date", F.current_timestamp())
    f = f.withColumn("tourney_name", F.lit(None).cast("string"))
    missing = {x.name for x in models.MODELS["features"].fields if x.required} - set(f.columns)
    assert missing <= {"book_margin", "surface"}
    f = f.withColumns({c: F.lit(0.0) if c == "book_margin" else F.lit("Hard") for c in missing})
    assert models.failures(f, models.MODELS["features"], ["match_id"]).count() == 0
    broken = f.withColumns({"p1_win_perc": F.lit(float("nan")), "p2_form": F.lit(1.5), "winner": F.lit(2), "h2h_p1_wins": F.lit(-1)})
    got = {r.column for r in models.failures(broken, models.MODELS["features"], ["match_id"]).select("column").distinct().collect()}
    assert got == {"p1_win_perc", "p2_form", "winner", "h2h_p1_wins"}
