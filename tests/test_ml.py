import datetime as dt
import random

from pyspark.sql import functions as F

from courtline.operators import ml


def test_rank_sign_toy_model(spark):
    """40 matches, winner = (rank_diff < 0): the refit model separates them."""
    rnd = random.Random(1)
    rows = []
    for i in range(40):
        r1, r2 = rnd.randint(1, 200), rnd.randint(1, 200)
        if r1 == r2:
            r2 += 1
        rows.append((i, dt.datetime(2023, 1, 1) + dt.timedelta(days=i), r1, r2, r1 - r2, rnd.choice(["R", "L"]),
                     rnd.choice(["R", "L", None]), int(r1 - r2 < 0)))
    df = spark.createDataFrame(rows, "match_id long, tourney_date timestamp, p1_rank long, p2_rank long, rank_diff long, "
                                     "p1_hand string, p2_hand string, winner int")
    data = ml.temporal_split(ml.one_hot_hand(df))
    feats = ml.select_feature_cols(data)
    assert {"p1_rank", "p2_rank", "rank_diff", "p1_hand_R", "p2_hand_R"} <= set(feats)
    splits = {r.split: r["count"] for r in data.groupBy("split").count().collect()}
    assert splits == {"train": 24, "validation": 8, "test": 8}
    model = ml.fit_final(data, feats, {"maxDepth": 2, "maxIter": 10})
    scored = ml.score_batch(model, data)
    acc = scored.select(F.avg(((F.col("p1_predicted_prob") > 0.5).cast("int") == F.col("winner")).cast("double"))).first()[0]
    assert acc > 0.9


def test_model_save_load_and_metrics(spark, tmp_path):
    rows = [(i, dt.datetime(2023, 1, 1) + dt.timedelta(days=i), float(i % 7), float((i * 3) % 5), int(i % 7 > 3))
            for i in range(60)]
    df = spark.createDataFrame(rows, "match_id long, tourney_date timestamp, a double, b double, winner int")
    data = ml.temporal_split(df)
    model = ml.fit_final(data, ["a", "b"], {"maxDepth": 2, "maxIter": 5})
    path = str(tmp_path / "model")
    ml.save_model(model, path)
    again = ml.load_model(path)
    p1 = [r.p1_predicted_prob for r in ml.score_batch(model, df).orderBy("match_id").collect()]
    p2 = [r.p1_predicted_prob for r in ml.score_batch(again, df).orderBy("match_id").collect()]
    assert p1 == p2
    m = ml.eval_metrics(model, data.where(F.col("split") == "test")).collect()[0]
    assert 0.0 <= m.accuracy <= 1.0 and m.support_0 + m.support_1 == 12
    imp = ml.feature_importance(model, ["a", "b"])
    assert {n for n, _ in imp} == {"a", "b"}
    folds_ = ml.stratified_folds(df).groupBy("winner", "fold").count().collect()
    per_label = {}
    for r in folds_:
        per_label.setdefault(r.winner, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per_label.values())
