"""Model stage on ``pyspark.ml``: feature selection, one-hot hands, chronological split,
boosted-tree search on a validation slice, refit, evaluation, importance, scoring, persistence.

Training data stays distributed; only parameters, metrics (a handful of numbers) and the
feature-importance vector (one value per feature) reach the driver.
"""

from __future__ import annotations

import re
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .running import Agg, running

HAND_LEVELS = ["L", "R", "U"]  # first level is the dropped reference level

# inputs besides the features of each side: side columns of the joins, and columns of the match
SIDE_INPUTS = ("odds", "implied_prob", "rank", "elo", *(f"hand_{level}" for level in HAND_LEVELS[1:]))
MATCH_INPUTS = ("h2h_p1_wins", "h2h_p2_wins", "book_margin")
DIFFERENCE = re.compile(r"_diff(_|$)")


def one_hot_hand(df: DataFrame, cols=("p1_hand", "p2_hand"), levels=HAND_LEVELS) -> DataFrame:
    """0/1 indicator per level except the first (alphabetical) one; NULL → all zeros."""
    out = df
    for c in cols:
        if c not in df.columns:
            continue
        for lv in levels[1:]:
            out = out.withColumn(f"{c}_{lv}", F.coalesce((F.col(c) == lv).cast("int"), F.lit(0)))
        out = out.drop(c)
    return out


def select_feature_cols(df: DataFrame) -> list[str]:
    """The model inputs among the columns: what the feature plan and its joins make for each side
    or for the match, and differences of the two sides. Ids and outcomes are never among them."""
    from ..plans.features import PLAYER_FEATURES
    made = {f"{side}_{name}" for side in ("p1", "p2") for name in (*PLAYER_FEATURES, *SIDE_INPUTS)} | set(MATCH_INPUTS)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and (f.name in made or DIFFERENCE.search(f.name))]


def temporal_split(df: DataFrame, *, ts: str = "tourney_date", row_id: str = "match_id", test_size: float = 0.2,
                   validation_size: float = 0.25) -> DataFrame:
    """Chronological split: the first ⌊n(1 − test)⌋ rows in (ts, id) order train, the rest
    test; the last ``validation_size`` of the training part is the validation slice.

    Positions come from a running count over ranges of the order, not from a global
    single-partition window. A row without a time stands at position 0.
    """
    n = df.count()
    cut_test = int(n * (1 - test_size))
    cut_val = int(cut_test * (1 - validation_size))
    pos = running(df, [], [ts, row_id], [Agg("_pos", "count", F.lit(1))])
    split = F.when(F.col("_pos") >= cut_test, "test").when(F.col("_pos") >= cut_val, "validation").otherwise("train")
    return pos.withColumn("split", split).drop("_pos")


def sample_params(n_trials: int, seed: int = 42) -> list[dict]:
    """Random search space of the boosted-tree search (depth, step, iterations, subsampling)."""
    rnd = random.Random(seed)
    return [{"maxDepth": rnd.randint(3, 6), "stepSize": round(10 ** rnd.uniform(-1.5, -0.5), 4),
             "maxIter": rnd.choice([10, 20, 30]), "subsamplingRate": round(rnd.uniform(0.6, 1.0), 2),
             "minInstancesPerNode": rnd.choice([1, 5, 10])} for _ in range(n_trials)]


def _pipeline(features: list[str], label: str, p: dict, validation_col: str | None = None) -> Pipeline:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=42, **p)
    if validation_col:
        gbt = gbt.setValidationIndicatorCol(validation_col)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt])


def hpo_search(data: DataFrame, features: list[str], label: str = "winner", n_trials: int = 4,
               seed: int = 42) -> tuple[dict, float]:
    """Best parameters by validation AUC. Each trial fits on the training slice with the
    validation slice as early-stopping indicator (``validationIndicatorCol``)."""
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    fit_df = data.where(F.col("split") != "test").withColumn("_is_val", F.col("split") == "validation")
    val = data.where(F.col("split") == "validation")
    best, best_auc = None, -1.0
    for p in sample_params(n_trials, seed):
        model = _pipeline(features, label, p, "_is_val").fit(fit_df)
        auc = ev.evaluate(model.transform(val)) if val.limit(1).count() else 0.0
        if auc > best_auc:
            best, best_auc = p, auc
    return best, best_auc


def fit_final(data: DataFrame, features: list[str], params: dict, label: str = "winner") -> PipelineModel:
    """Refit on train + validation with the chosen parameters."""
    return _pipeline(features, label, params).fit(data.where(F.col("split") != "test"))


def score_batch(model: PipelineModel, df: DataFrame, out: str = "p1_predicted_prob") -> DataFrame:
    """P(p1 wins) as a column; p2 = 1 − p1 is derived where needed."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability",
                                                                          "prediction")


def eval_metrics(model: PipelineModel, test: DataFrame, label: str = "winner") -> DataFrame:
    """Accuracy, ROC-AUC and per-class precision / recall / F1 / support, as one small table."""
    scored = model.transform(test)
    auc = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC").evaluate(scored) \
        if test.limit(1).count() else None
    cm = scored.groupBy(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("pred")).count()
    per = cm.groupBy().agg(
        *[F.sum(F.when((F.col("label") == c) & (F.col("pred") == c), F.col("count")).otherwise(0)).alias(f"tp{c}") for c in (0, 1)],
        *[F.sum(F.when(F.col("pred") == c, F.col("count")).otherwise(0)).alias(f"pp{c}") for c in (0, 1)],
        *[F.sum(F.when(F.col("label") == c, F.col("count")).otherwise(0)).alias(f"sup{c}") for c in (0, 1)],
        F.sum("count").alias("n"))
    cols = [((F.col("tp0") + F.col("tp1")) / F.col("n")).alias("accuracy"), F.lit(auc).cast("double").alias("roc_auc")]
    for c in (0, 1):
        prec = F.try_divide(F.col(f"tp{c}").cast("double"), F.col(f"pp{c}"))
        rec = F.try_divide(F.col(f"tp{c}").cast("double"), F.col(f"sup{c}"))
        cols += [prec.alias(f"precision_{c}"), rec.alias(f"recall_{c}"),
                 F.try_divide(2 * prec * rec, prec + rec).alias(f"f1_{c}"), F.col(f"sup{c}").alias(f"support_{c}")]
    return per.select(*cols)


def feature_importance(model: PipelineModel, features: list[str], top: int = 20) -> list[tuple[str, float]]:
    imp = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, [float(x) for x in imp]), key=lambda t: -t[1])[:top]


def stratified_folds(df: DataFrame, label: str = "winner", k: int = 5, seed: int = 42, key: str = "match_id") -> DataFrame:
    """Fold id per row, balanced within each label: rows of a label in hash order are dealt
    round-robin over the folds (position from a running count per label)."""
    h = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    pos = running(h, [label], ["_h", key], [Agg("_pos", "count", F.lit(1))])
    return pos.withColumn("fold", F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_h", "_pos")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_eval(features_df: DataFrame, label: str = "winner", n_trials: int = 2) -> tuple[PipelineModel, DataFrame, dict]:
    """Sampling-free end-to-end: hands one-hot, chronological split, search, refit, metrics."""
    from ..session import cut_lineage
    # every trial scans the training table again: materialise it once (reliable checkpoint)
    data = cut_lineage(temporal_split(one_hot_hand(features_df)))
    feats = select_feature_cols(data)
    best, auc = hpo_search(data, feats, label, n_trials)
    model = fit_final(data, feats, best, label)
    metrics = eval_metrics(model, data.where(F.col("split") == "test"), label)
    return model, metrics, {"best_params": best, "validation_auc": auc, "features": feats}


def stratified_cv(data: DataFrame, features: list[str], params: dict, label: str = "winner", k: int = 5) -> dict:
    """k-fold AUC with label-balanced folds (``stratified_folds``): mean and standard
    deviation over the folds; every fit is distributed, only k numbers reach the driver."""
    import statistics
    ev = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    folded = stratified_folds(data, label, k)
    scores = []
    for f in range(k):
        model = _pipeline(features, label, params).fit(folded.where(F.col("fold") != f))
        scores.append(ev.evaluate(model.transform(folded.where(F.col("fold") == f))))
    return {"scores": scores, "mean": statistics.fmean(scores), "std": statistics.pstdev(scores)}
