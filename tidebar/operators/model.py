"""Return models: boosted trees that take missing values, forward-chaining validation, adaptive tuning, saved with their contract."""

from __future__ import annotations

import json
import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.columns import clean, correlation, divide
from tidebar.operators import boost, screening, tpe
from tidebar.operators import windows as win
from tidebar.operators.tables import written


def target() -> F.Column:
    """close[t] / close[t - 1]."""
    return divide("close", win.lag("close"))


def complete(df: DataFrame) -> DataFrame:
    """Rows without a missing value or NaN in any column."""
    numbers = {c for c, t in df.dtypes if t in ("double", "float")}
    for c in df.columns:
        df = df.where((clean(F.col(f"`{c}`")) if c in numbers else F.col(f"`{c}`")).isNotNull())
    return df


def fit(train: DataFrame, features: list[str], label: str = "target", **params) -> boost.Model:
    """Missing features go to the better side of each cut; rows without a label are left out."""
    return boost.fit(train, features, label, **params)


def predict(model: boost.Model, df: DataFrame, features: list[str]) -> DataFrame:
    missing = set(features) - set(df.columns)
    if missing:
        raise ValueError(f"missing features: {sorted(missing)}")
    return boost.predict(model, df)


def mean_prediction(predicted: DataFrame, pred: str = "pred") -> float | None:
    """Mean of the predictions that are there."""
    return predicted.agg(F.avg(clean(F.col(pred)))).first()[0]


def after_training(df: DataFrame, train_end, ready: DataFrame | None = None) -> DataFrame:
    """Bars after the training's end. Indicators made from the result are warmed up anew on it; those of bars with indicators
    made before (`ready`, by instrument and ts) keep what the bars before the cut gave them."""
    out = df.where(F.col("ts") > F.lit(train_end).cast("timestamp_ntz"))
    if ready is None:
        return out
    extra = [c for c in ready.columns if c not in df.columns]
    return out.join(ready.select("instrument", "ts", *extra), ["instrument", "ts"], "left")


def cv_corr(df: DataFrame, features: list[str], k: int = 5, label: str = "target", **params) -> list[float]:
    """Correlation of predictions with the label in each fold, trained on all folds before it; -1 where it isn't defined."""
    folded = written(screening.timed_folds(df.where(F.col(label).isNotNull()), k), "folds")
    out = []
    for f in range(1, k + 1):
        model = fit(folded.where(F.col("fold") < f), features, label, **params)
        c = predict(model, folded.where(F.col("fold") == f), features).agg(correlation("pred", label)).first()[0]
        out.append(-1.0 if c is None or math.isnan(c) else c)
    return out


def tune(df: DataFrame, features: list[str], trials: int = 30, k: int = 5, seed: int = 0, label: str = "target", space: tpe.Space = tpe.SPACE, **fixed) -> tuple[dict, float]:
    """The parameters of the best mean correlation over the folds among so many trials of an adaptive search, and that mean."""

    def mean(params: dict) -> float:
        scores = cv_corr(df, features, k, label, **(fixed | params))
        return sum(scores) / len(scores)

    params, score, _ = tpe.search(mean, space, trials, seed)
    return fixed | params, score


def latest(spark: SparkSession, folder: str) -> str | None:
    """Path of the model in the folder whose meta has the greatest timestamp (then path); None if there is none."""
    try:
        found = spark.read.text(f"{folder}/*/meta").select(F.get_json_object("value", "$.timestamp").alias("at"), F.input_file_name().alias("path")).orderBy(F.desc_nulls_last("at"), F.desc("path")).first()
    except AnalysisException:  # no such path
        return None
    return found and found.path.rsplit("/meta/", 1)[0]


def predictions(df: DataFrame, folder: str, fill: float | None = None) -> tuple[DataFrame, dict | None]:
    """df with pred by the latest model of the folder, and its meta. Without a model, or where features are missing, pred is fill
    and the meta None; a missing prediction is fill too."""
    path = latest(df.sparkSession, folder)
    model, meta = load(df.sparkSession, path) if path else (None, None)
    if meta is None or set(meta["feature_cols"]) - set(df.columns):
        return df.withColumn("pred", F.lit(fill).cast("double")), None
    out = predict(model, df, meta["feature_cols"])
    return (out if fill is None else out.fillna(fill, subset=["pred"])), meta


def save(model: boost.Model, path: str, meta: dict, sample: DataFrame, features: list[str]) -> None:
    """Writes model and meta as JSON, reads the model back, and compares its predictions on a sample."""
    spark = sample.sparkSession
    for name, text in (("model", model.to_json()), ("meta", json.dumps(meta | {"feature_cols": features}))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    again, _ = load(spark, path)
    if predict(model, sample, features).exceptAll(predict(again, sample, features)).limit(1).count():
        raise RuntimeError("the saved model predicts otherwise")


def load(spark: SparkSession, path: str) -> tuple[boost.Model, dict]:
    model, meta = (spark.read.text(f"{path}/{name}").first()[0] for name in ("model", "meta"))
    return boost.Model.from_json(model), json.loads(meta)


def split(df: DataFrame, holdout: str) -> tuple[DataFrame, DataFrame]:
    """Rows before and from a time on; both must have some."""
    parts = df.where(F.col("ts") < F.lit(holdout).cast("timestamp_ntz")), df.where(F.col("ts") >= F.lit(holdout).cast("timestamp_ntz"))
    if not all(p.limit(1).count() for p in parts):
        raise ValueError("an empty side of the split")
    return parts
