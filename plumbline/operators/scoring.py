"""Scoring: a logistic stand-in for the classifiers whose scores the engine evaluates, and predictions from scores.

Networks need a deep-learning runtime; any model can take this one's place by filling scored(model_name, case_id, y_true,
y_prob). Training weighs classes alike and runs on the cluster.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.images import pixels, preprocess
from plumbline.functions.scalar import chosen_label, confidence_band
from plumbline.operators import fitting, predlog
from plumbline.operators.profile import class_weights
from plumbline.sources.images import small_copies

#: Images that a worker predicts at once.
IMAGES = 64


def train(samples: DataFrame, features: str = "features", label: str = "label", rounds: int = 50, l2: float = 0.01, class_weight: str | dict | None = "balanced") -> tuple[PipelineModel, list[float]]:
    """A fitted pipeline and its loss by round, from samples(features array<double>, label int); classes weigh as class_weight
    says, those that a map lacks once."""
    weights = class_weights(samples, label, class_weight)
    weighed = samples.withColumn("weight", F.lit(1.0)) if weights is None else samples.join(F.broadcast(weights.select(F.col("class_name").alias(label), F.coalesce("weight", F.lit(1.0)).alias("weight"))), label)  # one row a class
    rows = weighed.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"), "weight")
    fit = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol="y", weightCol="weight", maxIter=rounds, regParam=l2)]).fit(rows)
    return fit, [float(v) for v in fit.stages[-1].summary.objectiveHistory]


def scored(model: PipelineModel, samples: DataFrame, model_name: str, key: str = "idx", features: str = "features", label: str = "label") -> DataFrame:
    rows = samples.select(F.col(key).alias("case_id"), F.col(label).cast("int").alias("y_true"), array_to_vector(F.col(features).cast("array<double>")).alias("x"))
    return model.transform(rows).select(F.lit(model_name).alias("model_name"), "case_id", "y_true", F.element_at(vector_to_array("probability"), 2).alias("y_prob"))


def scored_with(model: PipelineModel | fitting.Softmax, samples: DataFrame, model_name: str, key: str = "idx", features: str = "features", label: str = "label") -> DataFrame:
    """scored by a model of either kind that can be trained here."""
    return (fitting.scored if isinstance(model, fitting.Softmax) else scored)(model, samples, model_name, key, features, label)


def scored_by(load: Callable[[], Callable[[np.ndarray], np.ndarray]], samples: DataFrame, model_name: str, key: str = "idx", features: str = "features", label: str = "label") -> DataFrame:
    """The same by any Python model: load() runs once in each worker and gives a function from [n, k] to n probabilities."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"model_name": model_name, "case_id": pdf["case_id"], "y_true": pdf["y_true"], "y_prob": predict(np.stack(pdf["x"].to_numpy()).astype(float))})

    rows = samples.select(F.col(key).cast("long").alias("case_id"), F.col(label).cast("int").alias("y_true"), F.col(features).alias("x"))
    return rows.mapInPandas(run, "model_name string, case_id long, y_true int, y_prob double")


def predictions(scored_rows: DataFrame, classes: list[str], positive: str = "malignant", threshold: float = 0.5) -> DataFrame:
    """(model_name, case_id, predicted_label, probability_positive, confidence, confidence_band) of two-class scores."""
    p = F.col("y_prob")
    both = F.array(1 - p, p) if classes.index(positive) == 1 else F.array(p, 1 - p)
    return scored_rows.select("model_name", "case_id", chosen_label(both, classes, positive, threshold).alias("predicted_label"), p.alias("probability_positive"), F.array_max(both).alias("confidence"), confidence_band(p).alias("confidence_band"))


def predicted(images: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], profile: str) -> DataFrame:
    """(path, width, height, probabilities, inference_ms) of each decoded image: load() runs once in each worker and gives a
    function from [n, features] to [n, classes]; the milliseconds are preprocessing and prediction, by image of a batch.
    Images that cannot be decoded give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            ok = pdf[pdf["data"].notna()]
            for at in range(0, len(ok), IMAGES):
                some = ok.iloc[at : at + IMAGES]
                began = time.perf_counter()
                x = np.stack([preprocess(pixels(r.data, int(r.height), int(r.width), int(r.channels)), profile)[0].ravel() for r in some.itertuples()])
                p = model(x.astype(float))
                ms = 1000 * (time.perf_counter() - began) / len(some)
                yield some[["path", "width", "height"]].assign(probabilities=list(np.asarray(p, float)), inference_ms=ms)

    return images.select("path", "width", "height", "channels", "data").mapInPandas(run, "path string, width int, height int, probabilities array<double>, inference_ms double")


def predict_and_log(images: DataFrame, model: fitting.Softmax, model_name: str, profile: str, log: predlog.Log, batch: str, classes: list[str], positive: str = "malignant", threshold: float = 0.5, legacy: bool = False, explained: DataFrame | None = None) -> DataFrame:
    """Predict decoded images (path, width, height, channels, data), append them to the log and return the rows that were.

    A batch that the log has is neither predicted nor added again; no rows are returned then. explained(path) names images
    that have an explanation. Each row has a small JPEG copy; the longest of its sides is 128.
    """
    spark = images.sparkSession
    sent = spark.sparkContext.broadcast(model)  # k features times the classes
    made = predicted(images, lambda: sent.value, profile).where(F.col("probabilities").isNotNull())
    p = F.element_at("probabilities", classes.index(positive) + 1)
    had = F.lit(False)
    if explained is not None:
        made = made.join(explained.select("path", F.lit(True).alias("had")).distinct(), "path", "left")
        had = F.coalesce("had", F.lit(False))
    copies = small_copies(images).select("path", "thumbnail_jpeg")
    rows = made.join(copies, "path", "left").select(
        F.current_timestamp().alias("created_utc"),
        F.lit(model_name).alias("model_name"),
        F.lit(legacy).alias("model_legacy"),
        chosen_label(F.col("probabilities"), classes, positive, threshold).alias("predicted_label"),
        p.alias("probability_positive"),
        F.array_max("probabilities").alias("confidence"),
        confidence_band(p).alias("confidence_band"),
        F.lit(float(threshold)).alias("threshold"),
        F.element_at(F.split("path", "/"), -1).alias("original_filename"),
        F.col("width").alias("image_width"),
        F.col("height").alias("image_height"),
        "inference_ms",
        had.alias("had_explanation"),
        "thumbnail_jpeg",
        F.lit(None).cast("string").alias("extra_json"),
    )
    before = max((s.last for s in log.segments()), default=0)
    n = log.append(rows, batch)
    return log.rows().where(F.col("id").between(before + 1, before + n))
