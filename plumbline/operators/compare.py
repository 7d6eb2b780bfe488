"""Comparing evaluated models: fairness of the comparison, leaderboards, overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def divergent_settings(settings: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n_values): settings in which models differ; a missing value counts as a value. Empty with fewer than two models."""
    long = settings.select("model_name", *(F.coalesce(F.col(k).cast("string"), F.lit("null")).alias(k) for k in keys)).unpivot("model_name", keys, "key", "value")
    return long.groupBy("key").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("model_name").alias("models")).where("n_values > 1 and models > 1").select("key", "n_values")


def divergent_maps(settings: DataFrame) -> DataFrame:
    """The same for settings(model_name, settings map<string, string>): keys are those of any model."""
    models = settings.select("model_name").distinct()
    keys = settings.select(F.explode(F.map_keys("settings")).alias("key")).distinct()
    own = settings.select("model_name", F.explode("settings").alias("key", "value"))
    known = own.groupBy("key").agg(F.count_distinct("value").alias("n"), F.count_distinct("model_name").alias("of"), F.count_if(F.col("value").isNull()).alias("nulls"))
    total = models.agg(F.count("*").alias("models"))
    both = keys.join(known, "key").withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    values = F.col("n") + ((F.col("of") < F.col("models")) | (F.col("nulls") > 0)).cast("int")
    return both.select("key", values.alias("n_values"), "models").where("n_values > 1 and models > 1").select("key", "n_values")


def with_metadata(models: DataFrame, metadata: DataFrame) -> DataFrame:
    """models(model_name) that have metadata(model_name, ...), with it; others are skipped."""
    return models.select("model_name").distinct().join(metadata, "model_name")


def missing_models(requested: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Requested model names that nothing was evaluated for."""
    return requested.select("model_name").distinct().join(evaluated.select("model_name").distinct(), "model_name", "left_anti")


def leaderboard(metrics: DataFrame, by: str = "sensitivity") -> DataFrame:
    """metrics with place: highest first, a missing value as 0, ties by name."""
    order = Window.orderBy(F.desc(F.coalesce(by, F.lit(0.0))), "model_name")
    return metrics.withColumn("place", F.row_number().over(order))


def best_model(metrics: DataFrame, by: str = "sensitivity") -> DataFrame:
    """The one row of the leaderboard's first place."""
    return leaderboard(metrics, by).where("place = 1").drop("place")


def interval_overlap(metrics: DataFrame, by: str = "sensitivity", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """(best, model_name, overlaps): whether each other model's upper end (missing: 0) reaches the best's lower end (missing: 1)."""
    best = best_model(metrics, by).select(F.col("model_name").alias("best"), F.coalesce(lower, F.lit(1.0)).alias("best_lower"), F.lit(1).alias("one"))
    others = metrics.withColumn("one", F.lit(1)).join(F.broadcast(best), "one").where("model_name <> best")  # best is one row
    return others.select("best", "model_name", (F.coalesce(upper, F.lit(0.0)) >= F.col("best_lower")).alias("overlaps"))


def comparison_table(metrics: DataFrame, intervals: DataFrame, names: list[str]) -> DataFrame:
    """(model_name, metric, value, lower, upper, bar_low, bar_high) for each model and metric; bars are 0 where no interval is."""
    long = metrics.select("model_name", *(F.col(n).cast("double").alias(n) for n in names)).unpivot("model_name", names, "metric", "value")
    both = long.join(intervals.select("model_name", "metric", "lower", "upper"), ["model_name", "metric"], "left")
    bar = lambda x: F.coalesce(F.greatest(F.lit(0.0), x), F.lit(0.0))
    return both.withColumns({"bar_low": bar(F.col("value") - F.col("lower")), "bar_high": bar(F.col("upper") - F.col("value"))})


def default_model(registry: DataFrame) -> DataFrame:
    """(default_name): the first name that is not legacy, else the first name; null if there is no model."""
    return registry.agg(F.coalesce(F.min(F.when(~F.col("legacy"), F.col("name"))), F.min("name")).alias("default_name"))


def best_epoch(history: DataFrame) -> DataFrame:
    """(model_name, epoch, val_loss) of the lowest validation loss, the first on ties."""
    best = F.min_by(F.struct("epoch", "val_loss"), F.struct("val_loss", "epoch"))
    return history.where("val_loss is not null").groupBy("model_name").agg(best.alias("b")).select("model_name", "b.epoch", "b.val_loss")
