"""Bundles of operators: evaluation of models, error analysis, dataset audit, comparison, and their reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalar import confidence_band, format_metric, shown_probability
from plumbline.operators import bootstrap, compare, duplicates, errors, evaluation, profile, splitting
from plumbline.sources import images as sources
from plumbline.tables import written


def evaluate(scored: DataFrame, threshold: float = 0.5, target: float = 0.95, iterations: int = 2000) -> dict[str, DataFrame]:
    """Everything about scored cases, over one written copy of their columns."""
    s = written(evaluation.sound(scored).select("model_name", "case_id", "y_true", "y_prob"), "scored")
    return {
        "balance": evaluation.class_balance(s),
        "metrics": evaluation.point_metrics(s, threshold),
        "intervals": bootstrap.intervals(s, threshold, iterations),
        "calibration": evaluation.calibration_bins(s),
        "ece": evaluation.expected_calibration_error(s),
        "roc": evaluation.roc_curve(s),
        "pr": evaluation.pr_curve(s),
        "sweep": evaluation.threshold_sweep(s),
        "operating_point": evaluation.operating_point(s, target),
    }


def analyze(scored: DataFrame, threshold: float = 0.5, properties: list[str] | None = None) -> dict[str, DataFrame]:
    """Everything about the errors among scored cases, over one written error table."""
    table = written(errors.error_table(scored, threshold, properties), "errors")
    found = {"table": table.drop("properties"), "categories": errors.category_counts(table), "separation": errors.confidence_separation(table), "abstention": errors.abstention_curve(table), "hardest": errors.hardest_cases(table)}
    if properties:
        found["properties"] = errors.property_comparison(table, properties)
    return found


def dataset_report(samples: DataFrame, properties: list[str], vector: str, threshold: float = 0.95, seed: int = 42) -> dict[str, DataFrame]:
    """Profile, duplicates, a split by duplicate clusters, and what still leaks: samples(idx, class_name, label, content, vector, ...)."""
    s = written(samples, "samples")
    clusters = duplicates.near_duplicate_clusters(s, threshold, "idx", vector)
    grouped = written(s.drop("group_id").join(clusters, "idx").withColumn("group_id", F.concat(F.lit("cluster_"), "cluster_id")), "grouped")
    split = written(splitting.train_val_test_split(grouped, seed=seed), "split")
    side = lambda name: split.where(F.col("split") == name).select("idx", vector)
    return {
        "classes": profile.class_distribution(s),
        "shortcuts": profile.shortcut_check(s, properties),
        "audit": duplicates.integrity_audit(s, s.select(F.col("idx").alias("key"), "content"), threshold, "idx", vector),
        "split": split,
        "split_report": profile.split_report(split),
        "leakage": duplicates.split_leakage(side("test"), side("train"), key="idx", vector=vector),
        "shared_groups": splitting.groups_in_two_splits(split),
    }


def unclassed_audit(spark: SparkSession, root: str, threshold: float = 0.95, seed: int = 0) -> dict[str, DataFrame]:
    """An audit of all images below root, whatever folders they are in: duplicates, and what a split by rows leaks.

    Empty of rows where there are no images; nothing is grouped.
    """
    files = sources.listing(spark, root)
    seen = sources.features(sources.images(spark, root)).select("path", "thumbnail")
    s = written(sources.every_folder(files).join(seen, "path"), "unclassed")
    content = sources.contents(spark, root).join(s.select("idx", "path"), "path").select(F.col("idx").alias("key"), "content")
    split = splitting.naive_split(s.select("idx", "thumbnail"), 0.2, seed)
    side = lambda name: split.where(F.col("split") == name).select("idx", "thumbnail")
    return {"samples": s, "audit": duplicates.integrity_audit(s, content, threshold, "idx", "thumbnail"), "naive_leakage": duplicates.split_leakage(side("test"), side("train"), key="idx", vector="thumbnail")}


def comparison(metrics: DataFrame, intervals: DataFrame, settings: DataFrame, keys: list[str], names: list[str]) -> dict[str, DataFrame]:
    """Leaderboard, metric table with texts, settings that differ, and which intervals reach the best model's."""
    table = compare.comparison_table(metrics, intervals, names)

    @F.pandas_udf("string")
    def text(value: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        none = lambda x: None if pd.isna(x) else x
        return pd.Series([format_metric(*map(none, r)) for r in zip(value, low, high)], dtype=object)

    best = metrics.join(intervals.where("metric = 'sensitivity'").select("model_name", "lower", "upper"), "model_name", "left")
    return {"leaderboard": compare.leaderboard(metrics), "table": table.withColumn("text", text("value", "lower", "upper")), "divergent": compare.divergent_settings(settings, keys), "overlap": compare.interval_overlap(best)}


def prediction_reports(log: DataFrame) -> DataFrame:
    """(id, report): each logged prediction as a nested JSON document with its statement and notes."""
    p = shown_probability(F.col("probability_positive"), F.col("predicted_label") == "malignant")
    band = confidence_band(F.col("probability_positive"))
    statement = F.format_string("The model assigns %s with a probability of %.1f%%.", F.col("predicted_label"), p * 100)
    note = F.when(band == "high", "The probability is far from one half.").when(band == "moderate", "The probability is at some distance from one half.").otherwise("The probability is close to one half; treat the answer as undecided.")
    limits = F.array(F.lit("Research output, not a diagnosis."), F.when(F.col("model_legacy"), "A legacy model: its accuracy was measured on a leaking split.").otherwise("Valid only for images like those of the training set."))
    document = F.struct(F.col("id"), F.col("created_utc"), F.struct(F.col("model_name").alias("name"), F.col("model_legacy").alias("legacy")).alias("model"), F.struct(F.col("predicted_label").alias("label"), F.round(p, 4).alias("probability"), band.alias("band")).alias("prediction"), statement.alias("statement"), note.alias("note"), limits.alias("limitations"))
    return log.select("id", F.to_json(document).alias("report"))


def report_text(log: DataFrame) -> DataFrame:
    """(id, text): the same as lines of plain text."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("n/a")))
    return log.select("id", F.concat_ws("\n", line("Prediction", F.col("id")), line("Time", F.col("created_utc")), line("Model", F.col("model_name")), line("Label", F.col("predicted_label")), line("Probability", F.round("probability_positive", 4)), line("Band", confidence_band(F.col("probability_positive")))).alias("text"))


def resolution_note(heatmaps: DataFrame) -> DataFrame:
    """heatmaps(h, w) with note: a warning where the smaller side is under 8."""
    return heatmaps.withColumn("note", F.when(F.least("h", "w") < 8, F.format_string("The heat map has only %d x %d cells; it shows coarse regions.", F.col("h"), F.col("w"))))
