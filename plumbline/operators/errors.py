"""Error analysis: a table of decided cases and what separates the right from the wrong ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import category, cohens_d, decided, decision_confidence, effect_band
from plumbline.operators.evaluation import score_range

CATEGORIES = ("true_positive", "true_negative", "false_positive", "false_negative")


def error_table(scored: DataFrame, threshold: float = 0.5, properties: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per case: decision, its confidence, whether it is right, the category, and properties as a struct if asked.

    carry names further columns of the case to keep, such as path and class_name; with path comes filename, its last part.
    """
    t = scored.withColumn("predicted_label", decided(F.col("y_prob"), threshold))
    kept = [F.col(c) for c in carry or []]
    if "path" in (carry or []):
        kept.append(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"))
    out = t.select(
        "model_name",
        "case_id",
        *kept,
        F.col("y_true").alias("true_label"),
        "predicted_label",
        F.col("y_prob").alias("probability_positive"),
        decision_confidence(F.col("y_prob"), F.col("predicted_label")).alias("confidence"),
        (F.col("y_true") == F.col("predicted_label")).alias("correct"),
        category(F.col("y_true"), F.col("predicted_label")).alias("category"),
        *([F.struct(*(F.col(p).cast("double").alias(p) for p in properties)).alias("properties")] if properties else []),
    )
    return out


def category_counts(errors: DataFrame) -> DataFrame:
    """(model_name, category, n) for all four categories, 0 where there is none."""
    counts = errors.groupBy("model_name").agg(*(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES))
    return counts.unpivot("model_name", list(CATEGORIES), "category", "n")


def property_comparison(errors: DataFrame, properties: list[str]) -> DataFrame:
    """(model_name, property, means, deviations, cohens_d, band) of right against wrong cases; no row with under 2 values."""
    flat = errors.where("properties is not null").select("model_name", "correct", *(F.col(f"properties.{p}").alias(p) for p in properties))
    long = flat.unpivot(["model_name", "correct"], properties, "property", "value").where("value is not null")
    side = lambda ok: F.when(F.col("correct") == ok, F.col("value"))
    stats = long.groupBy("model_name", "property").agg(*(f(side(ok)).alias(f"{n}_{w}") for ok, w in ((True, "correct"), (False, "incorrect")) for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.var_samp, "var"), (F.count, "n"))))
    d = cohens_d(*(F.col(f"{n}_{w}") for w in ("correct", "incorrect") for n in ("mean", "var", "n")))
    return stats.where("n_correct >= 2 and n_incorrect >= 2").withColumn("cohens_d", d).withColumn("interpretation", effect_band(F.col("cohens_d"))).select("model_name", "property", "mean_correct", "std_correct", "mean_incorrect", "std_incorrect", "cohens_d", "interpretation")


def top_properties(comparison: DataFrame, n: int = 3) -> DataFrame:
    """Each model's n properties of the largest effect; ties by name."""
    place = F.row_number().over(Window.partitionBy("model_name").orderBy(F.desc(F.abs("cohens_d")), "property"))
    return comparison.withColumn("place", place).where(F.col("place") <= n)


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): exact, from counts of distinct values and running counts within ranges of them, for values in [0, 1]."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n")).withColumn("part", score_range(F.col("v")))
    parts = counts.groupBy(*by, "part").agg(F.sum("n").alias("m"))
    up = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "part", F.coalesce(F.sum("m").over(up), F.lit(0)).alias("below"), F.sum("m").over(Window.partitionBy(*by)).alias("total"))
    inside = Window.partitionBy(*by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.join(parts, [*by, "part"]).withColumn("upto", F.col("below") + F.sum("n").over(inside))
    holds = lambda place: F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place), F.col("v")))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return run.groupBy(*by).agg(((holds(low) + holds(high)) / 2).alias("median"))


def confidence_separation(errors: DataFrame) -> DataFrame:
    """Mean and median confidence of right and wrong cases and the gap of means; models lacking a side give no row."""
    means = errors.groupBy("model_name", "correct").agg(F.avg("confidence").alias("mean"))
    both = means.join(medians(errors, ["model_name", "correct"], "confidence"), ["model_name", "correct"])
    side = lambda c, ok: F.max(F.when(F.col("correct") == ok, F.col(c)))
    stats = both.groupBy("model_name").agg(*(side(c, ok).alias(f"{c}_{w}") for ok, w in ((True, "correct"), (False, "incorrect")) for c in ("mean", "median")))
    return stats.where("mean_correct is not null and mean_incorrect is not null").withColumn("gap", F.col("mean_correct") - F.col("mean_incorrect"))


def abstention_curve(errors: DataFrame, steps: int = 21) -> DataFrame:
    """(model_name, cutoff, coverage, accuracy, n_covered) for cutoffs from 0.5 to 1; accuracy is null where none is covered.

    One pass counts cases by the highest cutoff they reach; running sums over the steps give the curve.
    """
    step = 0.5 / (steps - 1)
    near = F.floor((F.col("confidence") - 0.5) / step)
    at = lambda i: F.lit(0.5) + i * F.lit(step)
    i = F.when(at(near + 1) <= F.col("confidence"), near + 1).when(at(near) > F.col("confidence"), near - 1).otherwise(near)
    reached = errors.withColumn("i", F.least(F.greatest(i, F.lit(-1)), F.lit(steps - 1))).groupBy("model_name", "i").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    totals = reached.groupBy("model_name").agg(F.sum("n").alias("total"))
    rows = totals.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long")))).join(reached, ["model_name", "i"], "left")
    down = Window.partitionBy("model_name").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumns({"n_covered": F.sum(F.coalesce("n", F.lit(0))).over(down), "right_covered": F.sum(F.coalesce("right", F.lit(0))).over(down)})
    return run.select("model_name", at(F.col("i")).alias("cutoff"), F.try_divide(F.col("n_covered").cast("double"), "total").alias("coverage"), F.try_divide(F.col("right_covered").cast("double"), "n_covered").alias("accuracy"), "n_covered")


def hardest_cases(errors: DataFrame, n: int = 10) -> DataFrame:
    """(kind, place, ...): each model's most confident errors and least confident decisions, ties in case order."""

    def ranked(rows: DataFrame, kind: str, by: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("model_name").orderBy(by, "case_id"))
        return rows.select("model_name", F.lit(kind).alias("kind"), place.alias("place"), "case_id", "category", "confidence").where(F.col("place") <= n)

    return ranked(errors.where(~F.col("correct")), "most_confident_errors", F.desc("confidence")).unionByName(ranked(errors, "least_confident", F.asc("confidence")))


def first_of_category(errors: DataFrame, category: str, n: int = 10) -> DataFrame:
    """Each model's first n cases of a category in case order."""
    place = F.row_number().over(Window.partitionBy("model_name").orderBy("case_id"))
    return errors.where(F.col("category") == category).withColumn("place", place).where(F.col("place") <= n)
