"""Profiles of labelled datasets: class sizes, sizes and intensities per class, shortcut features, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import cohens_d, ratio


def class_distribution(samples: DataFrame, label: str = "class_name") -> DataFrame:
    """(class_name, n, share)."""
    counts = samples.groupBy(F.col(label).alias("class_name")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def class_summary(samples: DataFrame) -> DataFrame:
    """Per class_name: count, with_mask, width, height and intensity statistics, distinct sizes; 0 where nothing is readable."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    sides = [zero(f(side)).alias(f"{side}_{n}") for side in ("width", "height") for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    return samples.groupBy("class_name").agg(
        F.count("*").alias("count"), F.count_if(F.size(F.coalesce("mask_paths", F.array().cast("array<string>"))) > 0).alias("with_mask"), *sides, zero(F.avg("mean_intensity")).alias("intensity_mean"), zero(F.stddev_pop("mean_intensity")).alias("intensity_std"), F.count_distinct(F.when(F.col("width").isNotNull(), F.struct("width", "height"))).alias("distinct_sizes")
    )


def imbalance(samples: DataFrame) -> DataFrame:
    """(total, largest, smallest, imbalance_ratio): the largest class against the smallest, as 1 at least."""
    n = samples.groupBy("class_name").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.min("n").alias("smallest")).withColumn("imbalance_ratio", F.round(F.try_divide(F.col("largest").cast("double"), F.greatest(F.lit(1), "smallest")), 3))


def shortcut_check(samples: DataFrame, properties: list[str], label: str = "class_name", concern: float = 0.5) -> DataFrame:
    """Cohen's d of each property between exactly two classes (in name order), and whether it may serve as a shortcut.

    With another number of classes the result is empty; so is a property with fewer than two values in a class.
    """
    long = samples.select(F.col(label).alias("class_name"), *(F.col(p).cast("double").alias(p) for p in properties)).unpivot("class_name", properties, "property", "value").where("value is not null and class_name is not null")
    stats = long.groupBy("property", "class_name").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.count("value").alias("n"))
    sides = stats.groupBy("property").agg(F.count("*").alias("classes"), F.min_by(F.struct("class_name", "mean", "var", "n"), "class_name").alias("a"), F.max_by(F.struct("class_name", "mean", "var", "n"), "class_name").alias("b"))
    d = cohens_d(*(F.col(f"{s}.{c}") for s in ("a", "b") for c in ("mean", "var", "n")))
    return sides.where("classes = 2 and a.n >= 2 and b.n >= 2").select("property", F.col("a.class_name").alias("class_a"), F.col("b.class_name").alias("class_b"), F.col("a.mean").alias("mean_a"), F.col("b.mean").alias("mean_b"), d.alias("cohens_d")).withColumn("concern", F.abs("cohens_d") >= concern)


def class_weights(samples: DataFrame, label: str = "class_name", mode: str | dict | None = "balanced") -> DataFrame | None:
    """(class_name, n, weight) by mode: balanced is total / (classes * n), so that classes weigh alike; a dict gives the
    weights itself, null for classes that it lacks; none, "none" or "" is no table at all; anything else is an error."""
    if not mode or mode == "none":
        return None
    counts = samples.groupBy(F.col(label).alias("class_name")).agg(F.count("*").alias("n"))
    if isinstance(mode, dict):
        given = F.coalesce(*(F.when(F.col("class_name").cast("string") == str(k), F.lit(float(v))) for k, v in mode.items()))
        return counts.withColumn("weight", given)
    if mode != "balanced":
        raise KeyError(f"unknown class weights: {mode!r}")
    every = Window.partitionBy()
    return counts.withColumn("weight", ratio(F.sum("n").over(every), F.count("*").over(every) * F.col("n")))


def split_report(samples: DataFrame) -> DataFrame:
    """Per split: n, its share, and how many groups it holds; with class counts as a map. Counts come first, so maps are small."""
    by_class = samples.groupBy("split", "class_name").agg(F.count("*").alias("n"))
    groups = samples.select("split", "group_id").distinct().groupBy("split").agg(F.count("group_id").alias("n_groups"))
    per = by_class.groupBy("split").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "n")))).alias("per_class"))
    return per.join(groups, "split").withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy()))).select("split", "n", "share", "per_class", "n_groups")


def split_composition(samples: DataFrame) -> DataFrame:
    """(split, class_name, n, start): stacked bars, start being the sum of the classes before."""
    n = samples.groupBy("split", "class_name").agg(F.count("*").alias("n"))
    before = Window.partitionBy("split").orderBy("class_name").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def histogram(samples: DataFrame, value: str, label: str = "class_name", bins: int = 40) -> DataFrame:
    """(class_name, bin, bin_lower, bin_upper, n): equal bins over each class's own range, the last one closed."""
    v = samples.select(F.col(label).alias("class_name"), F.col(value).cast("double").alias("v")).where("v is not null")
    ends = v.groupBy("class_name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = v.join(ends, "class_name").withColumn("bin", at).groupBy("class_name", "bin", "lo", "hi").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counts.select("class_name", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lower"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_upper"), "n")


def against_expected(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """(class_name, n, expected, matches): found class sizes beside expected(class_name, expected); null expectation matches."""
    n = samples.groupBy("class_name").agg(F.count("*").alias("n"))
    return n.join(expected, "class_name", "left").withColumn("matches", F.coalesce(F.col("n") == F.col("expected"), F.lit(True)))


def _drawn(key: str, seed: int) -> list[Column]:
    """The order in which a class's rows are drawn: by a seeded digest of the key, the same on every cluster."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), F.col(key)]


def sample_per_class(samples: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """k rows of each class, chosen by a seeded digest of the key."""
    place = F.row_number().over(Window.partitionBy("class_name").orderBy(*_drawn(key, seed)))
    return samples.withColumn("place", place).where(F.col("place") <= k).drop("place")


def labelled(samples: DataFrame, classes: list[str]) -> DataFrame:
    """Adds label: the place of class_name in classes, null for others."""
    name: Column = F.array_position(F.array(*map(F.lit, classes)), F.col("class_name")) - 1
    return samples.withColumn("label", F.when(name >= 0, name.cast("int")))


def dimensions(samples: DataFrame) -> DataFrame:
    """(class_name, width, height, n): how many images of a class have a size; unreadable ones are left out."""
    return samples.where("width is not null and height is not null").groupBy("class_name", "width", "height").agg(F.count("*").alias("n"))


def sample_grid(samples: DataFrame, columns: int, key: str, seed: int = 42) -> DataFrame:
    """sample_per_class with row (the class's place in name order) and column of a picture sheet."""
    picked = sample_per_class(samples, columns, key, seed)
    place = F.row_number().over(Window.partitionBy("class_name").orderBy(*_drawn(key, seed))) - 1
    row = F.dense_rank().over(Window.orderBy("class_name")) - 1  # at most columns rows a class are left
    return picked.withColumn("column", place).withColumn("row", row)


def training_history(history: DataFrame, metrics: list[str]) -> DataFrame:
    """(model_name, epoch, metric, train, val): each metric beside its val_ twin, null where the history lacks it."""
    value = lambda c: F.col(c).cast("double") if c in history.columns else F.lit(None).cast("double")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), value(m).alias("train"), value(f"val_{m}").alias("val")) for m in metrics))
    return history.select("model_name", "epoch", F.explode(each).alias("h")).select("model_name", "epoch", "h.*")


def fold_stability(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """(model_name, metric, n, low, q1, middle, q3, high): a box for each metric over the folds (model_name, fold, metrics)."""
    long = folds.select("model_name", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot("model_name", metrics, "metric", "value").where("value is not null")
    at = lambda q: F.percentile("value", F.lit(q))  # noqa: E731  a model's folds are few
    return long.groupBy("model_name", "metric").agg(F.count("*").alias("n"), F.min("value").alias("low"), at(0.25).alias("q1"), at(0.5).alias("middle"), at(0.75).alias("q3"), F.max("value").alias("high"))
