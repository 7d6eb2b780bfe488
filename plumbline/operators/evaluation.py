"""Evaluation of binary scores: tables scored(model_name, case_id, y_true, y_prob), one result per model.

Rows with a null label or a null or NaN score are left out. Curves and areas start from counts per distinct score, and
running counts are taken within score ranges first, so no task holds a model's whole curve in one window. Ranges are
even in the logarithm of the odds, since scores crowd near 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import decided, grid, ratio

#: Score ranges for each unit of log odds.
RANGES = 64
RATES = ("accuracy", "balanced_accuracy", "sensitivity", "specificity", "precision", "npv", "f1", "false_positive_rate", "false_negative_rate")


def sound(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("y_true").isNotNull() & F.col("y_prob").isNotNull() & ~F.isnan("y_prob"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(model_name, tn, fp, fn, tp)."""
    p, y = decided(F.col("y_prob"), threshold), F.col("y_true")
    cells = [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]
    return sound(scored).groupBy("model_name").agg(*(F.count_if((y == a) & (p == b)).alias(n) for n, a, b in cells))


def rates(counts: DataFrame) -> DataFrame:
    """Adds the rates that tn, fp, fn and tp imply; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tn + fp + fn + tp),
            "balanced_accuracy": (sens + spec) / 2,
            "sensitivity": sens,
            "specificity": spec,
            "precision": ratio(tp, tp + fp),
            "npv": ratio(tn, tn + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "false_positive_rate": ratio(fp, fp + tn),
            "false_negative_rate": ratio(fn, fn + tp),
        }
    )


def score_range(p: Column) -> Column:
    """A whole number that never falls as p rises; all p up to 0 share one, and all from 1 on."""
    return F.when(p <= 0, -(2**20)).when(p >= 1, 2**20).otherwise(F.floor(F.log(p / (1 - p)) * RANGES)).cast("long")


def score_steps(scored: DataFrame) -> DataFrame:
    """Per model and distinct score: pos, neg, the running pos_ge and neg_ge from the highest score down, and totals."""
    counts = sound(scored).groupBy("model_name", "y_prob").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg"))
    counts = counts.withColumn("part", score_range(F.col("y_prob")))
    parts = counts.groupBy("model_name", "part").agg(F.sum("pos").alias("part_pos"), F.sum("neg").alias("part_neg"))
    down = Window.partitionBy("model_name").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("model_name")
    parts = parts.select("model_name", "part", *(F.coalesce(F.sum(f"part_{c}").over(down), F.lit(0)).alias(f"above_{c}") for c in ("pos", "neg")), *(F.sum(f"part_{c}").over(whole).alias(f"total_{c}") for c in ("pos", "neg")))
    inside = Window.partitionBy("model_name", "part").orderBy(F.desc("y_prob")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.join(parts, ["model_name", "part"]).select("model_name", "part", "y_prob", "pos", "neg", *((F.col(f"above_{c}") + F.sum(c).over(inside)).alias(f"{c}_ge") for c in ("pos", "neg")), "total_pos", "total_neg")


def areas(scored: DataFrame) -> DataFrame:
    """(model_name, roc_auc, pr_auc): ties count half; average precision sums steps. Null where a class is missing."""
    s = score_steps(scored)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    below = F.col("total_neg") - F.col("neg_ge")
    won = F.sum(whole("pos") * (2 * below + F.col("neg")).cast("decimal(19,0)"))
    step = F.try_divide(F.col("pos") * F.col("pos_ge").cast("double"), (F.col("pos_ge") + F.col("neg_ge")).cast("double"))
    total = s.groupBy("model_name").agg(won.alias("won"), F.sum(step).alias("step"), F.max("total_pos").alias("p"), F.max("total_neg").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    pairs = (F.lit(2) * whole("p") * whole("n")).cast("double")
    return total.select("model_name", F.when(both, F.try_divide(F.col("won").cast("double"), pairs)).alias("roc_auc"), F.when(both, F.try_divide(F.col("step"), F.col("p").cast("double"))).alias("pr_auc"))


def point_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, rates and areas of each model at one threshold."""
    return rates(confusion(scored, threshold)).withColumn("threshold", F.lit(float(threshold))).join(areas(scored), "model_name", "left")


def _neighbours(s: DataFrame, columns: list[str]) -> DataFrame:
    """Adds before_c and after_c: the values in the next higher and lower score of the model."""
    order = Window.partitionBy("model_name", "part").orderBy(F.desc("y_prob"))
    value = F.struct(*columns)
    edges = s.groupBy("model_name", "part").agg(F.max_by(value, "y_prob").alias("first"), F.min_by(value, "y_prob").alias("last"))
    across = Window.partitionBy("model_name").orderBy(F.desc("part"))
    edges = edges.select("model_name", "part", F.lag("last").over(across).alias("upper"), F.lead("first").over(across).alias("lower"))
    return s.join(edges, ["model_name", "part"]).withColumn("before", F.coalesce(F.lag(value).over(order), "upper")).withColumn("after", F.coalesce(F.lead(value).over(order), "lower")).drop("upper", "lower")


def roc_curve(scored: DataFrame) -> DataFrame:
    """(model_name, fpr, tpr, threshold): from (0, 0), whose threshold is null, without points on a straight line."""
    s = _neighbours(score_steps(scored), ["pos_ge", "neg_ge"])
    bend = lambda c: F.col(f"after.{c}") - 2 * F.col(c) + F.col(f"before.{c}") != 0
    kept = s.where(F.col("before").isNull() | F.col("after").isNull() | bend("pos_ge") | bend("neg_ge"))
    points = kept.select("model_name", ratio(F.col("neg_ge"), F.col("total_neg")).alias("fpr"), ratio(F.col("pos_ge"), F.col("total_pos")).alias("tpr"), F.col("y_prob").alias("threshold"))
    start = sound(scored).select("model_name").distinct().select("model_name", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(start)


def pr_curve(scored: DataFrame) -> DataFrame:
    """(model_name, precision, recall, threshold), ending with (1, 0) and no threshold."""
    s = score_steps(scored)
    points = s.select("model_name", ratio(F.col("pos_ge"), F.col("pos_ge") + F.col("neg_ge")).alias("precision"), ratio(F.col("pos_ge"), F.col("total_pos")).alias("recall"), F.col("y_prob").alias("threshold"))
    end = sound(scored).select("model_name").distinct().select("model_name", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(end)


def _last_step(value: Column, low: float, step: float, n: int) -> Column:
    """The index of the highest of low + i * step (i < n) that value reaches; -1 if none. Exact at the points."""
    near = F.floor((value - low) / step)
    at = lambda i: F.lit(low) + i * F.lit(step)
    exact = F.when(at(near + 1) <= value, near + 1).when(at(near) > value, near - 1).otherwise(near)
    return F.least(F.greatest(exact, F.lit(-1)), F.lit(n - 1))


def threshold_sweep(scored: DataFrame, n_points: int = 101) -> DataFrame:
    """Counts and rates at n_points thresholds from 0 to 1, from one pass: cases per step, then running sums of steps."""
    step = 1.0 / (n_points - 1)
    counts = sound(scored).withColumn("i", _last_step(F.col("y_prob"), 0.0, step, n_points)).groupBy("model_name", "i").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg"))
    totals = counts.groupBy("model_name").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    grid_rows = totals.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_points - 1).cast("long"))))
    down = Window.partitionBy("model_name").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = grid_rows.join(counts, ["model_name", "i"], "left").withColumns({"tp": F.sum(F.coalesce("pos", F.lit(0))).over(down), "fp": F.sum(F.coalesce("neg", F.lit(0))).over(down)})
    cells = run.select("model_name", (F.col("i") * F.lit(step)).alias("threshold"), (F.col("n") - F.col("fp")).alias("tn"), "fp", (F.col("p") - F.col("tp")).alias("fn"), "tp")
    return rates(cells)


def operating_point(scored: DataFrame, target: float = 0.95, n_points: int = 101) -> DataFrame:
    """The highest threshold whose sensitivity reaches the target; else the lowest of the greatest sensitivity, not met."""
    s = threshold_sweep(scored, n_points).select("model_name", "threshold", "sensitivity", "specificity", "precision", "f1")
    row = F.struct("threshold", "sensitivity", "specificity", "precision", "f1")
    met = F.max_by(row, F.when(F.col("sensitivity") >= target, F.col("threshold")))
    best = F.max_by(row, F.struct(F.col("sensitivity"), -F.col("threshold")))
    ok = F.bool_or(F.col("sensitivity") >= target)
    return s.groupBy("model_name").agg(ok.alias("target_met"), F.when(ok, met).otherwise(best).alias("at")).select("model_name", "target_met", "at.*")


def calibration_bins(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """(model_name, bin_lower, bin_upper, count, confidence, accuracy): right-closed bins, the first closed on both sides."""
    edges = [i * (1.0 / n_bins) for i in range(n_bins + 1)]
    at = sum(((F.col("y_prob") > e).cast("int") for e in edges[1:-1]), F.lit(0))
    inside = sound(scored).where((F.col("y_prob") >= edges[0]) & (F.col("y_prob") <= edges[-1]))
    stats = inside.withColumn("i", at).groupBy("model_name", "i").agg(F.count("*").alias("n"), F.sum("y_prob").alias("p"), F.count_if(F.col("y_true") == 1).alias("pos"))
    models = sound(scored).select("model_name").distinct()
    every = models.select("model_name", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("bin_lower"), F.lit(b).alias("bin_upper")) for i, (a, b) in enumerate(zip(edges, edges[1:]))))).alias("b")).select("model_name", "b.*")
    return every.join(stats, ["model_name", "i"], "left").select("model_name", "bin_lower", "bin_upper", F.coalesce("n", F.lit(0)).alias("count"), F.try_divide("p", "n").alias("confidence"), F.try_divide(F.col("pos").cast("double"), "n").alias("accuracy"))


def expected_calibration_error(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    b = calibration_bins(scored, n_bins)
    gap = F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("confidence")))
    return b.groupBy("model_name").agg(ratio(gap, F.sum("count")).alias("ece"))


def class_balance(scored: DataFrame) -> DataFrame:
    return sound(scored).groupBy("model_name").agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == 1).alias("positives"), F.count_if(F.col("y_true") != 1).alias("negatives"), F.avg(F.col("y_true").cast("double")).alias("positive_rate"))


def confusion_rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(model_name, truth, predicted, n, row_rate): each cell's share of its true class."""
    cells = confusion(scored, threshold).select("model_name", F.explode(F.array(*(F.struct(F.lit(t).alias("truth"), F.lit(p).alias("predicted"), F.col(c).alias("n")) for c, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))))).alias("c")).select("model_name", "c.*")
    return cells.withColumn("row_rate", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("model_name", "truth"))))


def grid_rows(scored: DataFrame, n: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Each model with each of n points between low and high."""
    points = grid(n, low, high)
    return sound(scored).select("model_name").distinct().select("model_name", F.explode(F.array(*map(F.lit, points))).alias("point"))
