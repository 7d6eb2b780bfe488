"""Group-aware stratified splits that leak no group from one split into another.

Groups are dealt to ranges by a seeded hash, and within each range to folds, the most uneven first, each to the fold that
keeps the class shares closest. A range then is a few bins of groups, one a fold, and bins are dealt in the same way: each
range's bins to different folds, range by range, within ranges of ranges, until one is left. So no step holds more than
RANGE groups or ranges, and none waits for all groups. Which group lands where depends on the seed alone, not on
partitions.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import folds_for
from plumbline.tables import written

#: Groups in a range, and ranges in a range of ranges, about.
RANGE = 4096


def deal(counts: np.ndarray, folds: int) -> np.ndarray:
    """A fold for each row of counts[group, class], rows in dealing order: the fold that keeps class shares most even."""
    held = np.zeros((folds, counts.shape[1]))
    total = np.maximum(counts.sum(axis=0), 1)
    out = np.zeros(len(counts), int)
    for g, c in enumerate(counts):
        after = (held[None, :, :] + np.eye(folds)[:, :, None] * c) / total
        spread = after.std(axis=1).mean(axis=1)
        sizes = held.sum(axis=1)
        best = min(range(folds), key=lambda f: (round(spread[f], 12), sizes[f], f))
        held[best] += c
        out[g] = best
    return out


def matched(bins: np.ndarray) -> np.ndarray:
    """[ranges, folds]: the fold of each of bins[range, fold, class], a range's bins in different folds, range by range.

    What the folds hold beyond their mean is kept small, by squares over the class totals: bins go where they fit best, the
    most uneven first, and then trade places while that helps.
    """
    ranges, folds, _ = bins.shape
    over = np.zeros(bins.shape[1:])
    total = np.maximum(bins.sum(axis=(0, 1)), 1)
    out = np.zeros((ranges, folds), int)
    for r, b in enumerate(bins):
        d = b - b.mean(axis=0)
        cost = ((over[None, :, :] + d[:, None, :]) ** 2 / total).sum(axis=2)
        free = list(range(folds))
        for i in np.argsort(-(d**2 / total).sum(axis=1), kind="stable").tolist():
            out[r, i] = free.pop(int(np.argmin(cost[i, free])))
        better = True
        while better:
            better = False
            for i in range(folds):
                for j in range(i):
                    x, y = out[r, i], out[r, j]
                    if cost[i, y] + cost[j, x] < cost[i, x] + cost[j, y] - 1e-12:
                        out[r, i], out[r, j], better = y, x, True
        over[out[r]] += d
    return out


def by_class(texts: pd.Series) -> np.ndarray:
    """[rows, classes] of counts that stand as JSON objects, classes in order of their names."""
    each = [json.loads(t) for t in texts]
    names = sorted({c for m in each for c in m})
    return np.array([[m.get(c, 0) for c in names] for m in each], float).reshape(len(each), len(names))


def added(texts: pd.Series) -> str:
    """The sum of counts that stand as JSON objects."""
    total: dict[str, int] = {}
    for t in texts:
        for c, n in json.loads(t).items():
            total[c] = total.get(c, 0) + n
    return json.dumps(total, sort_keys=True)


def fold_of_groups(samples: DataFrame, folds: int, seed: int, group: str = "group_id", label: str = "label") -> DataFrame:
    """(group, fold) of every group; an error if there are fewer groups than folds. Null groups are one group, null labels a
    class of their own."""
    cells = samples.groupBy(F.col(group).alias("group"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    counts = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))))
    groups = cells.groupBy("group").agg(counts.alias("counts")).withColumn("turn", F.xxhash64(F.lit(seed), "group"))
    groups = written(groups, "groups")
    n = groups.count()
    if n < folds:
        raise ValueError(f"{n} groups are too few for {folds} folds")
    ranges = -(-n // RANGE)
    kind = dict(groups.dtypes)["group"]

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", kind="stable").reset_index(drop=True)
        table = by_class(pdf["counts"])
        order = np.lexsort((np.arange(len(pdf)), -table.sum(axis=1), -table.std(axis=1)))
        pdf.loc[order, "fold"] = deal(table[order], folds)
        return pdf[["group", "range", "counts", "fold"]].astype({"fold": "int64"})

    dealt = groups.withColumn("range", F.pmod(F.xxhash64(F.lit(seed), F.lit("range"), "group"), F.lit(ranges)))
    dealt = dealt.groupBy("range").applyInPandas(within, f"group {kind}, range long, counts string, fold long")
    if ranges == 1:
        return dealt.select("group", "fold")
    dealt = written(dealt, "dealt")

    def bins(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(counts=added(pdf["counts"]))

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["range", "fold"]).reset_index(drop=True)
        table = by_class(pdf["counts"])
        whole = np.zeros((pdf["range"].nunique(), folds, table.shape[1]))  # a range of few groups may lack bins
        whole[pd.factorize(pdf["range"])[0], pdf["fold"]] = table
        return pdf.assign(into=matched(whole)[pd.factorize(pdf["range"])[0], pdf["fold"]])[["range", "fold", "into", "counts"]]

    row = "range long, counts string, fold long"
    left = written(dealt.select("range", "counts", "fold").groupBy("range", "fold").applyInPandas(bins, row), "bins")
    while ranges > 1:
        moved = written(left.groupBy(F.floor(F.col("range") / RANGE).alias("wide")).applyInPandas(between, "range long, fold long, into long, counts string"), "moved")
        dealt = dealt.join(moved.select("range", "fold", "into"), ["range", "fold"]).select("group", F.floor(F.col("range") / RANGE).alias("range"), F.col("into").alias("fold"))
        ranges = -(-ranges // RANGE)
        left = moved.select(F.floor(F.col("range") / RANGE).alias("range"), "counts", F.col("into").alias("fold")).groupBy("range", "fold").applyInPandas(bins, row)
    return dealt.select("group", "fold")


def group_folds(samples: DataFrame, folds: int = 5, seed: int = 42, group: str = "group_id", label: str = "label") -> DataFrame:
    """samples with fold: rows of a group always share one."""
    of = fold_of_groups(samples, folds, seed, group, label).withColumnRenamed("group", "__group")
    return samples.join(of, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def holdout(samples: DataFrame, share: float, seed: int, group: str = "group_id", label: str = "label") -> DataFrame:
    """samples with held: whether the row's group is in the first of round(1 / share) folds."""
    return group_folds(samples, folds_for(share), seed, group, label).withColumn("held", F.col("fold") == 0).drop("fold")


def train_val_test_split(samples: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42, group: str = "group_id", label: str = "label") -> DataFrame:
    """samples with split (train, val or test), by whole groups; the test set is drawn first, then val from the rest."""
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("shares must sum to 1")
    first = written(holdout(samples, test, seed, group, label), "held")
    rest = holdout(first.where("not held").drop("held"), val / (train + val), seed + 1, group, label)
    return first.where("held").drop("held").withColumn("split", F.lit("test")).unionByName(rest.withColumn("split", F.when(F.col("held"), "val").otherwise("train")).drop("held"))


def groups_in_two_splits(samples: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups that more than one split holds; a sound split has none."""
    return samples.select(group, "split").distinct().groupBy(group).agg(F.count("*").alias("splits")).where("splits > 1")


def coverage(manifest: DataFrame, split: DataFrame, key: str = "idx") -> DataFrame:
    """(in_manifest, in_split, distinct_in_split): a split is complete and disjoint if the three are equal."""
    one = F.lit(1).alias("one")
    a = manifest.agg(F.count("*").alias("in_manifest")).select("*", one)
    b = split.agg(F.count("*").alias("in_split"), F.count_distinct(key).alias("distinct_in_split")).select("*", one)
    return a.join(b, "one").drop("one")


def naive_split(samples: DataFrame, share: float = 0.2, seed: int = 0, key: str = "idx") -> DataFrame:
    """samples with split by rows, whatever their groups: the leaking baseline. Exactly round(share * n) rows are test."""
    h = F.xxhash64(F.lit(seed), key)
    parts = samples.select(F.col(key), F.shiftrightunsigned(h, 48).alias("part"), h.alias("turn"))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part"))
    wanted = F.round(F.lit(share) * F.sum("n").over(Window.partitionBy()))
    cut = counts.select("part", (wanted - upto + F.col("n")).alias("room"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("turn", key))
    test = parts.join(cut, "part").withColumn("place", place).select(key, F.when(F.col("place") <= F.col("room"), "test").otherwise("train").alias("split"))
    return samples.join(test, key)


def stale_rows(split: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of a stored split(idx, path) whose path is no longer the manifest's at that idx, missing ones included."""
    return split.alias("s").join(manifest.alias("m"), "idx", "left").where(~F.col("s.path").eqNullSafe(F.col("m.path"))).select("idx", F.col("s.path").alias("recorded"), F.col("m.path").alias("current"))


def split_samples(samples: DataFrame, split: DataFrame, which: str | None = None, key: str = "idx") -> DataFrame:
    """samples with split, by the stored split(idx, split): those of one split, or of all; rows of no split are left out."""
    rows = split.select(key, "split")
    return samples.join(rows.where(F.col("split") == which) if which else rows, key)


def aligned(truth: DataFrame, scores: DataFrame, positive: int | str, key: str = "case_id", label: str = "label") -> DataFrame:
    """(model_name, case_id, y_true, y_prob): truth(case_id, label) made binary beside scores(model_name, case_id, y_prob).

    Cases are matched by name, never by place; those that one side lacks are left out.
    """
    return scores.select("model_name", key, "y_prob").join(truth.select(key, (F.col(label) == F.lit(positive)).cast("int").alias("y_true")), key).select("model_name", F.col(key).alias("case_id"), "y_true", "y_prob")
