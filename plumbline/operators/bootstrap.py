"""Bootstrap confidence intervals of metrics by one plan for any number of cases.

Every case has a weight in every replicate, drawn from Poisson(1) by a counter: a hash of the seed, the replicate and the
case's number. Nothing else enters, so neither partitions nor the order of rows change a result. Cases are numbered by
falling score, positives first among equal scores. Weights are added up by score and label, then over ranges of the log
odds for a block of replicates at a time: first the ranges' totals, then, knowing what stands above each range, the areas.

Tables of cells are small beside the draws they stand for, so tasks are dealt out by the number of draws, not by bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.evaluation import RATES, rates, score_steps
from plumbline.tables import written

#: Replicates that one task works on; scores of ranges that are worked on together, and cases that count as much as a score;
#: cases of one score and label that are drawn at once, and as many of these as a row of a task stands for.
BLOCK, SCORES, SHARE, SLICE, SLICES = 250, 8192, 64, 4096, 16
#: Hashes worked on at once, which a core's cache holds, and weights held at once.
HASHES, HELD = 1 << 16, 1 << 23
#: Draws of a task: no fewer, so that it is worth starting; more only if every core has TASKS of them; never many more.
LEAST, MOST, TASKS = 1 << 24, 1 << 29, 8
#: Multipliers of the 32-bit mixing function, and of the replicate's number.
MIX, STEP = (0x7FEB352D, 0x846CA68B), 0x9E3779B1
#: The weight is the number of these that the hash's upper 16 bits reach: Poisson(1) to within 2**-16.
LEVELS = tuple(x for k in range(12) if (x := round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))) < 65536)
_levels = [np.array(x << 16, np.uint32) for x in LEVELS]
_steps = [(np.array(shift, np.uint32), np.array(factor, np.uint32)) for shift, factor in zip((16, 15), MIX)]
AREAS = ("roc_auc", "pr_auc")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX[0])
    x = (x ^ (x >> np.uint32(15))) * np.uint32(MIX[1])
    return x ^ (x >> np.uint32(16))


def nearly_mixed(x: np.ndarray, spare: np.ndarray) -> None:
    """mixed() in place but for its last step, which leaves the upper 16 bits as they are."""
    for shift, factor in _steps:
        np.right_shift(x, shift, out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, factor, out=x)


def weights(seed: int, replicates: np.ndarray, cases: np.ndarray) -> np.ndarray:
    """[replicates, cases]: how often each replicate draws each numbered case."""
    n, first = len(cases), mixed(replicates.astype(np.uint32) * np.uint32(STEP) + np.uint32(seed % 2**32))
    again = mixed(first + np.uint32(1))
    low, high = (cases & 0xFFFFFFFF).astype(np.uint32), (cases >> 32).astype(np.uint32) * np.uint32(MIX[1])
    far = high.any()
    out = np.empty((len(replicates), n), np.uint8)
    rows = max(1, min(len(replicates), HASHES // max(1, n)))
    hashes, spares, reached = (np.empty((rows, n), t) for t in (np.uint32, np.uint32, bool))
    for i in range(0, len(replicates), rows):
        w = out[i : i + rows].reshape(-1)
        wide, spare, over = hashes[: len(first[i : i + rows])], spares.reshape(-1)[: len(w)], reached.reshape(-1)[: len(w)]
        x = wide.reshape(-1)
        np.add(first[i : i + rows, None], low, out=wide)
        nearly_mixed(x, spare)
        np.right_shift(x, _steps[0][0], out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.add(wide, again[i : i + rows, None], out=wide)
        if far:
            np.add(wide, high, out=wide)
        nearly_mixed(x, spare)
        np.greater_equal(x, _levels[0], out=w.view(bool))
        for level in _levels[1:]:
            np.greater_equal(x, level, out=over)
            np.add(w, over.view(np.uint8), out=w)
    return out


def drawn(seed: int, replicates: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[replicates, cells]: weights added up over cells, each a run of cases."""
    ends = np.cumsum(sizes)
    cases = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    out = np.zeros((len(replicates), len(sizes)), np.int64)
    some = np.flatnonzero(sizes)
    rows = max(1, HELD // max(1, len(cases)))
    if len(some):
        single = len(some) == len(cases)  # no score of these stands twice
        kind = np.uint16 if len(LEVELS) * int(sizes.max()) < 2**16 else np.int64
        for i in range(0, len(replicates), rows):
            w = weights(seed, replicates[i : i + rows], cases)
            out[i : i + rows, some] = w if single else np.add.reduceat(w, (ends - sizes)[some], axis=1, dtype=kind)
    return out


def chunks(cells: pd.DataFrame, seed: int, replicates: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A range's scores, highest first, some at a time, with the weights of their positives and negatives."""
    cells = cells.sort_values("y_prob", ascending=False, kind="stable")
    score, before, pos = cells["y_prob"].to_numpy(), cells["before"].to_numpy(np.int64), cells["pos"].to_numpy(np.int64)
    sides = []
    for side, start in (("pos", before), ("neg", before + pos)):
        ready = cells[f"{side}_drawn"].to_numpy()
        own = np.array([x is None for x in ready], bool)
        sides.append((start, np.where(own, cells[side].to_numpy(np.int64), 0), ready, own))
    part = np.cumsum(sides[0][1] + sides[1][1]) // (4 * SLICE) + np.arange(len(cells)) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(cells)]
    for a, b in zip(edges, edges[1:]):
        found = []
        for start, size, ready, own in sides:
            w = drawn(seed, replicates, start[a:b], size[a:b])
            for i in np.flatnonzero(~own[a:b]).tolist():
                w[:, i] = np.frombuffer(ready[a + i], "<i8")
            found.append(w)
        yield score[a:b], *found


def tasks(spark: SparkSession, draws: int) -> int:
    """How many tasks are to share so many draws. Partitions of a given number are not put together for being small."""
    return max(1, min(TASKS * spark.sparkContext.defaultParallelism, draws // LEAST), draws // MOST)


def block_of(block: int, iterations: int) -> np.ndarray:
    return np.arange(block * BLOCK, min(iterations, (block + 1) * BLOCK))


def large_cells(cells: DataFrame, iterations: int, seed: int, n_tasks: int) -> DataFrame:
    """(model_name, y_prob, block, pos_drawn, neg_drawn): weights of labels with over SLICE cases of one score, which are
    dealt out in runs of SLICES times SLICE cases, so that no task draws all of them."""
    side = lambda name, before: F.struct(F.lit(name).alias("side"), before.alias("start"), F.col(name).alias("n"))
    large = cells.select("model_name", "y_prob", F.explode(F.array(side("pos", F.col("before")), side("neg", F.col("before") + F.col("pos")))).alias("c")).select("model_name", "y_prob", "c.*").where(F.col("n") > SLICE)
    runs = large.select("model_name", "y_prob", "side", "start", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLICES * SLICE).cast("long"))).alias("at"))
    runs = runs.repartition(n_tasks, "model_name", "y_prob", "side", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for model, p, side, start, n, at in zip(*(c.to_pylist() for c in b.columns)):
                own = total.setdefault((model, p, side), np.zeros(iterations, np.int64))
                for i in range(at, min(n, at + SLICES * SLICE), SLICE):
                    own += drawn(seed, np.arange(iterations), np.array([start + i]), np.array([min(SLICE, n - i)]))[:, 0]
        for (model, p, side), own in total.items():
            parts = [own[i : i + BLOCK].astype("<i8").tobytes() for i in range(0, iterations, BLOCK)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([model] * n, pa.string()), pa.array([p] * n, pa.float64()), pa.array([side] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], names=["model_name", "y_prob", "side", "block", "drawn"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = pdf.iloc[:1].copy()
        sums["drawn"] = [np.sum([np.frombuffer(x, "<i8") for x in pdf["drawn"]], axis=0).tobytes()]
        return sums

    schema = "model_name string, y_prob double, side string, block int, drawn binary"
    done = runs.mapInArrow(run, schema).groupBy("model_name", "y_prob", "side", "block").applyInPandas(add, schema)
    blob = lambda name: F.max(F.when(F.col("side") == name, F.col("drawn"))).alias(f"{name}_drawn")
    return done.groupBy("model_name", "y_prob", "block").agg(blob("pos"), blob("neg"))


def replicates(scored: DataFrame, threshold: float = 0.5, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """(model_name, replicate, tn, fp, fn, tp, rates, roc_auc, pr_auc) of every replicate that draws both classes.

    Cases with a null label or score take no part, and their numbers close up; a null model is a model. An empty table
    gives no rows. Equal cases (score and label) are told apart by their numbers only, so repeated rows count each.
    """
    blocks = -(-iterations // BLOCK)
    before = F.col("pos_ge") + F.col("neg_ge") - F.col("pos") - F.col("neg")
    # a null model is told by its name's absence and kept under one that groups match on
    steps = score_steps(scored.withColumn("model_name", F.coalesce(F.concat(F.lit("="), "model_name"), F.lit(""))))
    cells = written(steps.select("model_name", "part", F.col("y_prob").cast("double").alias("y_prob"), "pos", "neg", before.alias("before")), "cells")
    few = lambda c: F.when(F.col(c) <= SLICE, F.col(c)).otherwise(0)
    small = few("pos") + few("neg")
    draws = cells.agg(F.sum(small), F.sum(F.col("pos") + F.col("neg") - small)).first()
    few_tasks, large_tasks = (tasks(cells.sparkSession, (n or 0) * iterations) for n in draws)
    # neighbouring ranges of few scores and cases are worked on together; that changes no result
    ranges = cells.groupBy("model_name", "part").agg((F.count("*") + F.sum(small) / SHARE).alias("load"))
    above_them = F.sum("load").over(Window.partitionBy("model_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    units = ranges.select("model_name", F.col("part").alias("range"), F.floor(F.coalesce(above_them, F.lit(0)) / SCORES).alias("part"))
    united = cells.withColumnRenamed("part", "range").join(units, ["model_name", "range"]).drop("range")
    each = united.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ready = written(large_cells(cells, iterations, seed, large_tasks), "drawn")
    rows = written(each.join(ready, ["model_name", "y_prob", "block"], "left").select("model_name", "part", "block", "y_prob", "pos", "neg", "before", "pos_drawn", "neg_drawn"), "cells")
    key = "model_name string, part long, block int"
    total = ("hit_pos", "hit_neg", "pos", "neg")

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        reps = block_of(int(pdf["block"].iloc[0]), iterations)
        sums = np.zeros((4, len(reps)), np.int64)
        for score, pos, neg in chunks(pdf, seed, reps):
            hit = score >= threshold
            sums += np.stack((pos[:, hit].sum(axis=1), neg[:, hit].sum(axis=1), pos.sum(axis=1), neg.sum(axis=1)))
        return pd.DataFrame({c: pdf[c].iloc[:1] for c in ("model_name", "part", "block")} | {c: [x.astype("<i8").tobytes()] for c, x in zip(total, sums)})

    def above(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", ascending=False)
        for c in ("pos", "neg"):
            run = np.zeros(len(pdf[c].iloc[0]) // 8, np.int64)
            over = []
            for x in pdf[c]:
                over.append(run.astype("<i8").tobytes())
                run = run + np.frombuffer(x, "<i8")
            pdf[f"above_{c}"] = over
        return pdf

    def within(cells: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = found.iloc[0]
        reps = block_of(int(row["block"]), iterations)
        tp, fp = (np.frombuffer(row[f"above_{c}"], "<i8").astype(float) for c in ("pos", "neg"))
        lost, step = np.zeros(len(reps)), np.zeros(len(reps))
        for _, pos, neg in chunks(cells, seed, reps):
            tps, fps = tp[:, None] + np.cumsum(pos, axis=1), fp[:, None] + np.cumsum(neg, axis=1)
            lost += (pos * (2 * fps - neg)).sum(axis=1)
            step += (pos * (tps / np.maximum(1, tps + fps))).sum(axis=1)
            tp, fp = tps[:, -1], fps[:, -1]
        return found[["model_name", "block", *total]].assign(lost=[lost.tobytes()], step=[step.tobytes()])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        hit_pos, hit_neg, pos, neg = (np.sum([np.frombuffer(x, "<i8") for x in pdf[c]], axis=0) for c in total)
        lost, step = (np.sum([np.frombuffer(x, "<f8") for x in pdf[c]], axis=0) for c in ("lost", "step"))
        reps = block_of(int(pdf["block"].iloc[0]), iterations)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = pd.DataFrame({"model_name": pdf["model_name"].iloc[0], "replicate": reps, "tn": neg - hit_neg, "fp": hit_neg, "fn": pos - hit_pos, "tp": hit_pos, "roc_auc": 1 - lost / (2.0 * pos * neg), "pr_auc": step / pos})
        return out[(pos > 0) & (neg > 0)]

    blobs = lambda *names: "".join(f", {n} binary" for n in names)
    by = ("model_name", "part", "block")
    spread = lambda df: df.repartition(few_tasks, *by).groupBy(*by)
    dealt = spread(rows).applyInPandas(totals, key + blobs(*total))
    known = dealt.groupBy("model_name", "block").applyInPandas(above, key + blobs(*total, "above_pos", "above_neg"))
    done = spread(rows).cogroup(spread(known)).applyInPandas(within, "model_name string, block int" + blobs(*total, "lost", "step"))
    counts = done.groupBy("model_name", "block").applyInPandas(together, "model_name string, replicate int, tn long, fp long, fn long, tp long, roc_auc double, pr_auc double")
    name = F.when(F.col("model_name") != "", F.substr("model_name", F.lit(2)))
    return rates(counts.withColumn("model_name", name))


def intervals(scored: DataFrame, threshold: float = 0.5, iterations: int = 2000, confidence: float = 0.95, seed: int = 42, metrics: tuple[str, ...] = (*RATES, *AREAS)) -> DataFrame:
    """(model_name, metric, lower, upper, n): percentiles of the replicates, and how many drew both classes.

    A model whose replicates never draw both classes has null ends and n = 0.
    """
    a = (1 - confidence) / 2
    models = scored.where("y_true is not null and y_prob is not null").where(~F.isnan("y_prob")).select("model_name").distinct()
    each = models.select("model_name", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    rows = replicates(scored, threshold, iterations, seed).select("model_name", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("v")).select("model_name", "v.*")
    ends = rows.groupBy("model_name", "metric").agg(F.percentile("value", F.array(F.lit(a), F.lit(1 - a))).alias("ends"), F.count("value").alias("n"))  # of at most iterations rows
    ends = ends.select(F.col("model_name").alias("model"), F.col("metric").alias("name"), "ends", "n")
    found = each.join(ends, F.col("model_name").eqNullSafe(F.col("model")) & (F.col("metric") == F.col("name")), "left")
    return found.select("model_name", "metric", F.col("ends")[0].alias("lower"), F.col("ends")[1].alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))
