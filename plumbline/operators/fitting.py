"""A classifier trained in mini-batches on the cluster, guided by validation.

The model is a softmax over standardised features. Rows are dealt once to the batches of an epoch, each a folder of a
written table, so a step reads its batch alone; an epoch takes the batches in a seeded order. Tasks add up their rows'
gradients, and their sums are added up in parts and then over the parts. After each epoch the loss on the validation rows
decides about stopping, the rate, and which weights are best.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.images import variation, varied
from plumbline.operators.profile import class_weights
from plumbline.tables import new_path

#: Rows that a task turns into a matrix at once hold about so many features; parts that partial sums are added up in first.
FEATURES, PARTS = 1 << 21, 64

#: Changes rows of features before they count: from (features [n, k], keys, a number that tells epochs and copies apart).
Vary = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


@dataclass
class Softmax:
    """Weights [k + 1, classes] over standardised features; the last row is the bias."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack(((x - self.mean) / self.deviation, np.ones(len(x))))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """[n, classes]: probabilities of rows of features."""
        z = self.standardised(x) @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def to_json(self) -> str:
        return json.dumps({"kind": "softmax"} | {k: getattr(self, k).tolist() for k in ("mean", "deviation", "weights")})

    @staticmethod
    def from_json(text: str) -> Softmax:
        got = json.loads(text)
        return Softmax(*(np.array(got[k], float) for k in ("mean", "deviation", "weights")))


@dataclass
class Guide:
    """What the monitored value after each epoch decides: whether it is the best, the rate, and whether to stop.

    Stopping: after patience epochs without a new least value. Rate: times factor, down to least_rate, after plateau epochs
    that did not fall by least_change below the least value that counted for this.
    """

    rate: float
    patience: int | None = None
    plateau: int | None = None
    factor: float = 0.5
    least_rate: float = 1e-7
    least_change: float = 1e-4
    best: float = field(default=float("inf"), init=False)
    waited: int = field(default=0, init=False)
    level: float = field(default=float("inf"), init=False)
    flat: int = field(default=0, init=False)

    def told(self, value: float) -> tuple[bool, bool]:
        """(new best, stop); NaN is never better."""
        better = value < self.best
        self.best, self.waited = (value, 0) if better else (self.best, self.waited + 1)
        if value < self.level - self.least_change:
            self.level, self.flat = value, 0
        else:
            self.flat += 1
            if self.plateau is not None and self.flat >= self.plateau and self.rate > self.least_rate:
                self.rate, self.flat = max(self.rate * self.factor, self.least_rate), 0
        return better, self.patience is not None and self.waited >= self.patience


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, features [n, width], classes and weights of a task's rows, some at a time."""
    rows = max(1, FEATURES // max(1, width))
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            x = b.column("x")
            off = np.asarray(x.offsets)
            yield b.column("key").to_numpy(), np.asarray(x.values)[off[0] : off[-1]].reshape(b.num_rows, -1).astype(float), b.column("y").to_numpy(), b.column("w").to_numpy()


def summed(rows: DataFrame, width: int, of: Callable[..., np.ndarray], shared: object = None) -> np.ndarray | None:
    """The sum over rows (key, x, y, w) of of(shared, keys, features, classes, weights), an array: added up within tasks,
    then in PARTS parts of them, then over the parts; None without rows."""
    sent = rows.sparkSession.sparkContext.broadcast(shared)  # a model: k features times the classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for some in matrices(batches, width):
            new = of(sent.value, *some)
            total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % PARTS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b) for b in t.column("sums").to_pylist()], axis=0)
        return pa.table({"part": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("key", "x", "y", "w").mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary")
    got = parts.groupBy("part").applyInArrow(add, "part int, sums binary").collect()  # one row
    sent.unpersist()
    return np.frombuffer(got[0]["sums"]) if got else None


def _losses(model: Softmax, keys: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted loss, loss, hits and rows, and the weights' sum."""
    p = model(x)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
    return np.array([(w * loss).sum(), loss.sum(), (p.argmax(axis=1) == y).sum(), len(y), w.sum()])


def fit(
    samples: DataFrame,
    split: str = "split",
    key: str = "idx",
    features: str = "features",
    label: str = "label",
    classes: int = 2,
    epochs: int = 50,
    batch_size: int = 32,
    rate: float = 0.1,
    momentum: float = 0.9,
    l2: float = 0.0,
    class_weight: str | dict | None = "balanced",
    patience: int | None = 10,
    plateau: int | None = 5,
    factor: float = 0.5,
    least_rate: float = 1e-7,
    restore_best: bool = True,
    monitor: str = "val_loss",
    seed: int = 42,
    vary: Vary | None = None,
    copies: int = 1,
) -> tuple[Softmax, dict[str, list[float]]]:
    """A model fitted on the rows whose split is train, and its history by epoch: loss, accuracy, val_loss, val_accuracy, rate.

    samples holds the split beside key, features (arrays of one length) and label (0 to classes - 1). Rows with a null
    feature array, label or split take no part, nor do test rows ever. The training loss is weighted by class as
    class_weight says ("balanced", a map, or none) and measured while the epoch runs; validation losses are unweighted and
    measured after it. A step reads one batch of about batch_size rows; a row's batch depends on seed and key alone, the
    order of batches on seed and epoch. With vary each training row is replaced in each epoch by so many copies of it, each
    changed anew while the batch is read; nothing of them is stored. Without validation rows the training loss is monitored; without training rows there is nothing to fit, which is an error.
    """
    spark = samples.sparkSession
    rows = samples.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), F.col(split).alias("split"))
    weights = class_weights(rows.where("split = 'train'"), "y", class_weight)
    by_class = {} if weights is None else {int(r["class_name"]): float(r["weight"] if r["weight"] is not None else 1.0) for r in weights.collect()}  # one row a class
    n = rows.where("split = 'train'").count()
    if not n:
        raise ValueError("no training rows")
    steps = max(1, -(-n // batch_size))
    weight = F.coalesce(*(F.when(F.col("y") == c, F.lit(w)) for c, w in by_class.items()), F.lit(1.0))
    batch = F.when(F.col("split") == "train", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(steps))).otherwise(-1).cast("int")
    path = new_path(spark, "batches")
    rows.where("split in ('train', 'val')").withColumn("w", weight).withColumn("batch", batch).repartition("batch", F.pmod(F.xxhash64("key"), F.lit(max(1, spark.sparkContext.defaultParallelism // steps)))).write.partitionBy("batch").parquet(path)
    table = spark.read.parquet(path).select("key", "x", "y", "w", "batch")
    train, val = table.where("batch >= 0"), table.where("batch = -1")
    width = train.select(F.size("x").alias("n")).first()["n"]
    # the deviation is measured around the mean, as a difference of large sums would lose it
    first = summed(train, width, lambda _, keys, x, y, w: np.concatenate(([len(x)], x.sum(axis=0))))
    mean = first[1:] / first[0]
    spread = summed(train, width, lambda m, keys, x, y, w: ((x - m) ** 2).sum(axis=0), mean)
    deviation = np.sqrt(spread / first[0])
    model = Softmax(mean, np.where(deviation > 1e-12, deviation, 1.0), np.zeros((width + 1, classes)))
    guide = Guide(rate, patience, plateau, factor, least_rate)
    history: dict[str, list[float]] = {c: [] for c in ("loss", "accuracy", "val_loss", "val_accuracy", "rate")}
    best, speed = model, np.zeros_like(model.weights)
    has_val = bool(val.limit(1).count())

    def gradient(epoch: int):
        def of(model: Softmax, keys: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            if vary is not None:
                x = np.concatenate([vary(x, keys, epoch * copies + c) for c in range(copies)])
                keys, y, w = (np.tile(a, copies) for a in (keys, y, w))
            p = model(x)
            told = _losses(model, keys, x, y, w)
            p[np.arange(len(y)), y] -= 1
            return np.concatenate((told, (model.standardised(x).T @ (p * w[:, None])).ravel()))

        return of

    for epoch in range(epochs):
        seen = np.zeros(5)
        for b in np.random.default_rng([seed, epoch]).permutation(steps).tolist():
            got = summed(table.where(F.col("batch") == b), width, gradient(epoch), model)
            if got is None:  # no key hashes to this batch
                continue
            seen += got[:5]
            decay = np.vstack((model.weights[:-1], np.zeros((1, classes))))
            speed = momentum * speed - guide.rate * (got[5:].reshape(model.weights.shape) / got[3] + l2 * decay)
            model = Softmax(model.mean, model.deviation, model.weights + speed)
        history["rate"].append(guide.rate)
        history["loss"].append(float(seen[0] / seen[3]))
        history["accuracy"].append(float(seen[2] / seen[3]))
        if has_val:
            told = summed(val, width, _losses, model)
            history["val_loss"].append(float(told[1] / told[3]))
            history["val_accuracy"].append(float(told[2] / told[3]))
        better, stop = guide.told(history[monitor if has_val or not monitor.startswith("val_") else "loss"][-1])
        if better:
            best = model
        if stop:
            break
    if not has_val:
        del history["val_loss"], history["val_accuracy"]
    return (best if restore_best else model), history


def pixel_variation(side: int, seed: int, settings: dict) -> Vary:
    """Random variants of square images of three channels, flattened by rows; a variant depends on seed, key and turn alone."""
    how = variation(settings)

    def vary(x: np.ndarray, keys: np.ndarray, turn: int) -> np.ndarray:
        images = x.reshape(len(x), side, side, 3)
        return np.stack([varied(image, np.random.default_rng([seed, turn, int(key) & (2**64 - 1)]), **how).ravel() for image, key in zip(images, keys)])

    return vary


def scored(model: Softmax, samples: DataFrame, model_name: str, key: str = "idx", features: str = "features", label: str = "label", positive: int = 1) -> DataFrame:
    """(model_name, case_id, y_true, y_prob): each row's probability of the positive class; rows without features have none."""
    sent = samples.sparkSession.sparkContext.broadcast(model)
    kind = dict(samples.dtypes)[key]
    rows = samples.where(F.col(features).isNotNull()).select(F.lit(model_name).alias("model_name"), F.col(key).alias("case_id"), F.col(label).cast("int").alias("y_true"), F.col(features).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x")
                off = np.asarray(x.offsets)
                p = sent.value(np.asarray(x.values)[off[0] : off[-1]].reshape(b.num_rows, -1))[:, positive]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p)], names=["model_name", "case_id", "y_true", "y_prob"])

    return rows.mapInArrow(run, f"model_name string, case_id {kind}, y_true int, y_prob double")


def save(spark: SparkSession, model: Softmax, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Softmax:
    return Softmax.from_json("".join(r["value"] for r in spark.read.text(path).collect()))  # one row
