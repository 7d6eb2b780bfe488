"""Training as a job: settings, samples and a split in; a stored model with its description, history and evaluation out.

Two kinds of linear classifier can be trained over preprocessed pixels or any feature column: one by mini-batches that
validation guides (operators/fitting), one by spark.ml's solver. What the settings ask for is done or refused, never only
told. A store keeps each model in a folder of its own beside JSON documents on it, loads a model when it is first asked
for, and notices what was written since.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.images import PROFILES, variation
from plumbline.operators import evaluation, fitting, profile, scoring, splitting
from plumbline.sources import images as sources
from plumbline.sources.artifacts import write_document
from plumbline.tables import removed, written

#: Kinds of model that can be trained here, with what they are.
KINDS = {
    "softmax": "Softmax over standardised features, fitted in mini-batches and guided by validation.",
    "logistic": "Logistic regression on standardised features, fitted by spark.ml.",
}


def kind_of_model(name: str) -> str:
    """What a kind of model is; KeyError names the known ones."""
    if name not in KINDS:
        raise KeyError(f"unknown kind of model {name!r}; known: {', '.join(sorted(KINDS))}")
    return KINDS[name]


def profile_of(name: str) -> tuple[int, str]:
    """(side, normalisation) of a preprocessing profile; KeyError names the known ones."""
    if name not in PROFILES:
        raise KeyError(f"unknown profile {name!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, size, modified) of the models' files below folder, in folders by name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    below = F.regexp_extract("path", r"/([^/]+)/(model|softmax)/", 1)
    return files.withColumn("name", F.url_decode(F.regexp_replace(below, r"\+", "%2B"))).where("name <> ''").select("name", "path", "size", "modified")


def changed_models(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): models added, removed or changed between two snapshots, by files that one of them lacks."""
    parts = ["name", "path", "size", "modified"]
    touched = before.join(after, parts, "left_anti").select("name").unionByName(after.join(before, parts, "left_anti").select("name")).distinct()
    marked = touched.join(before.select("name").distinct().withColumn("was", F.lit(True)), "name", "left").join(after.select("name").distinct().withColumn("now", F.lit(True)), "name", "left")
    return marked.select("name", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


class Store:
    """Models by name below one folder: each is loaded when first asked for, and then kept until refresh() finds it changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.kept, self.seen = spark, folder.rstrip("/"), {}, None

    def _has(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _seen(self) -> DataFrame:
        empty = self.spark.createDataFrame([], "name string, path string, size long, modified timestamp")
        return written(snapshot(self.spark, self.folder) if self._has(self.folder) else empty, "models")

    def get(self, name: str) -> PipelineModel | fitting.Softmax:
        """The model; KeyError if there is none of that name, OSError if what is there is no model."""
        if name not in self.kept:
            if self.seen is None:
                self.seen = self._seen()
            at = f"{self.folder}/{name}"
            kind = next((k for k in ("softmax", "model") if self._has(f"{at}/{k}")), None)
            if kind is None:
                raise KeyError(f"no model {name!r} below {self.folder}")
            try:
                self.kept[name] = fitting.load(self.spark, f"{at}/softmax") if kind == "softmax" else PipelineModel.load(f"{at}/model")
            except Exception as fault:
                raise OSError(f"model {name!r} cannot be read") from fault
        return self.kept[name]

    def refresh(self) -> dict[str, str]:
        """{name: added, removed or changed} since the last look; changed and removed models are loaded anew when asked for."""
        now = self._seen()
        before, self.seen = self.seen, now
        found = {r["name"]: r["change"] for r in changed_models(now.limit(0) if before is None else before, now).collect()}  # a row a model
        for name in found:
            self.kept.pop(name, None)
        return found

    def save(self, name: str, model: PipelineModel | fitting.Softmax, description: dict, history: dict[str, list[float]]) -> str:
        """Write the model, metadata.json and history.json over what is there; the folder is returned."""
        at = f"{self.folder}/{name}"
        other = "model" if isinstance(model, fitting.Softmax) else "softmax"
        if self._has(f"{at}/{other}"):
            removed(self.spark, f"{at}/{other}")
        if isinstance(model, fitting.Softmax):
            fitting.save(self.spark, model, f"{at}/softmax")
        else:
            model.write().overwrite().save(f"{at}/model")
        write_document(self.spark, description, f"{at}/metadata.json")
        write_document(self.spark, history, f"{at}/history.json")
        self.kept[name], self.seen = model, self._seen()
        return at


def overridden(settings: dict, rounds: int | None = None, seed: int | None = None, augment: bool | None = None, name: str | None = None) -> dict:
    """settings with what a caller wants otherwise; settings are not changed."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in settings.items()}
    if rounds is not None:
        out["rounds"] = rounds
    if seed is not None:
        out["seed"] = seed
    if augment is not None:
        out.setdefault("augmentation", {})["enabled"] = augment
    if name is not None:
        out["name"] = name
    return out


def refused(settings: dict, width: int) -> str | None:
    """Why the settings cannot be carried out on features of that width; None if they can."""
    kind, wanted = settings.get("kind", "softmax"), lambda part: bool((settings.get(part) or {}).get("enabled"))
    if kind != "softmax" and (part := next((p for p in ("augmentation", "early_stopping", "reduce_rate") if wanted(p)), None)):
        return f"a model of kind {kind} cannot be trained with {part}"
    if wanted("augmentation"):
        if "profile" not in settings:
            return "augmentation needs the images' profile"
        side = profile_of(settings["profile"])[0]
        if width != side * side * 3:
            return f"augmentation needs images of {side} x {side} pixels as features, not {width} numbers"
    return None


def fitted(own: DataFrame, settings: dict, features: str) -> tuple[PipelineModel | fitting.Softmax, dict[str, list[float]]]:
    """The model that the settings ask for, from rows with their split, and its history by round."""
    rounds, weight = settings.get("rounds", 50), settings.get("class_weight", "balanced")
    if settings.get("kind", "softmax") == "logistic":
        model, losses = scoring.train(own.where("split = 'train'"), features, rounds=rounds, l2=settings.get("l2", 0.01), class_weight=weight)
        return model, {"loss": losses}
    stop, cut, vary = (settings.get(p) or {} for p in ("early_stopping", "reduce_rate", "augmentation"))
    seed = settings.get("seed", 42)
    return fitting.fit(
        own,
        features=features,
        epochs=rounds,
        batch_size=settings.get("batch_size", 32),
        rate=settings.get("rate", 0.1),
        momentum=settings.get("momentum", 0.9),
        l2=settings.get("l2", 0.01),
        class_weight=weight,
        patience=stop.get("patience", 10) if stop.get("enabled") else None,
        restore_best=stop.get("restore_best", True) if stop.get("enabled") else False,
        monitor=stop.get("monitor", "val_loss"),
        plateau=cut.get("patience", 5) if cut.get("enabled") else None,
        factor=cut.get("factor", 0.5),
        least_rate=cut.get("least_rate", 1e-7),
        seed=seed,
        vary=fitting.pixel_variation(profile_of(settings["profile"])[0], seed, settings) if vary.get("enabled") else None,
        copies=vary.get("copies", 1),
    )


def train_job(samples: DataFrame, split: DataFrame, settings: dict, store: Store, features: str = "x") -> dict:
    """Train on the train split of samples(idx, label, features), be guided by val, choose nothing on test, save and describe.

    Settings: name, kind, rounds, batch_size, rate, momentum, l2, seed, class_weight ("balanced", "none" or a map), profile;
    early_stopping (enabled, patience, restore_best, monitor), reduce_rate (enabled, patience, factor, least_rate) and
    augmentation (enabled, copies, and what variation() reads); what starts with _ is not told. Settings that the kind or
    the features do not allow are a ValueError. Returns the description that is stored.
    """
    kind = settings.get("kind", "softmax")
    about = kind_of_model(kind)
    own = written(splitting.split_samples(samples, split), "training")
    some = own.where(f"split = 'train' and {features} is not null").select(F.size(features).alias("width")).first()
    if (why := refused(settings, some["width"] if some else 0)) is not None:
        raise ValueError(why)
    began = time.time()
    model, history = fitted(own, settings, features)
    took = time.time() - began
    name = settings["name"]
    metrics = evaluation.point_metrics(scoring.scored_with(model, own.where("split = 'val'"), name, features=features)).first()
    weights = profile.class_weights(own.where("split = 'train'"), "label", settings.get("class_weight", "balanced"))
    counts = own.groupBy("split", "label").agg(F.count("*").alias("n")).collect()  # classes times splits
    vary = settings.get("augmentation") or {}
    spark = store.spark
    description = {
        "model": {"name": name, "kind": kind, "about": about, "features": some["width"], "profile": settings.get("profile")},
        "run": {
            "finished": datetime.now(timezone.utc).isoformat(timespec="seconds"),
            "seconds": round(took, 2),
            "rounds": len(history.get("rate", history["loss"][1:])),
            "best_round": min(range(len(v)), key=v.__getitem__) + 1 if (v := history.get("val_loss")) else None,
            "spark": spark.version,
            "parallelism": spark.sparkContext.defaultParallelism,
        },
        "data": {s: {str(r["label"]): r["n"] for r in counts if r["split"] == s} for s in sorted({r["split"] for r in counts})},
        "class_weight": {str(r["class_name"]): r["weight"] for r in weights.collect()} if weights is not None else None,
        "variants": {"copies": vary.get("copies", 1), "changes": [c for c, amount in variation(settings).items() if amount]} if vary.get("enabled") else None,
        "validation": {k: metrics[k] for k in ("accuracy", "sensitivity", "specificity", "roc_auc")} if metrics else None,
        "settings": {k: v for k, v in settings.items() if not k.startswith("_")},
    }
    store.save(name, model, description, history)
    return description


def ungrouped_trainer(spark: SparkSession, root: str, classes: list[str], seed: int = 0) -> dict[str, DataFrame]:
    """The audit's negative example: pixels at 64 x 64, a split by rows whatever their groups, a fit, and its flattering
    confusion table and ROC curve over the rows that were held out."""
    samples = sources.discover(spark, root, classes)
    pixels = sources.preprocessed(sources.images(spark, root), "legacy_64").select("path", "x")
    rows = written(samples.join(pixels, "path").select("idx", "label", "x"), "pixels")
    split = splitting.naive_split(rows.select("idx"), 0.2, seed)
    both = written(rows.join(split, "idx"), "ungrouped")
    model, _ = scoring.train(both.where("split = 'train'"), "x", rounds=10)
    scored = written(scoring.scored(model, both.where("split = 'test'"), "ungrouped", features="x"), "scored")
    return {"confusion": evaluation.confusion(scored), "roc": evaluation.roc_curve(scored), "scored": scored}
