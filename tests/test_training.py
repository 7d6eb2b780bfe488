"""The training job, its store, and the ungrouped trainer."""

import json
import shutil

import numpy as np
import pytest

from plumbline.operators import fitting, scoring
from plumbline.plans import training


def samples(spark, n=120):
    draw = np.random.default_rng(3)
    y = draw.integers(0, 2, n)
    df = spark.createDataFrame([(i, int(t), (draw.normal(size=4) + 2 * int(t)).tolist()) for i, t in enumerate(y)], "idx long, label int, x array<double>")
    split = spark.createDataFrame([(i, "test" if i % 6 == 0 else "val" if i % 6 == 1 else "train") for i in range(n - 6)], "idx long, split string")
    return df, split


def test_a_job_stores_model_description_and_history(spark, tmp_path):
    df, split = samples(spark)
    settings = {"name": "m1", "rounds": 30, "batch_size": 19, "rate": 0.5, "_comment": "not told", "early_stopping": {"enabled": True, "patience": 3}, "reduce_rate": {"enabled": True, "patience": 1}}
    store = training.Store(spark, str(tmp_path))
    told = training.train_job(df, split, settings, store)
    kept = json.loads((tmp_path / "m1" / "metadata.json").read_text())
    assert kept == told and "_comment" not in kept["settings"] and kept["variants"] is None
    assert {s: sum(c.values()) for s, c in kept["data"].items()} == {"train": 76, "val": 19, "test": 19} and kept["validation"]["roc_auc"] > 0.9
    history = json.loads((tmp_path / "m1" / "history.json").read_text())
    assert set(history) == {"loss", "accuracy", "val_loss", "val_accuracy", "rate"} and len(history["loss"]) == kept["run"]["rounds"]
    assert history["val_loss"][kept["run"]["best_round"] - 1] == min(history["val_loss"])
    fresh = training.Store(spark, str(tmp_path))
    model = fresh.get("m1")
    assert fresh.get("m1") is model and scoring.scored_with(model, df, "m1", features="x").count() == df.count()
    with pytest.raises(KeyError):
        fresh.get("none")
    (tmp_path / "bad" / "model").mkdir(parents=True)
    with pytest.raises(OSError):
        fresh.get("bad")


def test_settings_are_carried_out_or_refused(spark, tmp_path):
    df, split = samples(spark)
    store = training.Store(spark, str(tmp_path))
    base = {"name": "a", "kind": "logistic", "rounds": 20}
    jobs = {w: training.train_job(df, split, base | {"name": f"w{i}", "class_weight": w if w != "map" else {"0": 1, "1": 20}}, store) for i, w in enumerate(("balanced", "none", "map"))}
    assert jobs["none"]["class_weight"] is None and jobs["map"]["class_weight"] == {"0": 1.0, "1": 20.0}
    mean = [scoring.scored_with(store.get(f"w{i}"), df, "m", features="x").agg({"y_prob": "avg"}).first()[0] for i in range(3)]
    assert mean[2] > mean[1] + 0.01 and mean[2] > mean[0] + 0.01
    for bad in ({"early_stopping": {"enabled": True}}, {"augmentation": {"enabled": True}}, {"kind": "softmax", "augmentation": {"enabled": True}}, {"kind": "softmax", "profile": "legacy_64", "augmentation": {"enabled": True}}):
        with pytest.raises(ValueError):
            training.train_job(df, split, base | bad, store)
    with pytest.raises(KeyError):
        training.train_job(df, split, base | {"kind": "forest"}, store)


def test_a_job_trains_on_variants(spark, tmp_path, monkeypatch):
    """Images of 4 x 4 pixels; the variants of an epoch are made while its batches are read."""
    monkeypatch.setitem(training.PROFILES, "tiny", (4, "unit"))
    draw = np.random.default_rng(4)
    y = draw.integers(0, 2, 60)
    x = np.clip(draw.normal(0.4 + 0.2 * y[:, None], 0.1, (60, 48)), 0, 1)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(60)], "idx long, label int, x array<double>")
    split = spark.createDataFrame([(i, "val" if i % 4 == 0 else "train") for i in range(60)], "idx long, split string")
    store = training.Store(spark, str(tmp_path))
    base = {"name": "plain", "rounds": 2, "batch_size": 45, "profile": "tiny"}
    vary = {"enabled": True, "copies": 2, "horizontal_flip": True, "rotation_range": 10, "zoom_range": 0.1, "width_shift_range": 0.25}
    training.train_job(df, split, base, store)
    told = training.train_job(df, split, base | {"name": "varied", "augmentation": vary}, store)
    again = training.train_job(df.repartition(5), split, base | {"name": "again", "augmentation": vary}, store)
    assert told["variants"] == {"copies": 2, "changes": ["flip", "degrees", "zoom", "shift", "brightness"]} == again["variants"]
    models = {n: store.get(n) for n in ("plain", "varied", "again")}
    assert np.allclose(models["varied"].weights, models["again"].weights, atol=1e-9) and not np.allclose(models["plain"].weights, models["varied"].weights)
    assert np.allclose(models["plain"].mean, models["varied"].mean)
    change = fitting.pixel_variation(4, 42, {"augmentation": vary})
    keys = np.arange(60)
    assert (change(x, keys, 1) == change(x[::-1], keys[::-1], 1)[::-1]).all() and not (change(x, keys, 1) == change(x, keys, 2)).all()


def test_an_overwritten_model_is_loaded_anew(spark, tmp_path):
    df, split = samples(spark)
    writer, reader = training.Store(spark, str(tmp_path)), training.Store(spark, str(tmp_path))
    assert reader.refresh() == {}
    for name in ("one", "two"):
        training.train_job(df, split, {"name": name, "rounds": 1}, writer)
    assert reader.refresh() == {"one": "added", "two": "added"}
    one, two = reader.get("one"), reader.get("two")
    training.train_job(df, split, {"name": "one", "rounds": 2}, writer)
    assert reader.get("one") is one and reader.refresh() == {"one": "changed"} and reader.refresh() == {}
    assert not np.allclose(reader.get("one").weights, one.weights) and reader.get("two") is two
    training.train_job(df, split, {"name": "two", "kind": "logistic", "rounds": 2}, writer)
    assert reader.refresh() == {"two": "changed"} and reader.get("two") is not two
    shutil.rmtree(tmp_path / "one")
    assert reader.refresh() == {"one": "removed"}
    with pytest.raises(KeyError):
        reader.get("one")


def test_names_are_looked_up():
    assert training.profile_of("legacy_64")[0] == 64 and "Logistic" in training.kind_of_model("logistic") and "Softmax" in training.kind_of_model("softmax")
    for look_up in (training.profile_of, training.kind_of_model):
        with pytest.raises(KeyError, match="known"):
            look_up("other")
    base = {"name": "a", "augmentation": {"enabled": True}}
    got = training.overridden(base, rounds=3, seed=1, augment=False, name="b")
    assert got == {"name": "b", "rounds": 3, "seed": 1, "augmentation": {"enabled": False}} and base["augmentation"]["enabled"]
    assert training.overridden(base) == base


def test_the_ungrouped_trainer(spark, image_folder):
    got = training.ungrouped_trainer(spark, image_folder, ["benign", "malignant"])
    cells = got["confusion"].first()
    assert sum(cells[c] for c in ("tn", "fp", "fn", "tp")) == got["scored"].count() > 0
    assert got["roc"].count() >= 2
