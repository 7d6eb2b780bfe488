"""The trainer guided by validation, against a plain loop over the same batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import fitting


def rows(spark, n=240, seed=3, noise=1.0):
    draw = np.random.default_rng(seed)
    y = draw.integers(0, 2, n)
    x = draw.normal(size=(n, 5)) * [1, 2, 3, 0.1, 1] + noise * y[:, None] * [1, 1, 0, 0.1, 0] + [0, 5, 0, 0, 1000]
    x[:, 2] = 7  # a constant feature
    split = np.where(np.arange(n) % 5 == 0, "val", np.where(np.arange(n) % 7 == 0, "test", "train"))
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), str(split[i])) for i in range(n)], "idx long, label int, features array<double>, split string")
    return df, x, y, split


def plain(df, x, y, split, epochs, batch_size, rate, momentum, l2, weights, seed, patience=None, plateau=None, factor=0.5):
    """One process, one loop; the batches are those that the keys are dealt to."""
    train = split == "train"
    steps = max(1, -(-int(train.sum()) // batch_size))
    batch = {r["idx"]: r["b"] for r in df.select("idx", F.pmod(F.xxhash64(F.lit(seed), "idx"), F.lit(steps)).alias("b")).collect()}
    batch = np.array([batch[i] for i in range(len(y))])
    mean, std = x[train].mean(axis=0), x[train].std(axis=0)
    z = np.column_stack(((x - mean) / np.where(std > 1e-12, std, 1), np.ones(len(x))))
    w, v, out = np.zeros((z.shape[1], 2)), 0, {"loss": [], "accuracy": [], "val_loss": [], "val_accuracy": [], "rate": []}
    best, best_w, waited, level, flat = np.inf, w, 0, np.inf, 0
    sample = np.array([weights.get(int(c), 1.0) for c in y])

    def probabilities(at):
        e = np.exp(z[at] @ w)
        return e / e.sum(axis=1, keepdims=True)

    for epoch in range(epochs):
        losses, hits, n = 0, 0, 0
        for b in np.random.default_rng([seed, epoch]).permutation(steps):
            at = np.flatnonzero(train & (batch == b))
            if not len(at):
                continue
            p = probabilities(at)
            losses -= (sample[at] * np.log(p[np.arange(len(at)), y[at]])).sum()
            hits, n = hits + (p.argmax(axis=1) == y[at]).sum(), n + len(at)
            p[np.arange(len(at)), y[at]] -= 1
            shrink = w.copy()
            shrink[-1] = 0
            v = momentum * v - rate * (z[at].T @ (p * sample[at][:, None]) / len(at) + l2 * shrink)
            w = w + v
        val = np.flatnonzero(split == "val")
        p = probabilities(val)
        out["rate"].append(rate)
        out["loss"].append(losses / n)
        out["accuracy"].append(hits / n)
        out["val_loss"].append(-np.log(p[np.arange(len(val)), y[val]]).mean())
        out["val_accuracy"].append((p.argmax(axis=1) == y[val]).mean())
        now = out["val_loss"][-1]
        if now < best:
            best, best_w, waited = now, w, 0
        else:
            waited += 1
        if now < level - 1e-4:
            level, flat = now, 0
        else:
            flat += 1
            if plateau and flat >= plateau:
                rate, flat = rate * factor, 0
        if patience and waited >= patience:
            break
    return best_w, out


def test_training_equals_a_plain_loop(spark):
    df, x, y, split = rows(spark)
    counts = np.bincount(y[split == "train"])
    balanced = {c: len(y[split == "train"]) / (2 * n) for c, n in enumerate(counts)}
    want, history = plain(df, x, y, split, 6, 40, 0.2, 0.9, 0.01, balanced, 42)
    model, got = fitting.fit(df, epochs=6, batch_size=40, rate=0.2, l2=0.01, patience=None, plateau=None)
    assert np.allclose(model.weights, want, atol=1e-9)
    assert set(got) == set(history) and all(np.allclose(got[c], history[c], atol=1e-9) for c in history)
    again, _ = fitting.fit(df.repartition(7), epochs=6, batch_size=40, rate=0.2, l2=0.01, patience=None, plateau=None)
    assert np.allclose(again.weights, model.weights, atol=1e-9)


def test_early_stopping_keeps_the_best_weights_and_a_plateau_cuts_the_rate(spark):
    df, x, y, split = rows(spark, 60, 5, 0.2)  # noise: the validation loss soon rises
    how = dict(epochs=40, batch_size=24, momentum=0.9, l2=0.0, seed=1)
    want, history = plain(df, x, y, split, rate=2.0, weights={}, patience=4, plateau=2, **how)
    model, got = fitting.fit(df, rate=2.0, class_weight=None, patience=4, plateau=2, **how)
    assert len(got["loss"]) == len(history["loss"]) < 40 and np.allclose(got["val_loss"], history["val_loss"], atol=1e-8)
    assert got["rate"][0] == 2.0 and got["rate"] == pytest.approx(history["rate"]) and got["rate"][-1] < 2.0
    best = int(np.argmin(got["val_loss"]))
    assert best < len(got["loss"]) - 1 and np.allclose(model.weights, want, atol=1e-8)
    last, _ = fitting.fit(df, rate=2.0, class_weight=None, patience=4, plateau=2, restore_best=False, **how)
    assert not np.allclose(last.weights, model.weights)


def test_settings_change_the_model(spark):
    df, *_ = rows(spark, 120)
    how = dict(epochs=2, batch_size=120)
    fits = {
        "plain": fitting.fit(df, class_weight=None, **how)[0],
        "given": fitting.fit(df, class_weight={0: 1.0, 1: 5.0}, **how)[0],
        "varied": fitting.fit(df, class_weight=None, vary=lambda x, keys, epoch: x + (keys[:, None] % 3 - 1) * (1 + epoch), **how)[0],
    }
    assert not np.allclose(fits["plain"].weights, fits["given"].weights) and not np.allclose(fits["plain"].weights, fits["varied"].weights)
    p = {k: np.mean([r["y_prob"] for r in fitting.scored(m, df, k).collect()]) for k, m in fits.items()}
    assert p["given"] > p["plain"]


def test_guide():
    g = fitting.Guide(1.0, patience=2, plateau=1, factor=0.1, least_rate=0.05)
    assert g.told(3.0) == (True, False) and g.told(2.99999) == (True, False) and g.rate == 0.1
    assert g.told(float("nan")) == (False, False) and g.rate == 0.05 and g.told(5.0) == (False, True) and g.rate == 0.05


def test_odd_rows_and_no_validation(spark, tmp_path):
    df, *_ = rows(spark, 60)
    odd = spark.createDataFrame([(900, None, [0.0] * 5, "train"), (901, 1, None, "train"), (902, 1, [0.0] * 5, None)], df.schema)
    model, history = fitting.fit(df.unionByName(odd), epochs=2)
    same, _ = fitting.fit(df, epochs=2)
    assert np.allclose(model.weights, same.weights, atol=1e-9)
    alone, history = fitting.fit(df.where("split = 'train'"), epochs=2)
    assert "val_loss" not in history and len(history["loss"]) == 2
    with pytest.raises(ValueError, match="no training rows"):
        fitting.fit(df.where("split = 'val'"))
    fitting.save(spark, model, str(tmp_path / "m"))
    loaded = fitting.load(spark, str(tmp_path / "m"))
    want = sorted(map(tuple, fitting.scored(model, df, "m").collect()))
    assert sorted(map(tuple, fitting.scored(loaded, df, "m").collect())) == want and len(want) == 60
