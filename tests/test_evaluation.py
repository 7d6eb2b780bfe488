
import numpy as np
import pytest
from pyspark import TaskContext

from plumbline.functions.scalar import folds_for, format_metric
from plumbline.operators import bootstrap, errors, evaluation
from plumbline.plans import bundles

SCHEMA = "model_name string, case_id long, y_true int, y_prob double"


def cases(spark, y, p, name="m"):
    return spark.createDataFrame([(name, i, a, float(b)) for i, (a, b) in enumerate(zip(y, p))], SCHEMA)


def tabled(spark, **cells):
    """Cases whose confusion table at 0.5 has these cells: tp, fn, fp and tn."""
    sides = {"tp": (1, 0.75), "fn": (1, 0.25), "fp": (0, 0.625), "tn": (0, 0.125)}
    each = [sides[c] for c in sorted(cells) for _ in range(cells[c])]
    return cases(spark, [y for y, _ in each], [p for _, p in each])


def test_rates_follow_from_counts(spark):
    """The survey's two confusion tables with their rates, to as many digits as it states."""
    small = evaluation.point_metrics(tabled(spark, fn=2, fp=4, tn=6, tp=8)).first()
    assert [small[c] for c in ("tn", "fp", "fn", "tp")] == [6, 4, 2, 8]
    assert (small["sensitivity"], small["specificity"], small["balanced_accuracy"], small["npv"]) == pytest.approx((0.8, 0.6, 0.7, 0.75))
    assert small["precision"] == pytest.approx(2 / 3)
    large = evaluation.point_metrics(tabled(spark, fn=3, fp=1, tn=504, tp=492)).first()
    assert [round(large[c], 4) for c in ("accuracy", "specificity", "sensitivity", "precision", "f1")] == [0.996, 0.998, 0.9939, 0.998, 0.996]


def rank_auc(y, p):
    """The share of pairs of a positive and a negative that the scores order rightly, ties counting half."""
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))


def step_ap(y, p):
    """Precision at each distinct score, weighed by the positives that it adds."""
    return sum(((y == 1) & (p == v)).sum() * y[p >= v].mean() for v in np.unique(p)) / (y == 1).sum()


def test_areas(spark):
    assert evaluation.areas(cases(spark, [0, 0, 1, 1], [0, 0.1, 0.9, 1])).first()["roc_auc"] == 1
    assert evaluation.areas(cases(spark, [0, 0, 1, 1], [1, 0.9, 0.1, 0])).first()["roc_auc"] == 0
    one = evaluation.point_metrics(cases(spark, [0, 0], [0.2, 0.7])).first()
    assert one["roc_auc"] is None and one["pr_auc"] is None and one["sensitivity"] == 0 and one["precision"] == 0
    draw = np.random.default_rng(1)
    y, p = draw.integers(0, 2, 500), np.round(draw.random(500), 2)
    row = evaluation.areas(cases(spark, y.tolist(), p)).first()
    assert row["roc_auc"] == pytest.approx(rank_auc(y, p)) and row["pr_auc"] == pytest.approx(step_ap(y, p))


def test_bad_rows_are_left_out(spark):
    df = spark.createDataFrame([("m", 1, 1, 0.9), ("m", 2, None, 0.4), ("m", 3, 0, None), ("m", 4, 0, float("nan"))], SCHEMA)
    assert evaluation.confusion(df).first()["tp"] == 1 and evaluation.class_balance(df).first()["n"] == 1
    assert evaluation.confusion(df.where("false")).count() == 0


def test_calibration(spark):
    y, p = [0] * 100 + [1] * 100, [0.0] * 100 + [1.0] * 100
    assert evaluation.expected_calibration_error(cases(spark, y, p)).first()["ece"] == 0
    assert evaluation.expected_calibration_error(cases(spark, [0, 1] * 50, [0.99] * 100)).first()["ece"] > 0.4
    assert evaluation.calibration_bins(cases(spark, [1], [0.5])).count() == 10


def test_sweep_is_monotone_and_operating_point(spark):
    draw = np.random.default_rng(2)
    df = cases(spark, draw.integers(0, 2, 300).tolist(), draw.random(300))
    rows = evaluation.threshold_sweep(df).orderBy("threshold").collect()
    assert len(rows) == 101 and rows[0]["sensitivity"] == 1
    assert all(a["sensitivity"] >= b["sensitivity"] for a, b in zip(rows, rows[1:]))
    assert evaluation.operating_point(df, 0.95).first()["target_met"]
    none = evaluation.operating_point(cases(spark, [0, 0], [0.1, 0.9])).first()
    assert not none["target_met"] and none["threshold"] == 0


def plain_replicates(y, p, iterations, seed, threshold):
    """Each replicate by expanding every case as often as it is drawn."""
    order = np.lexsort((-y, -p))
    y, p = y[order], p[order]
    w = bootstrap.weights(seed, np.arange(iterations), np.arange(len(y))).astype(int)
    out = {}
    for r in range(iterations):
        ys, ps = np.repeat(y, w[r]), np.repeat(p, w[r])
        if len(set(ys.tolist())) == 2:
            hit = ps >= threshold
            out[r] = [int((hit & (ys == 1)).sum()), int((hit & (ys == 0)).sum()), rank_auc(ys, ps), step_ap(ys, ps)]
    return out


def test_replicates_equal_expanded_cases_at_any_partitioning(spark, monkeypatch):
    draw = np.random.default_rng(3)
    y = draw.integers(0, 2, 400)
    p = np.round(np.clip(draw.normal(0.4 + 0.2 * y, 0.2), -0.1, 1.1), 2)
    df = cases(spark, y.tolist(), p).unionByName(cases(spark, y[:9].tolist(), p[:9], "few")).unionByName(cases(spark, [1, 0, None], [0.7, 0.2, 0.9], None))
    got = bootstrap.replicates(df, 0.45, 300, 7).orderBy("model_name", "replicate").collect()
    for name, n in (("m", 400), ("few", 9)):
        want = plain_replicates(y[:n], p[:n], 300, 7, 0.45)
        mine = {r["replicate"]: [r["tp"], r["fp"], r["roc_auc"], r["pr_auc"]] for r in got if r["model_name"] == name}
        assert set(mine) == set(want) and (name == "m") == (len(want) == 300)
        for r in want:
            assert mine[r] == pytest.approx(want[r], abs=1e-12)
    assert {r["model_name"] for r in got} == {"m", "few", None}
    # labels with many cases of one score are drawn in runs
    monkeypatch.setattr(bootstrap, "SLICE", 3)
    monkeypatch.setattr(bootstrap, "SCORES", 5)
    again = bootstrap.replicates(df.repartition(7), 0.45, 300, 7).orderBy("model_name", "replicate").collect()
    assert [r[:6] for r in again] == [r[:6] for r in got]
    assert [r["pr_auc"] for r in again] == pytest.approx([r["pr_auc"] for r in got])


def test_draws_are_shared_by_tasks_however_few_rows_stand_for_them(spark, monkeypatch, tmp_path):
    plain = bootstrap.drawn

    def told(seed, replicates, starts, sizes):
        (tmp_path / f"{TaskContext.get().stageId()}-{TaskContext.get().partitionId()}").write_text(f"{sizes.max()}")
        return plain(seed, replicates, starts, sizes)

    monkeypatch.setattr(bootstrap, "drawn", told)
    df = spark.range(600_000).selectExpr("'m' AS model_name", "id AS case_id", "cast(id % 3 = 0 AS int) AS y_true", "0.5D AS y_prob")
    bootstrap.replicates(df, iterations=250).count()
    stages = [f.name.split("-")[0] for f in tmp_path.iterdir()]  # the runs of one score, told by the task that draws them
    assert len(stages) >= 3 and len(set(stages)) == 1
    # ranges close up, but not so far that a task has all cases
    monkeypatch.undo()
    many = spark.range(30_000).selectExpr("'m' AS model_name", "id AS case_id", "cast(id % 3 = 0 AS int) AS y_true", "(id % 100 + 1) / 200D AS y_prob")
    monkeypatch.setattr(bootstrap, "SCORES", 50)
    want = plain_replicates(*(np.array([r[i] for r in many.collect()]) for i in (2, 3)), 3, 42, 0.5)
    for r in bootstrap.replicates(many, iterations=3).collect():
        assert [r["tp"], r["fp"], r["roc_auc"], r["pr_auc"]] == pytest.approx(want[r["replicate"]], abs=1e-12)


def test_intervals(spark):
    df = tabled(spark, tp=40, tn=35, fp=10, fn=15)
    found = {r["metric"]: r for r in bootstrap.intervals(df).collect()}
    assert set(found) == {*evaluation.RATES, "roc_auc", "pr_auc"} and {r["n"] for r in found.values()} == {2000}
    point = evaluation.point_metrics(df).first()
    for m, r in found.items():
        assert r["lower"] < point[m] < r["upper"], m
    # the interval of a rate is about as wide as its binomial deviation says
    assert found["accuracy"]["upper"] - found["accuracy"]["lower"] == pytest.approx(2 * 1.96 * (0.75 * 0.25 / 100) ** 0.5, rel=0.08)
    assert found["sensitivity"]["upper"] - found["sensitivity"]["lower"] == pytest.approx(2 * 1.96 * (40 / 55 * 15 / 55 / 55) ** 0.5, rel=0.08)
    single = bootstrap.intervals(cases(spark, [0, 0], [0.1, 0.2]), iterations=5).collect()
    assert len(single) == 11 and all(r["n"] == 0 and r["lower"] is None for r in single)
    assert bootstrap.intervals(df.limit(0), iterations=5).count() == 0


def test_weights_are_poisson():
    w = bootstrap.weights(5, np.arange(200), np.arange(5000))
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.003)
    assert abs(np.corrcoef(w[:50].astype(float)) - np.eye(50)).max() < 0.07  # replicates are independent
    far = bootstrap.weights(5, np.arange(3), np.array([0, 2**32, 2**32 + 1, 2**40]))
    assert far.shape == (3, 4)
    assert (bootstrap.weights(5, np.arange(64), np.array([2**32])) != bootstrap.weights(5, np.arange(64), np.array([0]))).any()


def test_texts_and_folds():
    assert format_metric(0.8812, 0.795, 0.947) == "0.881 [0.795-0.947]"
    assert format_metric(0.5) == "0.500" and format_metric(float("nan")) == "n/a" and format_metric(None) == "n/a"
    assert [folds_for(x) for x in (0.15, 0.15 / 0.85, 0.5, 0.9)] == [7, 6, 2, 2]
    with pytest.raises(ValueError, match="between"):
        folds_for(1)


def test_errors(spark):
    df = tabled(spark, tp=3, tn=2, fp=1, fn=1).withColumn("width", (evaluation.F.col("case_id") * 2).cast("int"))
    table = errors.error_table(df, 0.5, None)
    assert {r["category"]: r["n"] for r in errors.category_counts(table).collect()} == {"true_positive": 3, "true_negative": 2, "false_positive": 1, "false_negative": 1}
    assert [r["n_covered"] for r in errors.abstention_curve(table).orderBy("cutoff").collect()][:1] == [7]
    assert errors.confidence_separation(table.where("correct")).count() == 0
    found = bundles.analyze(df.select("model_name", "case_id", "y_true", "y_prob"))
    assert found["hardest"].where("kind = 'most_confident_errors'").count() == 2


def test_bundle(spark):
    got = bundles.evaluate(tabled(spark, tp=8, tn=6, fp=4, fn=2), iterations=50)
    assert {k: v.count() for k, v in got.items()}["sweep"] == 101
    assert got["roc"].orderBy("fpr", "tpr").first()["threshold"] is None
