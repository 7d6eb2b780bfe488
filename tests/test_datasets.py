import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import images as kernels
from plumbline.functions import scalar
from plumbline.operators import compare, duplicates, fitting, graph, predlog, profile, scoring, splitting
from plumbline.plans import bundles
from plumbline.sources import artifacts, images
from plumbline.sources import images as sources
from plumbline.streaming import predlog as stream


def test_manifest(spark, image_folder):
    m = images.discover(spark, image_folder, ["benign", "malignant"])
    rows = m.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(25)) and [r["label"] for r in rows] == [0] * 12 + [1] * 13
    assert rows[0]["stem"] == "benign0_0" and len(rows[0]["mask_paths"]) == 2 and rows[0]["group_id"] == "benign/benign0_0"
    assert rows[1]["mask_paths"] == []
    with pytest.raises(FileNotFoundError, match="normal"):
        images.discover(spark, image_folder, ["benign", "normal"])
    assert images.class_folders(spark, image_folder, ["benign"]).first()["folder"].endswith("/benign")


def test_features_and_report(spark, image_folder):
    m = images.discover(spark, image_folder, ["benign", "malignant"])
    f = images.features(images.images(spark, image_folder))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in f.collect()}
    assert rows["broken.png"]["width"] is None and rows["broken.png"]["properties"] is None
    one = rows["benign0_0.png"]
    assert (one["width"], one["height"]) == (48, 48) and len(one["thumbnail"]) == 1024 and 50 < one["properties"]["mean_intensity"] < 90
    s = m.join(f.select("path", "thumbnail", "properties.mean_intensity"), "path").withColumn("content", F.col("path"))
    got = bundles.dataset_report(s, ["mean_intensity"], "thumbnail", 0.8)
    audit = got["audit"].first()
    assert audit["n_samples"] == 25 and audit["n_clusters"] == 13 and audit["multi_member_clusters"] == 12
    assert got["shared_groups"].count() == 0 and got["shortcuts"].first()["concern"]
    assert all(r["leakage"] == 0 for r in got["leakage"].collect())
    split = got["split"]
    assert split.count() == 25 and split.select("split", "label").distinct().count() == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = dict(graph.components(df).collect())
    assert len(got) == 204 and set(got[i] for i in range(201)) == {0} and got[502] == 500
    nodes = spark.createDataFrame([(i,) for i in (*range(201), 300, 500, 501, 502)], "idx long")
    ids = dict(graph.cluster_ids(nodes, df).collect())
    assert ids[200] == 0 and ids[300] == 1 and ids[501] == 2
    assert graph.components(df.where("false")).count() == 0


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(0, b"a"), (1, b"b"), (2, b"a"), (3, None), (4, b"")], "idx long, content binary")
    assert [(r["n"], r["first_key"]) for r in duplicates.exact_duplicate_groups(df, "content").collect()] == [(2, 0)]
    assert {r["key"] for r in duplicates.duplicate_members(df, "content").collect()} == {0, 2}


def test_correlation_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 16)
    draw = np.random.default_rng(3)
    v = draw.normal(size=(60, 12))
    v[10] = v[3] * 2 + 1
    v[40] = 5.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>")
    c = np.corrcoef(np.where(np.arange(60)[:, None] == 40, draw.normal(size=(60, 12)), v))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if c[i, j] > 0.5 and 40 not in (i, j)}
    assert {(r["i"], r["j"]) for r in duplicates.correlated_pairs(df, 0.5).collect()} == want and (3, 10) in want


def groups(spark, n=40):
    return spark.createDataFrame([(i, f"p{i}", f"g{i // 3}", i // 3 % 2) for i in range(n * 3)], "idx long, path string, group_id string, label int")


def test_splits(spark):
    s = groups(spark)
    a = splitting.train_val_test_split(s)
    counts = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert sum(counts.values()) == 120 and counts["test"] == pytest.approx(120 / 7, abs=4)
    assert splitting.groups_in_two_splits(a).count() == 0
    assert a.select("split", "label").distinct().count() == 6
    assert sorted(a.collect()) == sorted(splitting.train_val_test_split(s).collect())
    with pytest.raises(ValueError, match="sum"):
        splitting.train_val_test_split(s, 0.5, 0.1, 0.1)
    with pytest.raises(ValueError, match="too few"):
        splitting.group_folds(s.where("idx < 6"), 5).count()
    assert splitting.naive_split(s).where("split = 'test'").count() == 24


def fold_table(df):
    """{fold: {label: n}}"""
    out = {}
    for r in df.groupBy("fold", "label").count().collect():
        out.setdefault(r["fold"], {})[r["label"]] = r["count"]
    return out


@pytest.mark.parametrize("n", [40, 120_000])
def test_folds_are_even_at_any_number_of_groups(spark, n):
    g = F.floor(F.col("id") / 3)
    f = splitting.group_folds(spark.range(3 * n).select(F.col("id").alias("idx"), F.concat(F.lit("g"), g.cast("string")).alias("group_id"), (g % 5 == 0).cast("int").alias("label")), 4)
    assert f.count() == 3 * n and f.select("group_id", "fold").distinct().count() == n
    got = fold_table(f)
    for label, of in ((1, 3 * (n // 5)), (0, 3 * n - 3 * (n // 5))):
        assert all(abs(x[label] - of / 4) <= 3 for x in got.values())


def test_a_large_group_leaves_its_fold_little_else(spark):
    rows = [("big", i % 2) for i in range(400)] + [(f"g{i}", i % 2) for i in range(300)] + [(f"h{i // 200}", 1) for i in range(400)] + [("odd", None), ("none", 0)]
    s = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "idx long, group_id string, label int")
    f = splitting.group_folds(s, 3, seed=1)
    sizes = {r["fold"]: r["count"] for r in f.groupBy("fold").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) <= 520
    assert f.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert sorted(f.collect(), key=str) == sorted(splitting.group_folds(s.repartition(7), 3, seed=1).collect(), key=str)
    assert f.select("group_id", "fold").distinct().exceptAll(splitting.group_folds(s, 3, seed=2).select("group_id", "fold").distinct()).count() > 0


def test_ten_classes_in_ranges_of_ranges(spark, monkeypatch):
    """Nearly every group has class counts of its own, and no step sees more than RANGE groups or ranges."""
    monkeypatch.setattr(splitting, "RANGE", 32)
    draw = np.random.default_rng(8)
    n, share = 4000, draw.dirichlet(np.ones(10))
    rows = [(f"g{g}", int(c)) for g in range(n) for c in draw.choice(10, size=1 + draw.integers(0, 9), p=share)] + [(None, 3)] * 5 + [("odd", None)]
    s = spark.createDataFrame(rows, "group_id string, label int").repartition(4)
    f = splitting.group_folds(s, 5, seed=3).cache()
    assert f.count() == len(rows) and f.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    got = fold_table(f)
    assert set(got) == set(range(5))
    for c in range(10):
        each = [x.get(c, 0) for x in got.values()]
        assert max(each) - min(each) <= 12, (c, each)
    again = splitting.group_folds(s.repartition(9), 5, seed=3)
    assert f.select("group_id", "fold").distinct().exceptAll(again.select("group_id", "fold").distinct()).count() == 0
    f.unpersist()


def test_a_range_s_bins_go_to_different_folds():
    draw = np.random.default_rng(3)
    bins = draw.integers(0, 9, (50, 4, 3)).astype(float)
    folds = splitting.matched(bins)
    assert (np.sort(folds, axis=1) == np.arange(4)).all()
    held = np.zeros((4, 3))
    for f, b in zip(folds, bins):
        held[f] += b
    assert np.ptp(held, axis=0).max() <= 9  # no more than one range alone may differ by
    assert len(splitting.deal(np.zeros((0, 2)), 3)) == 0


def log_rows(spark, first, n):
    """Log rows without ids; their times fall, so the last is the oldest."""
    return spark.range(first, first + n).select(F.timestamp_seconds(F.lit(10**6) - F.col("id")).alias("created_utc"), F.lit("m").alias("model_name"), F.lit("benign").alias("predicted_label"), F.lit(0.2).alias("probability_positive"), F.lit(0.8).alias("confidence"), F.lit("moderate").alias("confidence_band"), F.col("id").cast("double").alias("inference_ms"), F.col("id").cast("string").cast("binary").alias("thumbnail_jpeg"))


def test_log_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(predlog, "ROWS_A_FILE", 4)
    path = str(tmp_path / "log")
    log = predlog.Log(spark, path, most_rows=15)
    assert log.rows().count() == 0 and log.page().count() == 0 and log.row(1).count() == 0 and log.clear() == 0
    assert log.append(log_rows(spark, 0, 10).repartition(3), "one") == 10
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = files()
    assert log.append(log_rows(spark, 10, 7), "two") == 7 and log.append(log_rows(spark, 10, 7), "two") == 0 and log.append(log_rows(spark, 0, 0), "none") == 0
    assert before.items() <= files().items()  # an append rewrites nothing old
    assert sorted(r["id"] for r in log.rows().collect()) == list(range(3, 18))  # the newest 15 of 17
    assert [r["inference_ms"] for r in log.rows().where("id <= 10").orderBy("id").collect()] == [7, 6, 5, 4, 3, 2, 1, 0]  # ids follow time
    assert [r["id"] for r in log.page(5, 2).collect()] == [15, 14, 13, 12, 11] and [r["id"] for r in log.page(50, 12).collect()] == [5, 4, 3]
    assert log.page(-1).count() == 0 and log.page(50, 99).count() == 0 and "thumbnail_jpeg" not in log.page().columns
    one = log.row(9)
    assert len(one.inputFiles()) == 1 and one.first()["thumbnail_jpeg"] == b"1" and predlog.thumbnail(one, 9).count() == 1
    assert log.row(2).count() == 0 and log.row(18).count() == 0
    assert {r["kind"] for r in predlog.summary(log.rows()).collect()} == {"total", "label", "band"}
    assert '"label":"benign"' in bundles.prediction_reports(log.rows()).first()["report"] and "Label: benign" in bundles.report_text(log.rows()).first()["text"]
    assert log.append(log_rows(spark, 20, 9), "three") == 9 and [s.first for s in log.segments()] == [11, 18]  # the oldest segment went whole
    assert sorted(r["id"] for r in predlog.Log(spark, path, 15).rows().collect()) == list(range(12, 27))
    (tmp_path / "log" / "_unfinished-ab").mkdir()
    assert len(log.segments()) == 2 and log.clear() == 15 and log.rows().count() == 0
    assert log.append(log_rows(spark, 0, 1), "one") == 1 and log.row(1).count() == 1


def test_log_as_a_stream(spark, tmp_path):
    source = tmp_path / "source"
    log_rows(spark, 0, 5).write.parquet(str(source))
    log = predlog.Log(spark, str(tmp_path / "log"))
    for _ in range(2):
        stream.append_stream(spark.readStream.schema(log_rows(spark, 0, 1).schema).parquet(str(source)), log, str(tmp_path / "check")).awaitTermination()
    assert [r["id"] for r in log.page().collect()] == [5, 4, 3, 2, 1]
    shutil.rmtree(tmp_path / "check" / "commits")  # the batch runs again
    stream.append_stream(spark.readStream.schema(log_rows(spark, 0, 1).schema).parquet(str(source)), log, str(tmp_path / "check")).awaitTermination()
    assert log.rows().count() == 5


def test_appended_and_retained_rows(spark):
    row = lambda i, ms: (i, None, "m", False, "benign", 0.2, 0.8, "moderate", 0.5, None, None, None, ms, False, None, None)
    log = spark.createDataFrame([row(i, float(i)) for i in range(1, 8)], predlog.SCHEMA)
    more = spark.createDataFrame([row(0, 1.0), row(0, 2.0)], predlog.SCHEMA).withColumn("created_utc", F.timestamp_seconds(F.col("inference_ms"))).drop("id")
    kept = predlog.appended(log, more, 5)
    assert sorted(r["id"] for r in kept.collect()) == [5, 6, 7, 8, 9]
    assert [r["id"] for r in predlog.page(predlog.retained(kept, 2)).collect()] == [9, 8] and predlog.page(kept, -1).count() == 0


def test_images_are_predicted_and_logged(spark, image_folder, tmp_path):
    seen = sources.images(spark, image_folder)
    readable = seen.where("data is not null").count()
    draw = np.random.default_rng(1)
    model = fitting.Softmax(np.zeros(64 * 64 * 3), np.ones(64 * 64 * 3), draw.normal(size=(64 * 64 * 3 + 1, 2)))
    log = predlog.Log(spark, str(tmp_path / "log"))
    some = seen.where("data is not null").select("path").limit(3)
    how = dict(model=model, model_name="m1", profile="legacy_64", log=log, classes=["benign", "malignant"], threshold=0.4, explained=some)
    rows = scoring.predict_and_log(seen, batch="first", **how).collect()
    assert len(rows) == readable and sorted(r["id"] for r in rows) == list(range(1, readable + 1)) and sum(r["had_explanation"] for r in rows) == 3
    pixels = {r["path"].split("/")[-1]: np.array(r["x"], float) for r in sources.preprocessed(seen, "legacy_64").collect()}
    for r in rows:
        p = model(pixels[r["original_filename"]][None])[0]
        assert r["probability_positive"] == pytest.approx(p[1]) and r["confidence"] == pytest.approx(p.max())
        assert r["predicted_label"] == ("malignant" if p[1] >= 0.4 else "benign") and r["inference_ms"] > 0
        assert kernels.decoded(r["thumbnail_jpeg"]).shape[:2] == (r["image_height"], r["image_width"])
    assert scoring.predict_and_log(seen, batch="first", **how).count() == 0 and log.rows().count() == readable


def test_validation(spark):
    good = b"\x89PNG\r\n\x1a\nxx"
    rows = [("", good), ("a.exe", good), ("a.png", b""), ("a.png", b"x" * 30), ("a.png", b"echo hi"), ("a.PNG", good), ("a", good), (None, good), ("b.bmp", b"BM")]
    df = spark.createDataFrame(rows, "name string, payload binary")
    got = [r[0] for r in df.select(scalar.validation_error(F.col("payload"), F.col("name"), 20)).collect()]
    assert got == ["missing filename", "extension not allowed", "empty file", "file too large", "not a supported image", None, "extension not allowed", "missing filename", None]


def test_labels_and_bands(spark):
    df = spark.createDataFrame([([0.3, 0.7],), ([0.6, 0.4],)], "p array<double>")
    assert [r[0] for r in df.select(scalar.chosen_label(F.col("p"), ["benign", "malignant"], "malignant", 0.5)).collect()] == ["malignant", "benign"]
    three = spark.createDataFrame([([0.5, 0.2, 0.3],)], "p array<double>")
    assert three.select(scalar.chosen_label(F.col("p"), ["a", "b", "c"], "b", 0.5)).first()[0] == "a"
    bands = spark.createDataFrame([(0.95,), (0.05,), (0.72,), (0.5,)], "p double").select(scalar.confidence_band(F.col("p"))).collect()
    assert [b[0] for b in bands] == ["high", "high", "moderate", "low"]
    assert df.select(scalar.base64_uri(F.lit(b"x" * 100))).first()[0].count("\n") == 0


def test_profile_edges(spark):
    s = spark.createDataFrame([("a", 1, 5, 5, 10.0, ["m"]), ("a", 2, None, None, None, []), ("b", 3, None, None, None, None)], "class_name string, idx int, width int, height int, mean_intensity double, mask_paths array<string>")
    rows = {r["class_name"]: r for r in profile.class_summary(s).collect()}
    assert rows["a"]["count"] == 2 and rows["a"]["with_mask"] == 1 and rows["b"]["width_mean"] == 0 and rows["b"]["distinct_sizes"] == 0
    assert profile.shortcut_check(s, ["width"]).count() == 0
    assert profile.sample_per_class(s, 1, "idx").count() == 2
    assert profile.imbalance(s).first()["imbalance_ratio"] == 2


def test_comparison(spark):
    m = spark.createDataFrame([("a", 0.9, 0.85, 0.95), ("b", 0.9, 0.8, 0.84), ("c", None, None, None)], "model_name string, sensitivity double, lower double, upper double")
    assert compare.best_model(m).first()["model_name"] == "a"
    assert {r["model_name"]: r["overlaps"] for r in compare.interval_overlap(m).collect()} == {"b": False, "c": False}
    s = spark.createDataFrame([("a", 1, None), ("b", 1, 2)], "model_name string, seed int, epochs int")
    assert [r["key"] for r in compare.divergent_settings(s, ["seed", "epochs"]).collect()] == ["epochs"]
    assert compare.divergent_settings(s.limit(1), ["seed", "epochs"]).count() == 0
    ci = spark.createDataFrame([("a", "sensitivity", 0.85, 0.95)], "model_name string, metric string, lower double, upper double")
    table = bundles.comparison(m.select("model_name", "sensitivity"), ci, s, ["seed"], ["sensitivity"])["table"]
    assert {r["model_name"]: r["text"] for r in table.collect()} == {"a": "0.900 [0.850-0.950]", "b": "0.900", "c": "n/a"}


def test_artifacts(spark, tmp_path):
    (tmp_path / "evaluation").mkdir()
    (tmp_path / "evaluation" / "m1.json").write_text('{"name": "m1", "n": 3}')
    (tmp_path / "evaluation" / "m2.json").write_text("{broken")
    docs = artifacts.read_json(spark, str(tmp_path / "evaluation" / "*.json"), "name string, n int")
    assert docs.where("name = 'm1' and n = 3").count() == 1 and docs.where("name is null").count() >= 1
    assert artifacts.read_json(spark, str(tmp_path / "none"), "name string").count() == 0
    assert [r[0] for r in artifacts.evaluated_models(spark, str(tmp_path / "evaluation")).collect()] == ["m1", "m2"]
    names = spark.createDataFrame([("m1",), ("m3",)], "name string")
    found = artifacts.availability(names, docs.select("name", F.to_json(F.struct("n")).alias("document")), "run the evaluation")
    assert {r["name"]: r["available"] for r in found.collect()} == {"m1": True, "m3": False}
    meta = spark.createDataFrame([("m1", False)], "name string, legacy boolean")
    assert artifacts.model_catalog(names, meta, "old").count() == 3
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": 1}')
    (tmp_path / "top.json").write_text('{"a": {"y": 3}, "b": [1]}')
    assert artifacts.load_config(str(tmp_path), "top") == {"a": {"x": 1, "y": 3}, "b": [1]}


def test_kernels():
    draw = np.random.default_rng(5)
    g = draw.integers(0, 256, (40, 30)).astype(np.uint8)
    assert kernels.area_resize(g, 20, 15) == pytest.approx(g.reshape(20, 2, 15, 2).mean(axis=(1, 3)))
    assert kernels.thumbnail(np.full((50, 50), 9, np.uint8)).any() == False  # noqa: E712
    step = np.zeros((20, 20), np.uint8)
    step[:, 10:] = 200
    assert kernels.edges(step).any() and not kernels.edges(np.full((20, 20), 7)).any()
    assert kernels.laplacian(np.full((5, 5), 3)).any() == False  # noqa: E712
    bgr = draw.integers(0, 256, (40, 30, 3)).astype(np.uint8)
    x = kernels.preprocess(bgr, "standard_224")
    assert x.shape == (1, 224, 224, 3) and x.min() >= 0 and x.max() <= 1 and x.dtype == np.float32
    red = np.zeros((8, 8, 3), np.uint8)
    red[..., 2] = 255
    assert kernels.preprocess(red, "efficientnet_224")[0, 0, 0].tolist() == [255, 0, 0]
    assert (kernels.preprocess(bgr[..., :1], "efficientnet_224")[..., 0] == kernels.preprocess(bgr[..., :1], "efficientnet_224")[..., 2]).all()
    with pytest.raises(KeyError):
        kernels.preprocess(bgr, "nothing")
    assert (kernels.augmented(bgr, 3) == kernels.augmented(bgr, 3)).all() and kernels.augmented(bgr, 3).shape == bgr.shape
    heat, mask = np.zeros((16, 16)), np.zeros((16, 16))
    heat[4:8, 4:8], mask[4:8, 4:8] = 1, 255
    hit = kernels.mask_agreement(heat, mask, 90)
    assert hit["pointing_hit"] and hit["iou"] == 1 and hit["mask_coverage"] == 1 / 16 and not hit["degenerate"]
    mask[:] = 0
    mask[12:, 12:] = 255
    assert not kernels.mask_agreement(heat, mask)["pointing_hit"] and kernels.mask_agreement(np.zeros((4, 4)), mask)["degenerate"]


def test_images_in_rows(spark):
    from tests.conftest import png

    draw = np.random.default_rng(8)
    rgb = draw.integers(0, 256, (20, 24, 3)).astype(np.uint8)
    assert (kernels.decoded(png(rgb)) == rgb[:, :, ::-1]).all() and (kernels.decoded(png(rgb[:, :, 0]))[:, :, 0] == rgb[:, :, 0]).all()
    w = np.pad(rgb[::-1].reshape(20, 72), ((0, 0), (0, 0)))
    bmp = b"BM" + (54 + 72 * 20).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (24).to_bytes(4, "little") + (20).to_bytes(4, "little") + b"\x01\0\x18\0" + bytes(24) + w.tobytes()
    assert (kernels.decoded(bmp) == rgb).all() and kernels.decoded(b"\x89PNG\r\n\x1a\nxx") is None and kernels.decoded(None) is None
    rows = [("a.png", png(rgb)), ("b.png", png(rgb[:10])), ("c.png", b"\x89PNG\r\n\x1a\nrubbish"), ("d.jpg", b"\xff\xd8\xffxx"), ("e.txt", b"x"), ("f.bmp", bmp)]
    df = spark.createDataFrame(rows, "filename string, payload binary")
    assert [r["error"] for r in images.validated(df).orderBy("filename").collect()] == [None, "image too small", "cannot be decoded", "cannot be decoded", "extension not allowed", None]
    f = {r["filename"]: r for r in images.payload_features(df, "filename", "payload").collect()}
    assert f["a.png"]["width"] == 24 and f["c.png"]["thumbnail"] is None and f["a.png"]["properties"]["mean_intensity"] > 0


def test_scoring(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from plumbline.operators import evaluation, scoring

    draw = np.random.default_rng(9)
    y = draw.integers(0, 2, 200)
    df = spark.createDataFrame([(i, (draw.normal(size=3) + 2 * int(t)).tolist(), int(t)) for i, t in enumerate(y)], "idx long, features array<double>, label int")
    model, losses = scoring.train(df)
    assert losses[-1] < losses[0]
    s = scoring.scored(model, df, "logistic")
    assert evaluation.areas(s).first()["roc_auc"] > 0.95
    model.write().overwrite().save(str(tmp_path / "model"))
    assert scoring.scored(PipelineModel.load(str(tmp_path / "model")), df, "logistic").exceptAll(s).count() == 0
    other = scoring.scored_by(lambda: lambda x: 1 / (1 + np.exp(3 - x.sum(axis=1))), df, "sum")
    assert evaluation.areas(other).first()["roc_auc"] > 0.95
    p = scoring.predictions(s, ["benign", "malignant"])
    assert p.where("predicted_label = 'malignant' and probability_positive < 0.5").count() == 0 and p.count() == 200


def test_stream(spark, tmp_path):
    from plumbline.streaming import predlog as stream
    from tests.conftest import SMALL

    source = spark.readStream.schema(spark.read.parquet(f"{SMALL}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(SMALL)
    stream.keep_newest(source, str(tmp_path / "newest"), str(tmp_path / "check"), 50).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "newest" / "0")).count() == 50
    q = stream.windowed_summary(source).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from daily").first()[0] == spark.read.parquet(f"{SMALL}/events.parquet").count()


def clustered(draw, n_clusters, each, width):
    centres = draw.normal(size=(n_clusters, width))
    return np.concatenate([c + 0.05 * draw.normal(size=(each, width)) for c in centres])


def test_block_pairs_that_cannot_hold_a_pair_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "LEAST_BLOCK", 16)
    monkeypatch.setattr(duplicates, "BLOCK", 32)
    monkeypatch.setattr(duplicates, "TILE", 7)
    v = clustered(np.random.default_rng(4), 12, 50, 16)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    c = np.corrcoef(v)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if c[i, j] > 0.95}
    assert {(r["i"], r["j"]) for r in duplicates.correlated_pairs(df, 0.95).collect()} == want and len(want) > 10_000
    kept, total = duplicates.block_pairs(duplicates.standardised(df, "vec_id", "embedding"), 0.95)[2:]
    assert kept < total / 2
    links = duplicates.links_and_best(df, 0.95, 0.9, "vec_id", "embedding").collect()
    assert sum(r["best"] is None for r in links) < len(want) / 4  # forests, not all pairs
    best = {}
    for r in links:
        if r["best"] is not None:
            best[r["u"]] = max(r["best"], best.get(r["u"], -1))
    np.fill_diagonal(c, -1)
    assert best == pytest.approx({i: x for i, x in enumerate(c.max(axis=1)) if x > 0.9})
    got = dict(duplicates.near_duplicate_clusters(df, 0.95).collect())
    assert [got[i] for i in range(len(v))] == [i // 50 for i in range(len(v))]


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0, 3.0]), (1, [2.0, 4.0, 6.0]), (2, None), (5, []), (7, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in duplicates.near_duplicate_clusters(df).collect()) == [(1, 0), (2, 1), (3, 0), (5, 2), (7, 3)]
    assert duplicates.near_duplicate_clusters(df.where("false")).count() == 0 and duplicates.correlated_pairs(df.where("false")).count() == 0
    assert duplicates.near_duplicate_clusters(df.where("vec_id = 2")).count() == 1


def test_leakage_between_splits(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "LEAST_BLOCK", 8)
    monkeypatch.setattr(duplicates, "TILE", 5)
    v = clustered(np.random.default_rng(9), 10, 12, 16)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    test, train = df.where("vec_id % 5 = 0"), df.where("vec_id % 5 <> 0 and vec_id < 60")
    c = np.corrcoef(v)
    here, there = np.arange(0, 120, 5), np.array([i for i in range(60) if i % 5])
    best = c[np.ix_(here, there)].max(axis=1)
    got = {r["idx"]: r["best"] for r in duplicates.best_above(test, train, 0.9).collect()}
    assert got == pytest.approx({int(i): x for i, x in zip(here, best) if x > 0.9}) and len(got) > 5
    # training rows only meet blocks of test rows, and test rows those of training rows
    side = lambda rows, is_left: duplicates.standardised(rows, "vec_id", "embedding").withColumn("is_left", duplicates.F.lit(is_left))
    blocks, _, kept, total = duplicates.block_pairs(side(test, True).unionByName(side(train, False)), 0.9, sides=True)
    pairs = blocks.groupBy("lo", "hi").agg(duplicates.F.count_if("is_left").alias("left"), duplicates.F.count_if(~duplicates.F.col("is_left")).alias("right")).collect()
    assert 0 < len(pairs) <= kept <= total and all(r["left"] and r["right"] for r in pairs)
    leak = {r["threshold"]: r["leakage"] for r in duplicates.split_leakage(test, train, (0.9, 0.99)).collect()}
    assert leak == pytest.approx({t: (best > t).mean() for t in (0.9, 0.99)})
    # a row beside nothing but itself does not count; an empty side leaks nothing
    assert [r["leakage"] for r in duplicates.split_leakage(df.where("vec_id < 3"), df.where("vec_id = 1"), (0.5,)).collect()] == [1.0]
    assert [r["leakage"] for r in duplicates.split_leakage(test, train.where("false")).collect()] == [0.0] * 4
    assert [r["leakage"] for r in duplicates.split_leakage(test.where("false"), train).collect()] == [0.0] * 4


@pytest.mark.parametrize("kind", ["even", "clustered", "mixed"])
def test_bounds_inside_blocks_leave_out_most_products_and_no_pair(kind):
    draw = np.random.default_rng(11)
    n, d, least = 3000, 64, 0.95
    if kind == "even":  # spread evenly over the sphere: no cell and no tile lies apart
        v = draw.normal(size=(n, d))
        v[::50] = v[1::50] + 0.2 * draw.normal(size=(n // 50, d))
    elif kind == "clustered":
        v = clustered(draw, 60, 50, d)
    else:  # one large group of near copies among others
        v = np.concatenate((draw.normal(size=(n // 2, d)), draw.normal(size=d) + 0.2 * draw.normal(size=(n // 2, d))))
    v = v[draw.permutation(len(v))]
    m = (v - v.mean(axis=1, keepdims=True)) / v.std(axis=1, keepdims=True)
    m[7] = 0  # a constant vector
    full = m @ m.T / d
    for least in (0.95, 0.9):
        lead = duplicates.Lead.fit(m[: duplicates.FITTED], least)
        work = [0.0, 0.0]
        got = {(min(i, j), max(i, j)): c for u, w, cs in duplicates.near(m, np.arange(n), None, least, lead, work) for i, j, c in zip(u.tolist(), w.tolist(), cs.tolist())}
        i, j = np.nonzero(np.triu(full > least, 1))
        assert set(got) == set(zip(i.tolist(), j.tolist())) and len(got) > 20
        assert list(got.values()) == pytest.approx([full[k] for k in got])
        if kind != "mixed" and least == 0.95:
            assert work[0] < work[1] / 4
        left, right = np.arange(0, n, 3), np.arange(1, n, 3)
        both = {(i, j) for u, w, _ in duplicates.near(m, left, right, least, lead) for i, j in zip(u.tolist(), w.tolist())}
        assert both == {(i, j) for i, j in zip(*np.nonzero(full > least)) if i % 3 == 0 and j % 3 == 1}


def test_odd_widths_and_low_thresholds_are_multiplied_whole():
    draw = np.random.default_rng(12)
    m = draw.normal(size=(40, 5))
    for least in (-0.5, 0.3):
        lead = duplicates.Lead.fit(m, least)
        got = {(i, j) for u, w, _ in duplicates.near(m, np.arange(40), None, least, lead) for i, j in zip(u.tolist(), w.tolist())}
        c = m @ m.T / 5
        assert lead.k == 0 and {tuple(sorted(p)) for p in got} == {(i, j) for i in range(40) for j in range(i + 1, 40) if c[i, j] > least}
