"""Operators around images, reports, ingest and figures that SQL cannot express or that need files."""

import hashlib
import json
import statistics
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import images as kernels
from plumbline.functions import jpeg, scalar
from plumbline.operators import compare, errors, evaluation, profile
from plumbline.plans import bundles
from plumbline.sources import artifacts
from plumbline.sources import images as sources
from plumbline.tables import in_order, load
from tests.conftest import SMALL

CLASSES = ["benign", "malignant"]


def test_png_goes_there_and_back():
    draw = np.random.default_rng(1)
    for shape in ((5, 7, 1), (4, 9, 3), (3, 2, 4)):
        image = draw.integers(0, 256, shape, dtype=np.uint8)
        assert (kernels.decoded(kernels.png(image)) == image).all()
    assert kernels.decoded(kernels.png(np.array([[-3.0, 300.0]]))).ravel().tolist() == [0, 255]


def test_small_copies_never_grow():
    image = np.arange(200 * 50 * 3, dtype=np.uint32).reshape(200, 50, 3).astype(np.uint8)
    assert kernels.small_copy(image).shape == (128, 32, 3) and kernels.small_copy(image, 300) is image
    assert kernels.small_copy(np.zeros((1000, 1, 1), np.uint8)).shape == (128, 1, 1)
    flat = np.full((40, 60, 3), (10, 20, 30), np.uint8)
    assert (kernels.shown(flat, 30, 20) == (30, 20, 10)).all() and kernels.shown(flat, 30, 20).shape == (20, 30, 3)


def test_images_over_tables(spark, image_folder):
    seen = sources.images(spark, image_folder)
    readable = seen.where("data is not null")
    x = sources.preprocessed(seen, "legacy_64").collect()
    assert len(x) == readable.count() and all(len(r["x"]) == 64 * 64 * 3 for r in x)
    one = readable.first()
    own = kernels.preprocess(kernels.pixels(one["data"], one["height"], one["width"], one["channels"]), "legacy_64")
    assert np.allclose(next(r["x"] for r in x if r["path"] == one["path"]), own[0].ravel())
    with pytest.raises(KeyError):
        sources.preprocessed(seen, "no such profile")
    assert {(r["width"], r["height"], len(r["rgb"])) for r in sources.displayed(seen, 20, 10).collect()} == {(20, 10, 600)}
    copies = sources.small_copies(seen, 16).collect()
    assert {kernels.decoded(r["thumbnail_jpeg"]).shape[:2] for r in copies} == {(16, 16)} and len(copies) == readable.count()
    samples = sources.discover(spark, image_folder, CLASSES)
    split = samples.select("idx", F.when(F.col("idx") % 3 == 0, "train").otherwise("val").alias("split"))
    arrays = sources.split_arrays(samples, split, "train", seen, "standard_224").select("idx", "label", F.size("x").alias("n")).collect()
    want = {r["idx"]: r["label"] for r in samples.join(readable, "path").where("idx % 3 = 0").collect()}
    assert {r["idx"]: r["label"] for r in arrays} == want and {r["n"] for r in arrays} == {224 * 224 * 3}


def test_variants_of_the_train_split_only(spark, image_folder):
    seen, samples = sources.images(spark, image_folder), sources.discover(spark, image_folder, CLASSES)
    split = samples.select("idx", F.when(F.col("idx") < 6, "train").otherwise("test").alias("split"))
    made = sources.training_variants(samples, split, seen, 3)
    rows = made.collect()
    assert len(rows) == 18 and {r["idx"] for r in rows} == set(range(6)) and {r["variant"] for r in rows} == {0, 1, 2}
    assert len({bytes(r["data"]) for r in rows}) == 18 and all(len(r["data"]) == r["width"] * r["height"] * r["channels"] for r in rows)
    again = {(r["path"], r["variant"]): bytes(r["data"]) for r in sources.variants(seen.repartition(5), 3).collect()}
    assert all(again[r["path"], r["variant"]] == bytes(r["data"]) for r in rows)
    assert sources.variants(seen, 3, settings={"augmentation": {"enabled": False}}) is None
    still = sources.variants(seen, 1, settings={"augmentation": {"enabled": True, "horizontal_flip": False, "rotation_range": 0, "zoom_range": 0, "width_shift_range": 0}}).join(seen.select("path", F.col("data").alias("own")), "path")
    assert still.where(F.length("data") != F.length("own")).count() == 0


def test_augmentation_text():
    assert scalar.augmentation_text({}) == scalar.augmentation_text({"augmentation": {"zoom_range": 1}}) == {"enabled": False, "transforms": []}
    own = {"enabled": True, "horizontal_flip": True, "rotation_range": 15, "zoom_range": 0.1, "width_shift_range": 0, "brightness_range": [0.9, 1.1]}
    assert scalar.augmentation_text({"augmentation": own}) == {"enabled": True, "transforms": ["horizontal flip", "rotation by up to 15", "zoom by up to 0.1", "brightness from 0.9 to 1.1"]}


def test_scan_without_classes_and_its_audit(spark, image_folder):
    scan = sources.every_folder(sources.listing(spark, image_folder)).orderBy("idx").collect()
    assert [r["idx"] for r in scan] == list(range(len(scan))) and {r["label"] for r in scan} == {0} and {r["class_name"] for r in scan} == set(CLASSES)
    assert [(r["class_name"], r["path"]) for r in scan] == sorted((r["class_name"], r["path"]) for r in scan)
    got = bundles.unclassed_audit(spark, image_folder, 0.8)
    audit = got["audit"].first()
    assert audit["n_samples"] == len(scan) and audit["exact_groups"] == 1 and audit["exact_files"] == 2
    leaks = {r["threshold"]: r["leakage"] for r in got["naive_leakage"].collect()}
    assert leaks[0.9] >= leaks[0.99] and leaks[0.9] > 0


def test_ingest(spark, image_folder, tmp_path):
    files, folders = sources.listing(spark, image_folder), sources.class_folders(spark, image_folder, CLASSES)
    target = str(tmp_path / "busy")
    said = artifacts.ingested(spark, image_folder, target, folders, files, {"benign": 12, "malignant": 99})
    assert said["classes"] == {"benign": {"images": 12, "masks": 2, "expected": 12}, "malignant": {"images": 13, "masks": 0, "expected": 99}} and not said["as_expected"]
    assert json.loads((tmp_path / "busy" / "manifest.json").read_text()) == said
    assert len(list((tmp_path / "busy" / "benign").glob("*.png"))) == 14 and not list((tmp_path / "busy").glob("*/*.txt"))
    with pytest.raises(FileExistsError):
        artifacts.ingested(spark, image_folder, target, folders, files, {})
    (tmp_path / "busy" / "benign" / "old.png").write_bytes(b"old")
    assert artifacts.ingested(spark, image_folder, target, folders, files, {}, force=True)["as_expected"]
    assert not (tmp_path / "busy" / "benign" / "old.png").exists() and not list((tmp_path / "busy").glob("_arriving*"))
    sums = {(r["class_name"], r["name"]): r["sha256"] for r in spark.read.parquet(f"{target}/checksums.parquet").collect()}
    sources_of = {(p.parent.name, p.name): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(image_folder).glob("*/*.png")}
    assert sums == sources_of and all((Path(target) / c / n).read_bytes() == (Path(image_folder) / c / n).read_bytes() for c, n in sums)
    with pytest.raises(FileNotFoundError):
        artifacts.ingested(spark, image_folder, str(tmp_path / "none"), folders.where("false"), files, {})


def test_a_failed_copy_leaves_no_half_set(spark, image_folder, tmp_path, monkeypatch):
    files, folders = sources.listing(spark, image_folder), sources.class_folders(spark, image_folder, CLASSES)
    target = tmp_path / "set"
    sound = artifacts.copied

    def broken(raw, to):  # a task fails, or a copy differs
        return sound(raw, to).withColumn("same", ~F.col("path").endswith("benign1_0.png"))

    monkeypatch.setattr(artifacts, "copied", broken)
    with pytest.raises(OSError, match="benign1_0.png"):
        artifacts.ingested(spark, image_folder, str(target), folders, files, {})
    monkeypatch.setattr(artifacts, "copied", lambda raw, to: sound(raw, to).withColumn("size", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(OSError, match="stays as it was"):
        artifacts.ingested(spark, image_folder, str(target), folders, files, {})
    assert not list(target.glob("*"))
    monkeypatch.setattr(artifacts, "copied", sound)
    assert artifacts.ingested(spark, image_folder, str(target), folders, files, {})["classes"]["benign"]["images"] == 12


def test_reports_are_written(spark, tmp_path):
    scored = spark.createDataFrame([("m", i, i % 2, (i * 37 % 100) / 100, float(i)) for i in range(50)], "model_name string, case_id long, y_true int, y_prob double, size double")
    places = artifacts.write_reports(bundles.analyze(scored, properties=["size"]), str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in places] == sorted(["table", "categories", "separation", "abstention", "hardest", "properties"])
    rows = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/table").collect()]
    assert len(rows) == 50 and all("properties" not in r and r["confidence"] >= 0.5 for r in rows)
    again = artifacts.write_reports({"table": spark.createDataFrame([(1, None)], "a int, b string")}, str(tmp_path))
    assert [json.loads(r["value"]) for r in spark.read.text(again[0]).collect()] == [{"a": 1, "b": None}]
    artifacts.write_document(spark, {"b": [1, "é"], "a": None}, str(tmp_path / "index.json"))
    assert (tmp_path / "index.json").read_text() == '{\n  "b": [\n    1,\n    "é"\n  ],\n  "a": null\n}'


def test_medians_and_score_ranges(spark):
    draw = np.random.default_rng(2)
    values = {"a": draw.random(501).tolist(), "b": [0.0, 1.0, 1.0, 0.5], "c": [1 - 1e-12 * i for i in range(20)] + [0.0], "d": [0.25]}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None)], "k string, v double")
    assert {r["k"]: r["median"] for r in errors.medians(df, ["k"], "v").collect()} == {k: statistics.median(v) for k, v in values.items()}
    points = sorted([0.0, 1.0, 5e-324, 1e-300, 1 - 2**-53, 0.5, *draw.random(3000), *(draw.random(500) * 1e-9), *(1 - draw.random(500) * 1e-9)])
    parts = [r[0] for r in spark.createDataFrame([(float(x),) for x in points], "p double").select(evaluation.score_range(F.col("p"))).collect()]
    assert sorted(parts) == [p for _, p in sorted(zip(points, parts))]
    both = sorted(zip(points, parts))
    assert all(a[1] <= b[1] for a, b in zip(both, both[1:]))


def test_numbers_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), F.lit(1).alias("one")).repartition(9)
    got = in_order(df, ["x"], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(5000)) and [r["x"] for r in got] == sorted(r["x"] for r in got)
    assert in_order(df.where("false"), ["x"]).count() == 0


def test_modes_of_class_weights(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "class_name string")
    assert profile.class_weights(df, mode=None) is profile.class_weights(df, mode="none") is None
    assert {r["class_name"]: r["weight"] for r in profile.class_weights(df).collect()} == {"a": 0.75, "b": 1.5}
    assert {r["class_name"]: r["weight"] for r in profile.class_weights(df, mode={"b": 3}).collect()} == {"a": None, "b": 3.0}
    with pytest.raises(KeyError):
        profile.class_weights(df, mode="other")


def test_expressions_at_their_edges(spark):
    df = spark.createDataFrame([(0, '{"b": {"d": 1, "c": [2, {"z": 1, "a": 0}]}, "a": null}'), (2, "no json"), (None, None), (9, "[]")], "x int, j string")
    got = df.select(scalar.one_hot(F.col("x"), 3).alias("hot"), scalar.canonical_json(F.col("j")).alias("j"), scalar.binarised(F.col("x"), 2).alias("y")).collect()
    assert [r["hot"] for r in got] == [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0], None, None]
    assert got[0]["j"] == '{"a":null,"b":{"c":[2,{"a":0,"z":1}],"d":1}}' and got[1]["j"] is None and got[3]["j"] == "[]"
    assert [r["y"] for r in got] == [0, 1, None, 0]
    one = spark.createDataFrame([("m", {"a": "1"})], "model_name string, settings map<string, string>")
    assert compare.divergent_maps(one).count() == 0
    two = one.unionByName(spark.createDataFrame([("n", {"a": "1", "b": None})], one.schema))
    assert [(r["key"], r["n_values"]) for r in compare.divergent_maps(two).collect()] == []
    three = two.unionByName(spark.createDataFrame([("o", {"a": "2"})], one.schema))
    assert [(r["key"], r["n_values"]) for r in compare.divergent_maps(three).collect()] == [("a", 2)]


def test_error_rows_keep_the_case(spark):
    df = spark.createDataFrame([("m", 1, 1, 0.9, "a/b/c.png", "benign")], "model_name string, case_id long, y_true int, y_prob double, path string, class_name string")
    r = errors.error_table(df, carry=["path", "class_name"]).first()
    assert (r["path"], r["filename"], r["class_name"], r["category"]) == ("a/b/c.png", "c.png", "benign", "true_positive")


def test_samples_are_drawn_by_a_digest(spark):
    docs = load(spark, SMALL, "documents").select(F.col("source").alias("class_name"), "doc_id")
    a = sorted(profile.sample_per_class(docs, 3, "doc_id").collect())
    assert a == sorted(profile.sample_per_class(docs.repartition(7), 3, "doc_id").collect())
    assert a != sorted(profile.sample_per_class(docs, 3, "doc_id", 1).collect())


def java_image(spark, data, kind):
    """The bytes of an image in another format, as Java's own library writes it."""
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, kind, out)
    return bytes(out.toByteArray())


def waves(h, w):
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 90 * np.sin(x / 9)[:, :, None] * np.array([1, 0.5, -0.7]) + 50 * np.cos(y / 7)[:, :, None], 0, 255).astype(np.uint8)


def test_jpeg_against_another_library(spark):
    for h, w in ((48, 64), (37, 61), (9, 130)):
        image = waves(h, w)
        theirs = java_image(spark, kernels.png(image), "jpg")  # colour at half size
        ours = kernels.decoded(theirs).astype(int)
        back = kernels.decoded(java_image(spark, theirs, "png")).astype(int)
        assert ours.shape == back.shape == (h, w, 3) and np.abs(ours - back).mean() < 2 and np.abs(ours - image).mean() < 5
        read = kernels.decoded(java_image(spark, jpeg.encoded(image, 90), "png")).astype(int)  # ours, read by theirs
        assert np.abs(read - image).mean() < 2 and np.abs(read - kernels.decoded(jpeg.encoded(image, 90))).mean() < 1
    gray = waves(33, 20)[:, :, 0]
    assert np.abs(kernels.decoded(jpeg.encoded(gray))[:, :, 0].astype(int) - gray).mean() < 3
    noise = np.random.default_rng(1).integers(0, 256, (40, 24, 3), dtype=np.uint8)
    assert np.abs(kernels.decoded(jpeg.encoded(noise, 100)).astype(int) - noise).mean() < 1


def test_jpeg_faults_are_no_images():
    raw = jpeg.encoded(waves(40, 40))
    assert jpeg.frame(raw) == (40, 40, True) and kernels.sides(raw) == (40, 40)
    assert kernels.decoded(raw[:60]) is None and kernels.decoded(b"\xff\xd8\xffxx") is None and kernels.sides(raw[:60]) is None
    progressive = raw.replace(b"\xff\xc0", b"\xff\xc2", 1)
    assert kernels.decoded(progressive) is None and kernels.sides(progressive) == (40, 40)


def test_codes_stay_within_sixteen_bits():
    from collections import Counter

    lengths = jpeg.code_lengths(Counter({i: 2**i for i in range(40)}))
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
    table, codes = jpeg.codes_of(lengths)
    assert all(c != (1 << n) - 1 for c, n in codes.values()) and sum(table[:16]) == 40 == len(table) - 16
    assert jpeg.code_lengths(Counter({5: 1})) == {5: 1}


def scan_lines(p, bits, way):
    """PNG scan lines of [h, w, c] samples in one filter, written plainly."""
    h, w, c = p.shape
    if bits == 16:
        rows = p.astype(">u2").view(np.uint8).reshape(h, -1)
    elif bits == 8:
        rows = p.astype(np.uint8).reshape(h, -1)
    else:
        flat = p.reshape(h, -1)
        rows = np.packbits(np.unpackbits(flat.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits :].reshape(h, -1), axis=1)
    step, out = max(1, c * bits // 8), b""
    before = np.zeros(rows.shape[1], int)
    for row in rows.astype(int):
        left = np.concatenate((np.zeros(step, int), row))[: len(row)]
        corner = np.concatenate((np.zeros(step, int), before))[: len(row)]
        near = [min((l, u, k), key=lambda v, l=l, u=u, k=k: abs(l + u - k - v)) for l, u, k in zip(left, before, corner)]
        guess = {0: 0, 1: left, 2: before, 3: (left + before) // 2, 4: np.array(near)}[way]
        out += bytes([way]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    return out


def as_png(p, bits, kind, laced, way, palette=None):
    h, w, _ = p.shape
    if laced:
        data = b"".join(scan_lines(p[y::dy, x::dx], bits, way) for x, y, dx, dy in kernels.PASSES if p[y::dy, x::dx].size)
    else:
        data = scan_lines(p, bits, way)
    part = lambda n, d: len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([bits, kind, 0, 0, laced])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + (part(b"PLTE", palette.tobytes()) if palette is not None else b"") + part(b"IDAT", zlib.compress(data)) + part(b"IEND", b"")


@pytest.mark.parametrize("laced", [0, 1])
@pytest.mark.parametrize("way", range(5))
def test_png_of_every_kind(spark, laced, way):
    draw = np.random.default_rng(way)
    for bits, kind, c in ((8, 0, 1), (8, 2, 3), (8, 6, 4), (16, 2, 3), (16, 0, 1), (1, 0, 1), (2, 0, 1), (4, 0, 1)):
        p = draw.integers(0, 1 << bits, (11, 13, c))
        got = kernels.decoded(as_png(p, bits, kind, laced, way))
        want = p >> 8 if bits == 16 else p * (255 // ((1 << bits) - 1))
        assert (got == (want if c == 1 else want[:, :, [2, 1, 0, 3][:c]])).all(), (bits, kind)
    palette = draw.integers(0, 256, (16, 3), dtype=np.uint8)
    p = draw.integers(0, 16, (9, 10, 1))
    raw = as_png(p, 4, 3, laced, way, palette)
    assert (kernels.decoded(raw) == palette[p[:, :, 0]][:, :, ::-1]).all()
    assert (kernels.decoded(java_image(spark, raw, "bmp")) == kernels.decoded(raw)).all()
