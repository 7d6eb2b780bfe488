"""Heat maps, overlays and their agreement with masks against plain code."""

import numpy as np
import pytest

from plumbline.functions import images as kernels
from plumbline.operators import explain

LAYER = "path string, class_index int, height int, width int, activations array<float>, gradients array<float>"


def plain_heatmap(a, g, h, w):
    """Cell by cell and channel by channel."""
    c = len(a) // (h * w)
    weights = [sum(g[p * c + j] for p in range(h * w)) / (h * w) for j in range(c)]
    heat = [max(0.0, sum(a[p * c + j] * weights[j] for j in range(c))) for p in range(h * w)]
    peak = max(heat)
    return [x / peak if peak > 1e-12 else 0.0 for x in heat]


def rows_of(draw):
    out = []
    for i, (h, w, c) in enumerate([(2, 3, 4), (2, 3, 4), (5, 5, 1), (1, 1, 7), (2, 3, 2)] * 4):
        a, g = np.round(draw.normal(size=(2, h * w * c)), 3).astype(np.float32).astype(float)
        out.append((f"p{i}", i % 3, h, w, a.tolist(), g.tolist()))
    return out


def test_heatmaps_equal_plain_code(spark):
    rows = rows_of(np.random.default_rng(1))
    rows.append(("negative", 0, 1, 2, [1.0, 2.0], [-1.0, -1.0]))  # nothing speaks for the class
    got = {r["path"]: r for r in explain.heatmaps(spark.createDataFrame(rows, LAYER).repartition(3)).collect()}
    assert len(got) == len(rows)
    for path, c, h, w, a, g in rows:
        assert got[path]["heatmap"] == pytest.approx(plain_heatmap(a, g, h, w), abs=1e-12) and got[path]["class_index"] == c and got[path]["error"] is None
    assert got["negative"]["degenerate"] and got["negative"]["heatmap"] == [0.0, 0.0] and not got["p0"]["degenerate"]


def test_heatmaps_of_wrong_rows(spark):
    bad = [("a", 0, 1, 2, None, [1.0, 2.0]), ("b", 0, 1, 2, [1.0, 2.0], None), ("c", 0, 0, 2, [1.0], [1.0]), ("d", 0, 2, 2, [1.0] * 5, [1.0] * 5), ("e", 0, 1, 2, [1.0] * 4, [1.0] * 2), ("f", 0, 1, 1, [None], [1.0]), ("g", 5, 1, 1, [1.0], [1.0]), ("h", None, 1, 1, [1.0], [1.0]), ("i", 1, None, 1, [1.0], [1.0]), ("j", 1, 1, 1, [], []), ("k", 1, 1, 1, [1.0], [1.0])]
    got = {r["path"]: r for r in explain.heatmaps(spark.createDataFrame(bad, LAYER), n_classes=2).collect()}
    assert {p for p, r in got.items() if r["error"] is None} == {"k"} and all((r["heatmap"] is None) == (p != "k") for p, r in got.items())
    assert got["g"]["error"] == got["h"]["error"] == "class out of range" and "reach" in got["b"]["error"]
    assert explain.heatmaps(spark.createDataFrame([], LAYER)).count() == 0


def plain_cubic(image, height, width, a=-0.75):
    """Each new pixel from the sixteen around it."""
    h, w = image.shape

    def weight(x):
        x = abs(x)
        return (a + 2) * x**3 - (a + 3) * x**2 + 1 if x <= 1 else a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a if x < 2 else 0

    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            y, x = (i + 0.5) * h / height - 0.5, (j + 0.5) * w / width - 0.5
            for m in range(int(np.floor(y)) - 1, int(np.floor(y)) + 3):
                for n in range(int(np.floor(x)) - 1, int(np.floor(x)) + 3):
                    out[i, j] += image[min(max(m, 0), h - 1), min(max(n, 0), w - 1)] * weight(y - m) * weight(x - n)
    return out


def test_cubic_resizing_equals_plain_code():
    draw = np.random.default_rng(2)
    for shape, size in (((4, 5), (9, 7)), ((7, 7), (3, 20)), ((1, 1), (4, 4)), ((2, 3), (2, 6))):
        image = draw.random(shape)
        assert np.allclose(kernels.cubic_resize(image, *size), plain_cubic(image, *size))
        assert (kernels.cubic_resize(image, *shape) == image).all()
    assert np.allclose(kernels.cubic_resize(np.full((3, 4), 2.5), 10, 11), 2.5)


def test_masks_of_one_image_are_united_and_compared(spark):
    draw = np.random.default_rng(3)
    maps, masks, whole = [], [], {}
    for i in range(12):
        h, w = 6 + i % 3, 8
        heat = draw.random((3, 4)) if i else np.zeros((3, 4))
        maps.append((f"p{i}", 1, 3, 4, heat.ravel().tolist(), False, None))
        own = [(draw.random((h, w)) > 0.8) * 255 for _ in range(1 + i % 3)]
        masks += [(f"p{i}", h, w, m.astype(np.uint8).tobytes()) for m in own]
        whole[f"p{i}"] = (heat, np.maximum.reduce(own))
    half = np.kron(np.array([[1, 0], [0, 1]]), np.ones((2, 3)))  # half the size of another mask of its image
    masks += [("two", 4, 6, (255 * (np.arange(24) < 2)).astype(np.uint8).tobytes()), ("two", 2, 3, (255 * half[:2, :3]).astype(np.uint8).tobytes()), ("bad", 2, 2, b"\0"), ("none", 0, 0, b"")]
    maps += [("two", 0, 4, 6, [float(k) for k in range(24)], False, None), ("bad", 0, 1, 1, [1.0], False, None), ("error", 0, 1, 1, None, None, "why")]
    m = spark.createDataFrame(maps, "path string, class_index int, height int, width int, heatmap array<double>, degenerate boolean, error string")
    k = spark.createDataFrame(masks + masks[:5], "path string, height int, width int, data binary").repartition(4)
    got = {r["path"]: r for r in explain.agreement(m, k).collect()}
    assert set(got) == {*whole, "two"}
    for path, (heat, mask) in whole.items():
        big = kernels.cubic_resize(heat, *mask.shape)
        hot = (big >= np.percentile(big, 80)) & (big > 0)
        r = got[path]
        assert r["mask_coverage"] == pytest.approx((mask > 0).mean()) and r["degenerate"] == (not hot.any())
        assert r["iou"] == pytest.approx((hot & (mask > 0)).sum() / (hot | (mask > 0)).sum() if hot.any() else 0)
        assert r["pointing_hit"] == (mask.flat[big.argmax()] > 0)
    united = {r["path"]: r for r in explain.united(k).collect()}
    assert (united["two"]["height"], united["two"]["width"]) == (4, 6) and set(united) == {*whole, "two"}
    assert np.frombuffer(united["two"]["mask"], np.uint8).reshape(4, 6).astype(bool).tolist() == (np.kron(half[:2, :3], np.ones((2, 2))).astype(bool) | (np.arange(24) < 2).reshape(4, 6)).tolist()


def test_images_are_united_and_compared_by_the_batch(spark):
    draw = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(600):
        own = [draw.random((4, 3)) > 0.8 for _ in range(1 + i % 3)] + [draw.random((2, 3)) > 0.8] * (i % 2) + [draw.random((3, 4)) > 0.8] * (i == 7)
        own += [draw.random((4, 3)) > 0.9995 for _ in range(3000 * (i == 5))]
        rows += [(i, *m.shape, (m * 255).astype(np.uint8).tobytes()) for m in own]
        h, w = (4, 3)
        want[i] = np.logical_or.reduce([m[np.arange(h)[:, None] * m.shape[0] // h, np.arange(w) * m.shape[1] // w] for m in own])
    draw.shuffle(rows)
    masks = spark.createDataFrame([(int(p), int(h), int(w), d) for p, h, w, d in rows], "path long, height int, width int, data binary").repartition(5)
    done = explain.united(masks)
    assert {r["path"]: r["mask"] for r in done.collect()} == {i: (m * 255).astype(np.uint8).tobytes() for i, m in want.items()}
    assert "FlatMapGroupsInPandas" not in done._jdf.queryExecution().toString()  # which calls Python once an image
    heat = draw.random((600, 4, 3)) * (np.arange(600) % 9 > 0)[:, None, None]
    maps = spark.createDataFrame([(i, i % 2, 4, 3, x.ravel().tolist()) for i, x in enumerate(heat)], "path long, class_index int, height int, width int, heatmap array<double>")
    got = {r["path"]: r for r in explain.agreement(maps, masks).collect()}
    assert len(got) == 600
    for i, x in enumerate(heat):
        m, hot = want[i], (x >= np.percentile(x, 80)) & (x > 0)
        assert [got[i][c] for c in ("class_index", "pointing_hit", "mask_coverage", "degenerate")] == [i % 2, m.flat[x.argmax()], m.mean(), not hot.any()]
        assert got[i]["iou"] == ((hot & m).sum() / (hot | m).sum() if hot.any() else 0)
    several = kernels.mask_agreements(heat[:4, :3], np.stack([want[i] for i in range(4)]) * np.uint8(255))
    assert [{k: v[i].item() for k, v in several.items()} for i in range(4)] == [kernels.mask_agreement(heat[i, :3], want[i] * np.uint8(255)) for i in range(4)]


def test_overlays_and_bundles(spark):
    draw = np.random.default_rng(4)
    rgb = draw.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    shown = spark.createDataFrame([("a", 5, 6, rgb.tobytes()), ("b", 5, 6, rgb.tobytes())], "path string, width int, height int, rgb binary")
    layer = spark.createDataFrame([("a", 1, 2, 2, [0.0, 1.0, 2.0, 3.0], [1.0] * 4), ("b", 1, 2, 2, None, [1.0] * 4)], LAYER)
    maps = explain.heatmaps(layer)
    got = {r["path"]: r for r in explain.explained(shown, maps, "last").collect()}
    own = np.frombuffer(got["a"]["rgb"], np.uint8).reshape(6, 5, 3)
    hot = np.clip(plain_cubic(np.array([[0, 1], [2, 3]]) / 3, 6, 5), 0, 1)
    want = np.rint(0.6 * rgb + 0.4 * kernels.heat_colours()[(255 * hot).astype(int)])
    assert np.abs(own - want).max() <= 1 and got["a"]["map_size"] == [2, 2] and got["a"]["error"] is None
    assert got["b"]["rgb"] is None and got["b"]["error"] == "no activations"
    colours = kernels.heat_colours()
    assert colours[0].tolist() == [0, 0, 128] and colours[255].tolist() == [128, 0, 0] and colours[128][1] == 255
