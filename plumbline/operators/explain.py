"""Heat maps from stored activations and gradients, their overlays, and how they agree with masks, over tables.

Networks need a deep-learning runtime; whatever ran one leaves rows (path, class_index, height, width, activations,
gradients), both arrays by rows, columns and channels of the layer that is to be shown. All else is arithmetic on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.images import class_heatmaps, mask_agreements, overlaid, pixels

#: Numbers that are worked on at once.
NUMBERS = 1 << 22
ABOUT = "The map shows where the model's output for this class came from, as far as one layer tells. It is no outline of a finding."


def heatmaps(layers: DataFrame, n_classes: int | None = None) -> DataFrame:
    """(path, class_index, height, width, heatmap, degenerate, error) of every row.

    Rows of the same shape are multiplied together. A row whose arrays are null, hold nulls, are no whole number of channels
    or differ in length has an error and no map, as has a class below 0 or beyond n_classes. A map without any evidence for
    the class is all 0 and degenerate. Repeated rows each give a row.
    """
    cells = F.col("height") * F.col("width")
    wrong = (
        F.when(F.col("activations").isNull(), "no activations")
        .when(F.col("gradients").isNull(), "gradients did not reach the layer")
        .when(F.coalesce((F.col("height") < 1) | (F.col("width") < 1), F.lit(True)), "no cells")
        .when((F.size("activations") == 0) | (F.size("activations") % F.greatest(cells, F.lit(1)) != 0), "activations do not fill the cells")
        .when(F.size("activations") != F.size("gradients"), "activations and gradients differ in shape")
        .when(F.exists("activations", lambda v: v.isNull()) | F.exists("gradients", lambda v: v.isNull()), "missing numbers")
    )
    if n_classes is not None:
        wrong = F.when(F.coalesce((F.col("class_index") < 0) | (F.col("class_index") >= n_classes), F.lit(True)), "class out of range").otherwise(wrong)
    wide = lambda c: F.when(F.col("error").isNull(), F.col(c).cast("array<double>")).alias(c)
    rows = layers.select("path", "class_index", "height", "width", "activations", "gradients", wrong.alias("error"))
    rows = rows.select("path", "class_index", "height", "width", "error", wide("activations"), wide("gradients"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            heat: list[np.ndarray | None] = [None] * len(pdf)
            ok = pdf[pdf["error"].isna()]
            shapes = ok["activations"].map(len) if len(ok) else pd.Series(dtype=int)
            for (h, w, n), some in ok.groupby([ok["height"], ok["width"], shapes]):
                h, w = int(h), int(w)
                step = max(1, NUMBERS // int(n))
                for at in range(0, len(some), step):
                    part = some.iloc[at : at + step]
                    both = (np.stack(part[c].to_numpy()).reshape(len(part), h, w, -1) for c in ("activations", "gradients"))
                    for i, m in zip(part.index, class_heatmaps(*both)):
                        heat[i] = m.ravel()
            yield pdf[["path", "class_index", "height", "width"]].assign(heatmap=heat, degenerate=[None if h is None else not h.any() for h in heat], error=pdf["error"])

    key = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in ("path", "class_index", "height", "width"))
    return rows.mapInPandas(run, f"{key}, heatmap array<double>, degenerate boolean, error string")


def united(masks: DataFrame) -> DataFrame:
    """(path, height, width, mask) from masks (path, height, width, data: 8-bit gray pixels): a pixel is in an image's mask if
    it is above 127 in any of them. Smaller masks than the largest are brought to its size by nearest pixels. Masks without
    pixels are left out."""

    h, w = (F.col(c).cast("int").alias(c) for c in ("height", "width"))
    cells = F.col("height").cast("long") * F.col("width")
    sound = masks.where((F.col("height") > 0) & (F.col("width") > 0) & (F.octet_length("data") == cells)).select("path", h, w, "data")
    kind = f"path {dict(sound.dtypes)['path']}, height int, width int"

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Masks of one image and size that come together are one row, so an image with many masks is not moved whole."""
        for b in batches:
            found: dict[tuple, np.ndarray] = {}
            for *key, data in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(data, np.uint8) > 127
                if (whole := found.setdefault(tuple(key), own)) is not own:
                    whole |= own
            columns = [*zip(*found)] if found else [[], [], []]
            data = [whole.view(np.uint8).tobytes() for whole in found.values()]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(columns, b.schema)), pa.array(data, pa.binary())], names=["path", "height", "width", "data"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by path, the largest mask first; no more than one image's mask is held from batch to batch."""
        path, whole = None, None
        for b in batches:
            done: list[tuple] = []
            for p, height, width, data in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(data, bool).reshape(height, width)
                if whole is None or p != path:
                    if whole is not None:
                        done.append((path, whole))
                    path, whole = p, own.copy()
                elif own.shape == whole.shape:
                    whole |= own
                else:
                    rows, columns = whole.shape
                    whole |= own[np.arange(rows)[:, None] * height // rows, np.arange(columns) * width // columns]
            yield table(done, b.schema.field("path").type)
            last = b.schema.field("path").type
        if whole is not None:
            yield table([(path, whole)], last)

    def table(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        sides = (pa.array([m.shape[i] for _, m in done], pa.int32()) for i in (0, 1))
        data = pa.array([np.where(m, 255, 0).astype(np.uint8).tobytes() for _, m in done], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], kind), *sides, data], names=["path", "height", "width", "mask"])

    some = sound.mapInArrow(within, f"{kind}, data binary").withColumn("cells", cells)
    by_image = some.repartition("path").sortWithinPartitions("path", F.desc("cells"), F.desc("height")).drop("cells")
    return by_image.mapInArrow(over, f"{kind}, mask binary")


def agreement(maps: DataFrame, masks: DataFrame, percentile: float = 80) -> DataFrame:
    """(path, class_index, pointing_hit, iou, mask_coverage, degenerate) of every map whose image has a mask; maps with an
    error are left out."""
    mask = united(masks).select("path", F.col("height").alias("mask_height"), F.col("width").alias("mask_width"), "mask")
    both = maps.where("heatmap is not null").select("path", "class_index", "height", "width", "heatmap").join(mask, "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (h, w, rows, columns), some in pdf.groupby(["height", "width", "mask_height", "mask_width"]):
                step = max(1, NUMBERS // (int(rows) * int(columns)))
                for at in range(0, len(some), step):
                    part = some.iloc[at : at + step]
                    heat = np.stack(part["heatmap"].to_numpy()).reshape(len(part), int(h), int(w))
                    mask = np.frombuffer(b"".join(part["mask"]), np.uint8).reshape(len(part), int(rows), int(columns))
                    yield part[["path", "class_index"]].reset_index(drop=True).assign(**mask_agreements(heat, mask, percentile))

    key = ", ".join(f"{c} {dict(both.dtypes)[c]}" for c in ("path", "class_index"))
    return both.mapInPandas(run, f"{key}, pointing_hit boolean, iou double, mask_coverage double, degenerate boolean")


def overlays(shown: DataFrame, maps: DataFrame, alpha: float = 0.4) -> DataFrame:
    """(path, class_index, width, height, rgb): images (path, width, height, rgb) under the colours of their maps."""
    own = maps.where("heatmap is not null").select("path", "class_index", F.col("height").alias("map_height"), F.col("width").alias("map_width"), "heatmap")
    both = shown.select("path", "width", "height", "rgb").join(own, "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [overlaid(pixels(r.rgb, int(r.height), int(r.width), 3), np.asarray(r.heatmap).reshape(int(r.map_height), int(r.map_width)), alpha).tobytes() for r in pdf.itertuples()]
            yield pdf[["path", "class_index", "width", "height"]].assign(rgb=done)

    key = ", ".join(f"{c} {dict(both.dtypes)[c]}" for c in ("path", "class_index", "width", "height"))
    return both.mapInPandas(run, f"{key}, rgb binary")


def explained(shown: DataFrame, maps: DataFrame, layer: str, alpha: float = 0.4) -> DataFrame:
    """Overlays with what is to be told beside them; a map with an error keeps its row, without an overlay, so that a
    prediction can be shown without its explanation."""
    made = overlays(shown, maps, alpha).withColumnRenamed("width", "image_width").withColumnRenamed("height", "image_height")
    told = maps.select("path", "class_index", F.lit("gradient-weighted class activation").alias("method"), F.lit(layer).alias("layer"), F.array("height", "width").alias("map_size"), "degenerate", "error", F.lit(ABOUT).alias("about"))
    return told.join(made, ["path", "class_index"], "left")
