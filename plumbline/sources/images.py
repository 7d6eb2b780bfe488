"""Image folders as a keyed manifest, masks attached, and decoded features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.images import PROFILES, augmented, gray, pixels, preprocess, properties, shown, small_copy, thumbnail, variation
from plumbline.functions.images import decoded as image_pixels
from plumbline.functions.images import sides as sides_of
from plumbline.functions.jpeg import encoded as jpeg_bytes
from plumbline.functions.scalar import IMAGE_EXTENSIONS, MOST_BYTES, extension, is_mask, side_error, stem, validation_error
from plumbline.operators.profile import labelled
from plumbline.tables import in_order

PROPERTIES = "struct<width: double, height: double, mean_intensity: double, std_intensity: double, rms_contrast: double, laplacian_variance: double, dark_fraction: double, edge_density: double>"
MASK_SUFFIX = r"(?i)_mask(_\d+)?$"


def decoded_path(path):
    """binaryFile and image sources spell paths differently; this is the common form."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^file:/+", "/")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, class_name, stem, ext, length) of all files below root's class folders; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(path.alias("path"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("class_name"), stem(path).alias("stem"), extension(path).alias("ext"), "length")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def manifest(files: DataFrame, classes: list[str]) -> DataFrame:
    """(idx, path, class_name, label, stem, mask_paths, group_id) of the images in class order, then path order.

    Masks (name_mask, name_mask_1, ...) are attached to the image of their class and name, in order. idx comes from a sort
    by range over the cluster and from counts of its parts.
    """
    kept = labelled(files.where(F.col("ext").isin(*IMAGE_EXTENSIONS)), classes).where("label is not null")
    masks = kept.where(is_mask(F.col("stem"))).select("class_name", F.regexp_replace("stem", MASK_SUFFIX, "").alias("stem"), F.col("path").alias("mask")).groupBy("class_name", "stem").agg(F.array_sort(F.collect_list("mask")).alias("mask_paths"))
    images = kept.where(~is_mask(F.col("stem"))).join(masks, ["class_name", "stem"], "left")
    named = images.select("path", "class_name", "label", "stem", F.coalesce("mask_paths", F.array().cast("array<string>")).alias("mask_paths"), F.concat_ws("/", "class_name", "stem").alias("group_id"))
    return in_order(named, ["label", "path"]).select("idx", *named.columns)


def every_folder(files: DataFrame, ext: str = ".png") -> DataFrame:
    """(idx, path, class_name, label, stem, mask_paths, group_id) of all images of one extension below any folder, label 0,
    each a group of its own: a scan that knows no classes and attaches no masks."""
    kept = files.where(F.col("ext") == ext).select("path", "class_name", F.lit(0).alias("label"), "stem", F.array().cast("array<string>").alias("mask_paths"), F.col("path").alias("group_id"))
    return in_order(kept, ["class_name", "path"]).select("idx", *kept.columns)


def missing_classes(files: DataFrame, classes: list[str]) -> DataFrame:
    """Classes without an image."""
    names = files.sparkSession.createDataFrame([(c,) for c in classes], "class_name string")
    return names.join(files.where(F.col("ext").isin(*IMAGE_EXTENSIONS) & ~is_mask(F.col("stem"))).select("class_name").distinct(), "class_name", "left_anti")


def discover(spark: SparkSession, root: str, classes: list[str]) -> DataFrame:
    """The manifest of a folder; an error if a class has no image."""
    files = listing(spark, root)
    gone = [r["class_name"] for r in missing_classes(files, classes).collect()]
    if gone:
        raise FileNotFoundError(f"no images of {', '.join(sorted(gone))} below {root}")
    return manifest(files, classes)


def class_folders(spark: SparkSession, root: str, classes: list[str]) -> DataFrame:
    """(class_name, folder): the shallowest folder of each class's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).distinct()
    up = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda i: F.array_join(F.slice(F.split("folder", "/"), 1, i), "/"))).alias("folder")).distinct()
    named = up.withColumn("class_name", F.regexp_extract("folder", r"([^/]+)$", 1)).where(F.col("class_name").isin(*classes))
    return named.groupBy("class_name").agg(F.min_by("folder", F.struct(F.size(F.split("folder", "/")), "folder")).alias("folder"))


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, channels, data): decoded images, blue first; sides and data are null where decoding fails."""
    read = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root).select("image.*")
    ok = F.col("height") > 0
    return read.select(decoded_path(F.col("origin")).alias("path"), F.when(ok, F.col("width")).alias("width"), F.when(ok, F.col("height")).alias("height"), F.when(ok, F.col("nChannels")).alias("channels"), F.when(ok, F.col("data")).alias("data"))


def features(decoded: DataFrame, size: int = 32) -> DataFrame:
    """(path, width, height, thumbnail, properties): each image is decoded once and all kernels run over it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.data is None or pd.isna(r.height):
                    rows.append((r.path, None, None, [0.0] * (size * size), None))
                    continue
                g = gray(r.data, int(r.height), int(r.width), int(r.channels))
                rows.append((r.path, int(r.width), int(r.height), thumbnail(g, size).tolist(), properties(g)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "thumbnail", "properties"])

    return decoded.mapInPandas(run, f"path string, width int, height int, thumbnail array<double>, properties {PROPERTIES}")


def payload_features(uploads: DataFrame, key: str, payload: str, size: int = 32) -> DataFrame:
    """(key, width, height, thumbnail, properties) of PNG, JPEG and BMP images that lie in rows as bytes; nulls if undecodable."""
    kind = dict(uploads.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                p = image_pixels(r.payload)
                g = None if p is None else gray(p.tobytes(), *p.shape)
                rows.append((r.key, None, None, None, None) if g is None else (r.key, p.shape[1], p.shape[0], thumbnail(g, size).tolist(), properties(g)))
            yield pd.DataFrame(rows, columns=["key", "width", "height", "thumbnail", "properties"])

    return uploads.select(F.col(key).alias("key"), F.col(payload).alias("payload")).mapInPandas(run, f"key {kind}, width int, height int, thumbnail array<double>, properties {PROPERTIES}").withColumnRenamed("key", key)


def validated(uploads: DataFrame, key: str = "filename", payload: str = "payload", most_bytes: int = MOST_BYTES) -> DataFrame:
    """uploads with error: the first rule broken of name, bytes, decoding and sides; null for a sound image.

    A JPEG that is not sequential is judged by the sides that its header states.
    """
    quick = uploads.withColumn("quick", validation_error(F.col(payload), F.col(key), most_bytes))

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [None if q is not None else sides_of(b) for q, b in zip(pdf["quick"], pdf[payload])]
            yield pdf.assign(width=[None if p is None else p[0] for p in found], height=[None if p is None else p[1] for p in found]).astype({"width": "Int32", "height": "Int32"})

    schema = ", ".join(f"`{n}` {t}" for n, t in quick.dtypes) + ", width int, height int"
    seen = quick.mapInPandas(sides, schema)
    return seen.withColumn("error", F.coalesce("quick", side_error(F.col("width"), F.col("height")))).select(*uploads.columns, "width", "height", "error")



def _each(decoded: DataFrame, make, schema: str) -> DataFrame:
    """make(path, pixels) gives rows for each decoded image; images that could not be decoded give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            ok = pdf[pdf["data"].notna()]
            rows = [x for r in ok.itertuples(index=False) for x in make(r.path, pixels(r.data, int(r.height), int(r.width), int(r.channels)))]
            yield pd.DataFrame(rows, columns=names)

    return decoded.select("path", "width", "height", "channels", "data").mapInPandas(run, schema)


def preprocessed(decoded: DataFrame, profile: str) -> DataFrame:
    """(path, side, x): each image as the profile's model wants it, flattened by rows, red first. An unknown profile is an
    error, and images that cannot be decoded give no row."""
    side = PROFILES[profile][0]
    return _each(decoded, lambda path, image: [(path, side, preprocess(image, profile)[0].ravel())], "path string, side int, x array<float>")


def split_arrays(samples: DataFrame, split: DataFrame, which: str, decoded: DataFrame, profile: str) -> DataFrame:
    """(idx, label, x) of one split's samples: a model's input and its labels."""
    rows = samples.join(split.where(F.col("split") == which).select("idx"), "idx").select("idx", "label", "path")
    return rows.join(preprocessed(decoded, profile), "path").select("idx", "label", "x")


def displayed(decoded: DataFrame, width: int, height: int) -> DataFrame:
    """(path, width, height, rgb): 8-bit pixels at another size, red first, not normalised."""
    return _each(decoded, lambda path, image: [(path, width, height, shown(image, width, height).tobytes())], "path string, width int, height int, rgb binary")


def small_copies(decoded: DataFrame, longest: int = 128, quality: int = 70) -> DataFrame:
    """(path, width, height, thumbnail_jpeg): copies for a log, no side longer than longest, never larger than the image."""

    def make(path, image):
        small = small_copy(image, longest)
        return [(path, small.shape[1], small.shape[0], jpeg_bytes(small[:, :, :3], quality))]

    return _each(decoded, make, "path string, width int, height int, thumbnail_jpeg binary")


def variants(decoded: DataFrame, n: int, seed: int = 42, settings: dict | None = None) -> DataFrame | None:
    """(path, variant, width, height, channels, data): n random variants of each image; None where settings' augmentation
    is switched off. A variant depends on seed, path and its number alone."""
    if not (settings or {}).get("augmentation", {"enabled": True}).get("enabled"):
        return None
    how = variation(settings or {})

    def make(path, image):
        start = zlib.crc32(f"{seed}:{path}".encode())
        return [(path, i, image.shape[1], image.shape[0], image.shape[2], augmented(image, start + i, **how).tobytes()) for i in range(n)]

    return _each(decoded, make, "path string, variant int, width int, height int, channels int, data binary")


def training_variants(samples: DataFrame, split: DataFrame, decoded: DataFrame, n: int, seed: int = 42, settings: dict | None = None) -> DataFrame | None:
    """variants of the train split's images only, with idx and label: nothing of val and test is ever varied."""
    made = variants(decoded, n, seed, settings)
    return None if made is None else samples.join(split.where("split = 'train'").select("idx"), "idx").select("idx", "label", "path").join(made, "path")


def variant_examples(decoded: DataFrame, n: int, seed: int = 42, settings: dict | None = None) -> DataFrame | None:
    """(path, variant, width, height, channels, shade): each image as variant 0 and n variants of it, for showing: pixels by
    rows, scaled from 0 to 1 between the least and the largest (0 if all are equal). None where augmentation is off."""
    made = variants(decoded, n, seed, settings)
    if made is None:
        return None
    every = decoded.select("path", F.lit(0).alias("variant"), "width", "height", "channels", "data").unionByName(made.withColumn("variant", F.col("variant") + 1))

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shades = []
            for data in pdf.pop("data"):
                p = np.frombuffer(data, np.uint8).astype(np.float32)
                low, high = (p.min(), p.max()) if len(p) else (0, 0)
                shades.append((p - low) / (high - low) if high > low else np.zeros_like(p))
            yield pdf.assign(shade=shades)

    return every.mapInPandas(scale, "path string, variant int, width int, height int, channels int, shade array<float>")
