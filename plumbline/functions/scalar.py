"""Column expressions that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that count as images, and how many bytes and pixels an upload may have.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp")
MOST_BYTES, LEAST_SIDE, MOST_SIDE = 10 * 1024 * 1024, 16, 10000
MASK_STEM = r"(?i)_mask(_\d+)?$"


def double(x: Column) -> Column:
    return x.cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(double(a), double(b)), F.lit(0.0))


def grid(n: int, low: float = 0.0, high: float = 1.0) -> list[float]:
    """n evenly spaced points from low to high, as low + i * step."""
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n)]


def decided(y_prob: Column, threshold: float | Column = 0.5) -> Column:
    """1 where the probability reaches the threshold."""
    return (y_prob >= (F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold)).cast("int")


def category(y_true: Column, y_pred: Column) -> Column:
    right = y_true == y_pred
    return F.when(right & (y_true == 1), "true_positive").when(right, "true_negative").when(y_pred == 1, "false_positive").otherwise("false_negative")


def decision_confidence(y_prob: Column, y_pred: Column) -> Column:
    """The probability of the class that was decided on."""
    return F.when(y_pred == 1, y_prob).otherwise(1 - y_prob)


def confidence_band(y_prob: Column) -> Column:
    m = F.greatest(y_prob, 1 - y_prob)
    return F.when(m >= 0.9, "high").when(m >= 0.7, "moderate").otherwise("low")


def effect_band(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def cohens_d(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """(b - a) / pooled standard deviation; 0 where that is (almost) 0, null where a side has fewer than two values."""
    pooled = F.sqrt(F.try_divide((n_a - 1) * var_a + (n_b - 1) * var_b, double(n_a + n_b - 2)))
    return F.when((n_a < 2) | (n_b < 2), F.lit(None)).when(pooled <= 1e-12, 0.0).otherwise(F.try_divide(mean_b - mean_a, pooled))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def extension(name: Column) -> Column:
    """From the last dot, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def is_mask(name_stem: Column) -> Column:
    return name_stem.rlike(MASK_STEM)


def sniffed_format(payload: Column) -> Column:
    """PNG, JPEG or BMP by the first bytes, else null."""
    return F.when(F.startswith(payload, F.lit(bytes.fromhex("89504E470D0A1A0A"))), "PNG").when(F.startswith(payload, F.lit(bytes.fromhex("FFD8FF"))), "JPEG").when(F.startswith(payload, F.lit(b"BM")), "BMP")


def validation_error(payload: Column, name: Column, most_bytes: int = MOST_BYTES) -> Column:
    """The first rule that an upload breaks, of those that its name and bytes decide; null if none."""
    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "missing filename")
        .when(~extension(name).isin(*IMAGE_EXTENSIONS), "extension not allowed")
        .when(F.coalesce(F.octet_length(payload), F.lit(0)) == 0, "empty file")
        .when(F.octet_length(payload) > most_bytes, "file too large")
        .when(sniffed_format(payload).isNull(), "not a supported image")
    )


def side_error(width: Column, height: Column) -> Column:
    """What is wrong with a decoded image's sides; null if nothing."""
    return F.when(width.isNull() | height.isNull(), "cannot be decoded").when(F.least(width, height) < LEAST_SIDE, "image too small").when(F.greatest(width, height) > MOST_SIDE, "image too large")


def chosen_label(probabilities: Column, classes: list[str], positive: str, threshold: float) -> Column:
    """The positive class from the threshold on; below it the other of two classes, or the most probable of more."""
    at = classes.index(positive) if positive in classes else len(classes) - 1
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position(probabilities, F.array_max(probabilities)).cast("int"))
    below = F.lit(classes[1 - at]) if len(classes) == 2 else best
    return F.when(F.element_at(probabilities, at + 1) >= threshold, classes[at]).otherwise(below)


def shown_probability(y_prob: Column, is_positive: Column) -> Column:
    return F.when(is_positive, y_prob).otherwise(1 - y_prob)


def base64_uri(data: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(data), r"[\r\n]", ""))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def folds_for(share: float) -> int:
    """How many folds hold out this share: at least 2, the nearest whole number of 1 / share, halves to even."""
    if not 0 < share < 1:
        raise ValueError(f"a share lies between 0 and 1, not at {share}")
    return max(2, round(1 / share))


def format_metric(value: float | None, low: float | None = None, high: float | None = None) -> str:
    """Three digits, with the interval if there is one; n/a for a missing value."""
    if value is None or math.isnan(value):
        return "n/a"
    return f"{value:.3f}" + (f" [{low:.3f}-{high:.3f}]" if low is not None and high is not None and not math.isnan(low) else "")


def binarised(label: Column, positive: int | str) -> Column:
    """1 where the label is the positive one, 0 elsewhere; null stays null."""
    return (label == F.lit(positive)).cast("int")


def one_hot(label: Column, classes: int) -> Column:
    """array<double> with 1 at the label's place and 0 elsewhere; null for a null label or one that is no class."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("double"))
    return F.when((label >= 0) & (label < classes), hot)


def class_probabilities(probabilities: Column, classes: list[str]) -> Column:
    """map of each class to its probability, classes in order."""
    return F.map_from_arrays(F.array(*map(F.lit, classes)), probabilities)


def per_image_ms(total_seconds: Column, n: Column) -> Column:
    """Mean milliseconds per image; over no image the total counts as one's."""
    return F.lit(1000.0) * total_seconds / F.greatest(F.lit(1), n)


def canonical_json(document: Column) -> Column:
    """The JSON document with every object's keys in order and no blanks; null if it is no JSON."""
    return F.to_json(F.try_parse_json(document))


def augmentation_text(settings: dict) -> dict:
    """What a configuration's augmentation does, in words by rule: {"enabled", "transforms"}; settings hold "augmentation".

    A setting that is switched on is told by its name, one with an amount by its name and amount.
    """
    own = dict(settings.get("augmentation") or {})
    if not own.pop("enabled", False):
        return {"enabled": False, "transforms": []}
    spoken = lambda name: name.removesuffix("_range").replace("_", " ")
    span = lambda v: f"from {v[0]} to {v[1]}" if isinstance(v, (list, tuple)) else f"by up to {v}"
    return {"enabled": True, "transforms": [spoken(n) if v is True else f"{spoken(n)} {span(v)}" for n, v in own.items() if v]}
