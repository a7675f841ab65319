"""Feature expressions on flat ``array<double>`` images, all JVM built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.constants import CROP_PAD, FLIP_PROBABILITY, NORM_MEAN, NORM_STD, PIXEL_MAX
from trustfold.functions.hashing import uniform


def scale_unit(df: DataFrame, col: str = "features", maximum: float = PIXEL_MAX) -> DataFrame:
    return df.withColumn(col, F.transform(col, lambda x: x / F.lit(float(maximum))))


def normalize(df: DataFrame, col: str = "features", mean: float = NORM_MEAN, std: float = NORM_STD) -> DataFrame:
    return df.withColumn(col, F.transform(col, lambda x: (x - F.lit(float(mean))) / F.lit(float(std))))


def _scaled_and_normalized(df: DataFrame, col: str) -> DataFrame:
    """Both steps in one pass over the array."""
    return df.withColumn(
        col, F.transform(col, lambda x: (x / F.lit(PIXEL_MAX) - F.lit(NORM_MEAN)) / F.lit(NORM_STD))
    )


def _image_row(col: Column, row: Column, width: int, skip: Column, length: Column) -> Column:
    return F.slice(col, row * F.lit(width) + skip + F.lit(1), length)


def random_crop(
    df: DataFrame, col: str = "features", height: int = 8, width: int = 8,
    pad: int = CROP_PAD, seed: int = 0, id_col: str = "row_id",
) -> DataFrame:
    """Zero-pad by ``pad`` on every side and cut a height x width window at a hashed offset.

    Built from whole image rows (slice and zero fill), not pixel by pixel.
    """
    if pad > min(height, width):
        raise ValueError(f"pad {pad} exceeds the image side {min(height, width)}")
    shift = [
        F.floor(uniform(seed, axis, F.col(id_col)) * F.lit(2 * pad + 1)).cast("int") - F.lit(pad)
        for axis in ("dy", "dx")
    ]
    shifted = df.withColumn("_dy", shift[0]).withColumn("_dx", shift[1])
    dy, dx, image = F.col("_dy"), F.col("_dx"), F.col(col)
    zero = F.lit(0.0)
    left = F.array_repeat(zero, F.greatest(-dx, F.lit(0)))
    right = F.array_repeat(zero, F.greatest(dx, F.lit(0)))
    kept, skip = F.lit(width) - F.abs(dx), F.greatest(dx, F.lit(0))
    def image_row(r: Column) -> Column:
        inside = (r + dy >= 0) & (r + dy < height)
        return F.when(inside, F.concat(left, _image_row(image, r + dy, width, skip, kept), right)).otherwise(
            F.array_repeat(zero, F.lit(width))
        )

    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), image_row)
    return shifted.withColumn(col, F.flatten(rows)).drop("_dy", "_dx")


def random_hflip(
    df: DataFrame, col: str = "features", height: int = 8, width: int = 8,
    probability: float = FLIP_PROBABILITY, seed: int = 0, id_col: str = "row_id",
) -> DataFrame:
    """Mirror each image row when the row's draw is below ``probability``."""
    mirrored = F.concat(*[F.reverse(F.slice(F.col(col), r * width + 1, width)) for r in range(height)])
    flip = uniform(seed, "flip", F.col(id_col)) < F.lit(float(probability))
    return df.withColumn(col, F.when(flip, mirrored).otherwise(F.col(col)))


def prepare(
    df: DataFrame, mode: str, col: str = "features", height: int = 8, width: int = 8,
    pad: int = CROP_PAD, seed: int = 0, id_col: str = "row_id",
) -> DataFrame:
    """``train``: crop, flip, scale, normalise; ``test``: scale, normalise."""
    if mode not in ("train", "test"):
        raise ValueError(f"mode must be 'train' or 'test', got {mode!r}")
    if mode == "train":
        df = random_crop(df, col, height, width, pad, seed, id_col)
        df = random_hflip(df, col, height, width, FLIP_PROBABILITY, seed, id_col)
    return _scaled_and_normalized(df, col)
