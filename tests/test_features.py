"""Image operators against pixel-by-pixel Python."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from trustfold.operators import features


def _u(key):
    return int(md5(key.encode()).hexdigest()[:8], 16) / 2 ** 32


def _images(spark, n=60, height=3, width=5):
    values = [F.col("id") * 100 + i for i in range(height * width)]
    return spark.range(n).select(F.col("id").alias("row_id"), F.array(*[v.cast("double") for v in values]).alias("features"))


def test_crop(spark):
    got = {r["row_id"]: r["features"] for r in features.random_crop(_images(spark), height=3, width=5, pad=2).collect()}
    for i in range(60):
        dy, dx = int(_u(f"0|dy|{i}") * 5) - 2, int(_u(f"0|dx|{i}") * 5) - 2
        want = [
            float(i * 100 + (r + dy) * 5 + c + dx) if 0 <= r + dy < 3 and 0 <= c + dx < 5 else 0.0
            for r in range(3) for c in range(5)
        ]
        assert got[i] == want


def test_flip(spark):
    got = {r["row_id"]: r["features"] for r in features.random_hflip(_images(spark), height=3, width=5).collect()}
    flipped = 0
    for i in range(60):
        rows = [[float(i * 100 + r * 5 + c) for c in range(5)] for r in range(3)]
        if _u(f"0|flip|{i}") < 0.5:
            rows, flipped = [row[::-1] for row in rows], flipped + 1
        assert got[i] == sum(rows, [])
    assert 15 < flipped < 45


def test_scaling(spark):
    df = spark.createDataFrame([(0, [0.0, 127.5, 255.0])], "row_id bigint, features array<double>")
    assert features.prepare(df, "test").first()["features"] == [-1.0, 0.0, 1.0]
    assert features.normalize(features.scale_unit(df)).first()["features"] == [-1.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        features.prepare(df, "other")
