"""Deterministic samples and splits: rows are ordered by a digest of their id and a seed, so that reruns and other layouts agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import sequenced


def draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def share(key: Column, seed: int) -> Column:
    """A number in [0, 1) for each key: 52 bits of its digest."""
    return F.conv(F.substring(draw(key, seed), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sample_n(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, or all."""
    return rows.orderBy(draw(F.col(key), seed), key).limit(n)


def sample_per_split(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    order = Window.partitionBy("split").orderBy(draw(F.col("conv_id"), seed), "conv_id")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def row_split(rows: DataFrame, key: str, test_size: float = 0.2, val_size: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split: test for a share test_size of the keys, val for val_size, train for the rest. A key is always in the same one, and nothing is sorted."""
    u = share(F.col(key), seed)
    return rows.withColumn("split", F.when(u < test_size, "test").when(u < test_size + val_size, "val").otherwise("train"))


def split_files(files: DataFrame, name: str, train_ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds split: train for the first int(n x ratio) names by digest, test for the others. Exact counts; nothing is moved."""
    drawn = sequenced(files.withColumn("__draw", draw(F.col(name), seed)), ["__draw", name])
    n = math.floor(files.count() * train_ratio)
    return drawn.withColumn("split", F.when(F.col("seq") <= n, "train").otherwise("test")).select(*files.columns, "split")
