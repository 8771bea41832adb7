"""Joins that Spark has no name for, from operators that it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str) -> DataFrame:
    """Each row of left with the columns of right's last row of the same keys whose `right_at` is not after the row's `at`; null if there is none.

    Both sides are put in one stream by key and time, in which the last row of right is carried on: one exchange, no pairs. Of
    right's rows at one time, the largest row counts; rows of left whose keys or time are null find none.
    """
    gained = [c for c in right.columns if c not in keys]
    value = F.struct(*[F.col(f"`{c}`") for c in gained])
    a = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct("*").alias("__left"), F.lit(None).cast(right.select(value.alias("x")).schema["x"].dataType).alias("__right"))
    b = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), value.alias("__right"))
    known = F.col("__at").isNotNull()
    for k in keys:
        known &= F.col(f"`{k}`").isNotNull()
    w = Window.partitionBy(*keys).orderBy("__at", "__side", "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b.where(known)).withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    found = F.when(known, F.col("__last"))
    return out.select("__left.*", *[found.getField(c).alias(c) for c in gained if c not in left.columns])


def within(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """points joined with the ranges that hold their value: low <= value < high.

    Ranges are cut at multiples of `width` and met by equality, so that no side is compared with all of the other; width should be
    near the usual length of a range. A range is repeated for each multiple that it touches.
    """
    first, last = F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    cut = ranges.where(F.col(low) < F.col(high)).withColumn("__bin", F.explode(F.sequence(first, last)))
    return points.withColumn("__bin", F.floor(F.col(value) / width)).join(cut, "__bin").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__bin")
