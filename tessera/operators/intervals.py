"""Joins by order: as-of and point-in-interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """left with values of the last right row of its key whose right_at is not after left_at; null where there is none.

    One shuffle: both sides are united, sorted by key and time, and the last right row is carried forward. No pairs are made.
    """
    cols = left.columns
    a = left.select(F.col(left_key).alias("_k"), F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_left"), F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(F.col(right_key).alias("_k"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*[F.col(f"_left.{c}").alias(c) for c in cols], *[F.col(f"_last.{v}").alias(v) for v in values])


def point_in_interval(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at < high. Ranges are listed under each cell of the given width that they touch, points have one cell, and the
    join is an equi-join on cells: width near the ranges' usual length keeps both the copies and the candidates few."""
    cells = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    r = ranges.withColumn("_cell", cells)
    p = points.withColumn("_cell", F.floor(F.col(at) / width))
    return p.join(r, "_cell").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")
