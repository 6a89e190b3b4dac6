"""Interval joins: containment by bins and as-of by one window, neither with a product of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Pairs with lo <= at <= hi of equal key: spans are put into every bin that they touch, points into one, and bins meet by equal keys."""
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(s, [key, "_bin"]).filter((F.col(lo) <= F.col(at)) & (F.col(at) <= F.col(hi))).drop("_bin")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with value: the last of right at or before `at`, by a sorted union (rows of right come first among equals)."""
    names = [c for c in left.columns if c not in (key, at)]
    pick = lambda df, side: df.select(key, at, F.lit(side).alias("_side"), *(F.col(c) if side else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in names), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v") if side else F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = pick(left, 1).unionByName(pick(right, 0)).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*left.columns, value)
