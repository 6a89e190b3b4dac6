"""Retrieval evaluation: recall, reciprocal rank, percentiles, regressions, evidence containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recall(hits: DataFrame, expected: DataFrame, k: int = 10, task: str = "task_id", key: str = "file") -> DataFrame:
    """task, recall, rr: over the first k hits; ranks count different keys. Tasks that expect nothing have recall 1 and rr 0."""
    top = hits.filter(F.col("rank") <= k).groupBy(task, key).agg(F.min("rank").alias("r"))
    top = top.withColumn("place", F.row_number().over(Window.partitionBy(task).orderBy("r")))
    j = expected.join(top, [task, key], "left").groupBy(task)
    return j.agg(F.round(F.count("place") / F.count("*"), 6).alias("recall"), F.round(F.coalesce(1 / F.min("place"), F.lit(0.0)), 6).alias("rr"))


def percentile(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """group, value: the entry at floor(q * n) of the sorted values (no interpolation)."""
    w = Window.partitionBy(group)
    r = rows.withColumn("k", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    return r.filter(F.col("k") == F.least(F.floor(F.col("n") * q), F.col("n") - 1)).select(group, value)


def verdict(variants: DataFrame, order: str, metrics: list[str], tolerance: float = 1e-9) -> DataFrame:
    """variants with regressed: whether a metric fell below the variant before it."""
    w = Window.orderBy(order)
    worse = F.lit(False)
    for m in metrics:
        worse = worse | F.coalesce(F.col(m) < F.lag(m).over(w) - tolerance, F.lit(False))
    return variants.withColumn("regressed", worse)


def evidence(hits: DataFrame, wanted: DataFrame, task: str = "task_id") -> DataFrame:
    """task, found, total: how many wanted spans (file, sl, el) lie within a hit of their file."""
    h = hits.select(task, "file", F.col("sl").alias("h_sl"), F.col("el").alias("h_el"))
    j = wanted.join(h, [task, "file"], "left").withColumn("ok", (F.col("h_sl") <= F.col("sl")) & (F.col("h_el") >= F.col("el")))
    return j.groupBy(task, "file", "sl", "el").agg(F.max(F.coalesce("ok", F.lit(False))).alias("ok")).groupBy(task).agg(F.sum(F.col("ok").cast("long")).alias("found"), F.count("*").alias("total"))
