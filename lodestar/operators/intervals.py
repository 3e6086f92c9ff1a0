"""Unions of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_union(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end): intervals that overlap or touch become one. spans: (keys, start, end)

    Intervals with a null end are left out; null keys are a group of their own; an interval that ends before it
    starts is a point at its start. Other columns are dropped. A key's intervals are sorted in one task, which
    spills; they are first made distinct, so that repeated rows don't add to it.
    """
    spans = spans.where("start is not null and end is not null").select(*keys, "start", F.greatest("start", "end").alias("end")).distinct()
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col("start") <= before, 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
