"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str]) -> DataFrame:
    """``left`` with the ``take`` columns of the last right row of the same ``by`` at or before its ``on``; null where there is none.

    One shuffle by ``by`` and one sort, as both sides go through one window.
    """
    own = left.select(*by, on, F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(F.struct(on, *take).alias("r")).schema["r"].dataType).alias("r"))
    other = right.select(*by, on, F.lit(None).cast(own.schema["l"].dataType).alias("l"), F.struct(on, *take).alias("r"))
    w = Window.partitionBy(*by).orderBy(F.col(on), F.col("l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = own.unionByName(other).withColumn("seen", F.last("r", ignorenulls=True).over(w)).where("l is not null")
    return seen.select("l.*", *(F.col(f"seen.{c}").alias(f"right_{c}") for c in (on, *take)))


def in_ranges(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them, by cells of ``width``: an equality join, however many ranges there are."""
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("__cell", F.floor(F.col(value) / width)).join(cells, "__cell").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__cell")
