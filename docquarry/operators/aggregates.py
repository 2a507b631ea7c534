"""Aggregates with the document store's rules: only numbers count, and nothing gives 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import Text, Typed
from ..functions.text import count_byte_pairs


def summary(number: Column) -> list[Column]:
    """count, sum, avg, min and max of what is a number; 0 where there is none."""
    zero = F.lit(0.0)
    return [F.count(number).alias("count"), *(F.coalesce(f(number), zero).alias(f.__name__) for f in (F.sum, F.avg, F.min, F.max))]


def aggregate(df: DataFrame, field: str, value: str | None = None, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each group, of the five aggregates of a field."""
    number = (Text(df[value]) if value else Typed(df)).number(field)
    return df.groupBy(*(by or [])).agg(*summary(number))


def merge_partials(partials: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Final aggregates from partial ones (status, doc_count, total, least, most); shards that failed are passed over."""
    good = partials.where("status = 'ok'")
    n, total = F.sum("doc_count"), F.sum("total")
    return good.groupBy(*(by or [])).agg(
        F.coalesce(n, F.lit(0)).alias("count"), F.coalesce(total, F.lit(0.0)).alias("sum"), F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("avg"),
        F.coalesce(F.min("least"), F.lit(0.0)).alias("min"), F.coalesce(F.max("most"), F.lit(0.0)).alias("max"),
    )


def storage_bytes(df: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).alias("bytes"))


def pair_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(pair, n, weight): counts of neighbouring bytes and weights that are high for rare pairs, 0xFE00 down to 0x1000."""
    counts = df.select(df[text].cast("string")).mapInArrow(count_byte_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    top = counts.agg(F.max("n").alias("top"))  # at most 65,536 rows go in
    return counts.crossJoin(F.broadcast(top)).select("pair", "n", (F.lit(0xFE00) - F.floor(F.col("n") * (0xFE00 - 0x1000) / F.col("top"))).cast("int").alias("weight"))


def query_costs(log: DataFrame) -> DataFrame:
    """``log`` (cpu_us, rows, bytes) with its cost in billionths of a dollar."""
    return log.withColumn("cost", F.col("cpu_us") * 5 + F.col("rows") + F.floor(F.col("bytes") / 1024))


def usage(log: DataFrame, by: list[str]) -> DataFrame:
    costs = query_costs(log)
    return costs.groupBy(*by).agg(F.count("*").alias("queries"), *(F.sum(c).alias(c) for c in ("rows", "bytes", "cpu_us", "cost")))


def recent(log: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The newest ``n`` rows, oldest first."""
    return log.orderBy(F.desc(order)).limit(n).orderBy(order)
