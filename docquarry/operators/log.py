"""The version log: every write is a row, and views read it.

A log has key, value, op (insert, update or delete), epoch, ts_ms and, where they are
used, doc_id and expires_at.  All views go by key: a key that is deleted and written
again has one history.  The newest row of a key is found with row_number() = 1, which
Spark limits per group before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(log: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("epoch"))
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest(log: DataFrame, key: list[str] | None = None, now_ms: int | None = None) -> DataFrame:
    """The live rows: newest of each key, not deleted and, where a time is given, not expired."""
    out = _newest(log, key or ["key"]).where("op <> 'delete'")
    return out.where(F.col("expires_at").isNull() | (F.col("expires_at") > now_ms)) if now_ms is not None else out


def as_of_epoch(log: DataFrame, epoch: int, key: list[str] | None = None) -> DataFrame:
    """The live rows as they were once this epoch was written."""
    return latest(log.where(F.col("epoch") <= epoch), key)


def as_of_time(log: DataFrame, ts_ms: int, key: list[str] | None = None) -> DataFrame:
    """The same by time; nothing before the first write."""
    return latest(log.where(F.col("ts_ms") <= ts_ms), key)


def epoch_at(log: DataFrame, ts_ms: int) -> DataFrame:
    """(epoch): the last epoch written up to a time, null before the first."""
    return log.where(F.col("ts_ms") <= ts_ms).agg(F.max("epoch").alias("epoch"))


def history(log: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Every version with its number (from 0), the epoch before it and whether it is the newest."""
    w = Window.partitionBy(*(key or ["key"])).orderBy("epoch")
    rows = log.withColumn("version", F.row_number().over(w) - 1).withColumn("previous_epoch", F.lag("epoch").over(w))
    return rows.withColumn("is_latest", F.lead("epoch").over(w).isNull())


def collect_garbage(log: DataFrame, keep_from: int, key: list[str] | None = None) -> DataFrame:
    """The log without versions that were replaced before epoch ``keep_from``: as-of views from there on are as before."""
    w = Window.partitionBy(*(key or ["key"])).orderBy("epoch")
    return log.withColumn("__next", F.lead("epoch").over(w)).where(F.col("__next").isNull() | (F.col("__next") > keep_from)).drop("__next")


def compact(log: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The newest row of each key, deletions too."""
    return _newest(log, key or ["key"])


def expired(log: DataFrame, now_ms: int, key: list[str] | None = None) -> DataFrame:
    return latest(log, key).where(F.col("expires_at") <= now_ms)


def purge_expired(log: DataFrame, now_ms: int, key: list[str] | None = None) -> DataFrame:
    keys = key or ["key"]
    return log.join(expired(log, now_ms, keys).select(*keys), keys, "left_anti")


def scan(df: DataFrame, limit: int | None = 20, offset: int = 0, order: str = "doc_id") -> DataFrame:
    out = df.orderBy(order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def cursor_of(id_: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(id_)), 16, "0")


def cursor_id(token: Column) -> Column:
    """The number, null for anything but sixteen lower-case digits."""
    return F.when(token.rlike("^[0-9a-f]{16}$"), F.conv(token, 16, 10).cast("decimal(20,0)"))


def page(df: DataFrame, limit: int, after: str | None = None, order: str = "doc_id") -> DataFrame:
    """The next rows after a cursor, each with the cursor that goes on from it."""
    if after is not None:
        if len(after) != 16 or any(c not in "0123456789abcdef" for c in after):
            raise ValueError("not a cursor")
        df = df.where(F.col(order) > int(after, 16))
    return df.orderBy(order).limit(limit).withColumn("cursor", cursor_of(F.col(order)))


def point_get(df: DataFrame, key, column: str = "key") -> DataFrame:
    return df.where(F.col(column) == F.lit(key))


def prefix_scan(df: DataFrame, prefix: str, column: str = "key") -> DataFrame:
    """Keys with a prefix; the condition reaches the Parquet scan."""
    return df.where(F.col(column).startswith(prefix))


def parse_as_of(value: Column) -> Column:
    """Milliseconds; what is under 10**12 is in seconds; null for what isn't a natural number."""
    number = value.try_cast("bigint")
    return F.when(value.rlike(r"^\d+$") & number.isNotNull(), F.when(number < 1_000_000_000_000, number * 1000).otherwise(number))
