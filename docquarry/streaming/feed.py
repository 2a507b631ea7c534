"""Change feeds and windows on Structured Streaming.

Sources are folders of Parquet: a collection's log, or any table that grows by files.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import hmac_sha256_native
from ..operators.search import postings


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def changes(log: DataFrame) -> DataFrame:
    """The feed of a log: (tenant, collection, key, value, op, seq); batch or stream."""
    return log.select("tenant", "collection", "key", "value", "op", F.col("epoch").alias("seq"))


def payload() -> F.Column:
    return F.to_json(F.struct("seq", "tenant", "collection", "key", "value", "op"))


def deliveries(feed: DataFrame, subscriptions: DataFrame, secret: str) -> DataFrame:
    """(subscription, seq, payload, signature): each change for each subscription of its tenant, to its collection or to all ('')."""
    s = subscriptions.alias("s")
    meets = (feed["tenant"] == F.col("s.tenant")) & ((F.col("s.collection") == "") | (F.col("s.collection") == feed["collection"]))
    joined = feed.withColumn("payload", payload()).join(s, meets)  # subscriptions are few: Spark broadcasts them by their size
    return joined.select(F.col("s.subscription").alias("subscription"), "seq", "payload").withColumn("signature", hmac_sha256_native(F.col("payload"), secret))


def deliver(feed: DataFrame, subscriptions: DataFrame, secret: str, target: str, checkpoint: str):
    """Writes the deliveries of a streaming feed, exactly once: the sink keeps a log of its batches."""
    return deliveries(feed, subscriptions, secret).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_order(feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls ``apply`` with each micro-batch, sorted by seq; the batch's number is its epoch."""
    return feed.writeStream.foreachBatch(lambda batch, n: apply(batch.orderBy("seq"), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_postings(docs: DataFrame, path: str, checkpoint: str, column: str = "text", key: str = "doc_id"):
    """Keeps a trigram index up with a stream of new texts, a micro-batch at a time."""
    return postings(docs, column, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lag(query) -> int:
    """Input rows a second that a query is behind, 0 at least: arrivals less what it gets through."""
    last = query.lastProgress or {}
    return max(0, round((last.get("inputRowsPerSecond") or 0) - (last.get("processedRowsPerSecond") or 0)))


def tumbling(events: DataFrame, width: str, ts: str = "ts", by: list[str] | None = None, late: str | None = None, value: str = "value") -> DataFrame:
    """Counts and sums in fixed windows; ``late``: the watermark of a stream."""
    return windowed(events, F.window(ts, width), ts, by, late, value)


def sliding(events: DataFrame, width: str, step: str, ts: str = "ts", by: list[str] | None = None, late: str | None = None, value: str = "value") -> DataFrame:
    return windowed(events, F.window(ts, width, step), ts, by, late, value)


def sessions(events: DataFrame, gap: str, ts: str = "ts", by: list[str] | None = None, late: str | None = None, value: str = "value") -> DataFrame:
    return windowed(events, F.session_window(ts, gap), ts, by, late, value)


def windowed(events: DataFrame, window: F.Column, ts: str, by: list[str] | None, late: str | None, value: str) -> DataFrame:
    source = events.withWatermark(ts, late) if late else events
    counted = source.groupBy(window.alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "total")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote, read again."""
    spark, name = stream.sparkSession, time.time_ns()
    out = f"{folder}/stream-{name}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}.state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}.state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
