"""Branches: named overlays of keys over the main line.

``main`` is a live view (key, value, epoch); for conflicts and merges it may be the newest
row of every key, deletions too, with ``op``, so that a deletion counts as a change, ``writes`` the branches' writes (branch,
key, value, deleted, epoch), ``branches`` one row for each (name, base_epoch, status).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_writes(writes: DataFrame, branch: str | None = None) -> DataFrame:
    own = writes if branch is None else writes.where(F.col("branch") == branch)
    w = Window.partitionBy("branch", "key").orderBy(F.desc("epoch"))
    return own.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def view(main: DataFrame, writes: DataFrame, branch: str) -> DataFrame:
    """(key, value) as the branch sees them: its writes before the main line's, its deletions hide."""
    own = newest_writes(writes, branch).select("key", F.struct("value", "deleted").alias("o"))
    both = main.select("key", F.struct("value").alias("m")).join(own, "key", "full")
    return both.where(F.col("o").isNull() | ~F.col("o.deleted")).select("key", F.when(F.col("o").isNotNull(), F.col("o.value")).otherwise(F.col("m.value")).alias("value"))


def modified(main: DataFrame, writes: DataFrame, branch: str) -> DataFrame:
    """(key, change): added, modified or deleted against the main line."""
    own = newest_writes(writes, branch)
    joined = own.join(main.select("key", F.lit(True).alias("there")), "key", "left")
    return joined.select("key", F.when(F.col("deleted"), "deleted").when(F.col("there"), "modified").otherwise("added").alias("change"))


def conflicts(main: DataFrame, writes: DataFrame, branch: str, base_epoch: int) -> DataFrame:
    """(key): keys of the branch that the main line has changed at or after the fork."""
    own = newest_writes(writes, branch).select("key")
    return own.join(main.where(F.col("epoch") >= base_epoch).select("key"), "key", "left_semi")


def merge(main: DataFrame, writes: DataFrame, branch: str, base_epoch: int, epoch: int, resolved: list[str] | DataFrame | None = None) -> DataFrame:
    """The log rows (key, value, op, epoch) that bring the branch into the main line; keys in conflict stay out unless resolved."""
    own = newest_writes(writes, branch)
    clash = conflicts(main, writes, branch, base_epoch)
    if isinstance(resolved, DataFrame):
        clash = clash.join(resolved.select("key"), "key", "left_anti")
    elif resolved:
        clash = clash.where(~F.col("key").isin(resolved))
    joined = own.join(clash, "key", "left_anti").join((main.where("op <> 'delete'") if "op" in main.columns else main).select("key", F.lit(True).alias("there")), "key", "left")
    op = F.when(F.col("deleted"), "delete").when(F.col("there"), "update").otherwise("insert")
    return joined.where(~F.col("deleted") | F.col("there")).select("key", F.when(~F.col("deleted"), F.col("value")).alias("value"), op.alias("op"), F.lit(epoch).cast("long").alias("epoch"))


def compare(main: DataFrame, writes: DataFrame) -> DataFrame:
    """(key, main_value, views): every key that a branch wrote, with one view for each such branch."""
    own = newest_writes(writes).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("branch", "value", "deleted"))).alias("views"))
    return own.join(main.select("key", F.col("value").alias("main_value")), "key", "left").select("key", "main_value", "views")


def counts(main: DataFrame, writes: DataFrame, branch: str) -> DataFrame:
    found = modified(main, writes, branch)
    return found.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")))


def overlay_scan(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay rows (key, value, deleted), then base rows whose key isn't in it."""
    return overlay.where(~F.col("deleted")).select("key", "value").unionByName(base.select("key", "value").join(overlay.select("key"), "key", "left_anti"))
