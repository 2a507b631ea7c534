"""Routing: hash and range partitions, a ring of virtual nodes, shards and migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a64, fnv1a64_int, fnv1a64_mod

VIRTUAL = 150


def hash_partition(key: Column, n: int) -> Column:
    return fnv1a64_mod(key, n)


def range_partition(value: Column, boundaries: list[int]) -> Column:
    """The number of boundaries that are at most the value."""
    return F.size(F.filter(F.array(*map(F.lit, boundaries)), lambda b: b <= value))


def partition_stats(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(hash_partition(F.col(key), n).alias("partition")).agg(F.count("*").alias("docs"))


def ring(spark: SparkSession, nodes: list[str], virtual: int = VIRTUAL) -> DataFrame:
    """(node, place): the virtual nodes of each node."""
    rows = [(n, str(fnv1a64_int(f"{n}#{i}"))) for n in nodes for i in range(virtual)]
    return spark.createDataFrame(rows, "node string, place string").select("node", F.col("place").cast("decimal(20,0)").alias("place"))


def ring_owner(df: DataFrame, key: str, vnodes: DataFrame) -> DataFrame:
    """``df`` with the node of the first place at or after the key's hash, round the ring.

    The ring (nodes times virtual nodes) is cut into cells by the hash's upper bits; a
    cell has its own places and the next one after it, so a row looks at very few.
    """
    places = sorted((int(r.place), r.node) for r in vnodes.groupBy("place").agg(F.min("node").alias("node")).collect())
    bits = max(1, len(places).bit_length())
    cells: list[list[tuple[int, str]]] = [[] for _ in range(1 << bits)]
    for p, n in places:
        cells[p >> (64 - bits)].append((p, n))
    following = places[0][1]
    rows = []
    for c in range((1 << bits) - 1, -1, -1):
        rows.append((c, [str(p) for p, _ in cells[c]], [n for _, n in cells[c]] + [following]))
        following = cells[c][0][1] if cells[c] else following
    ring_cells = df.sparkSession.createDataFrame(rows, "__cell long, __places array<string>, __nodes array<string>").withColumn("__places", F.col("__places").cast("array<decimal(20,0)>"))
    hashed = df.withColumn("__h", fnv1a64(F.col(key))).withColumn("__cell", F.floor(F.col("__h") / F.lit(str(1 << (64 - bits))).cast("decimal(20,0)")).cast("long"))
    before = F.size(F.filter("__places", lambda p: p < F.col("__h")))
    return hashed.join(F.broadcast(ring_cells), "__cell").withColumn("node", F.element_at("__nodes", before + 1)).drop("__h", "__cell", "__places", "__nodes")


def ring_replicas(df: DataFrame, key: str, vnodes: DataFrame, count: int) -> DataFrame:
    """(key, replica, node): the next ``count`` different nodes round the ring.

    Each place stands for the list of nodes that follow it, so this is ``ring_owner`` once more.
    """
    places = sorted((int(r.place), r.node) for r in vnodes.groupBy("place").agg(F.min("node").alias("node")).collect())  # nodes times virtual nodes
    names = sorted({n for _, n in places})
    rows, after = [], []
    for p, n in reversed(places + places):  # twice, so that the end sees the beginning
        after = [n, *(x for x in after if x != n)][: len(names)]
        rows.append((str(p), ",".join(str(names.index(x)) for x in after[:count])))
    lists = df.sparkSession.createDataFrame(rows[len(places) :], "place string, node string").select("node", F.col("place").cast("decimal(20,0)").alias("place"))
    owned = ring_owner(df.select(key), key, lists).select(key, F.posexplode(F.split("node", ",")).alias("replica", "n"))
    return owned.select(key, "replica", F.element_at(F.array(*map(F.lit, names)), F.col("n").cast("int") + 1).alias("node"))


def owners(partitions: DataFrame, shards: DataFrame) -> DataFrame:
    """Partitions with their shard entries (partition, node)."""
    return partitions.join(shards, "partition", "left")


def migration_progress(migrations: DataFrame) -> DataFrame:
    """``migrations`` (state, transferred, total) with the share that is done."""
    share = F.coalesce(F.try_divide(F.col("transferred"), F.col("total")), F.lit(0.0))
    return migrations.withColumn("progress", F.when(F.col("state") == "done", 1.0).when(F.col("state") == "pending", 0.0).otherwise(share))


def overlapping_writes(transactions: DataFrame) -> DataFrame:
    """(first, second): pairs of a batch (batch, seq, write_set) that write a common key."""
    keys = transactions.select("batch", "seq", F.explode(F.array_distinct("write_set")).alias("k"))
    a, b = keys.select("batch", "k", F.col("seq").alias("first")), keys.select("batch", "k", F.col("seq").alias("second"))
    return a.join(b, ["batch", "k"]).where("first < second").select("batch", "first", "second").distinct()


def surviving(transactions: DataFrame) -> DataFrame:
    """Transactions that aren't the later one of an overlapping pair."""
    return transactions.join(overlapping_writes(transactions).select("batch", F.col("second").alias("seq")), ["batch", "seq"], "left_anti")
