"""Encodings in logical form: dictionaries, runs, bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import positioned


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): codes from 0 in the order of the values' first rows."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    return positioned(firsts, [F.col("first"), F.col("value")], "code").select("value", "code")


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    return df.join(codes.select(F.col("value").alias(column), "code"), column, "left")


def decode(df: DataFrame, codes: DataFrame) -> DataFrame:
    return df.join(codes, "code", "left")


#: Rows that a task sorts, about, and at most; of a larger group all.  Up to 200 partitions a shuffle's writers keep no rows in memory.
TASK_ROWS, MOST_ROWS, UNSORTED = 1 << 17, 1 << 21, 200


def runs(df: DataFrame, value: str, order: list[str], within: list[str]) -> DataFrame:
    """(within..., run, value, first_row, rows): neighbouring equal values; rows count from 0 in each group.

    The partitions follow the number of rows, so that a task's memory doesn't; one sort
    serves all windows, and a run ends where the next begins, so nothing is grouped.
    """
    w = Window.partitionBy(*within).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = df.select(*dict.fromkeys([*within, *order, value]))
    n = own.count()
    spread = own.repartition(max(1, min(UNSORTED, -(-n // TASK_ROWS)), -(-n // MOST_ROWS)), *within)
    same = F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)
    starts = spread.withColumns({"__row": F.row_number().over(w) - 1, "__all": F.count(F.lit(1)).over(whole), "__same": same}).where("NOT __same")
    end = F.coalesce(F.lead("__row").over(w).cast("long"), F.col("__all"))
    return starts.select(*within, (F.row_number().over(w).cast("long") - 1).alias("run"), value, F.col("__row").alias("first_row"), (end - F.col("__row")).alias("rows"))


def run_at(encoded: DataFrame, row: int) -> DataFrame:
    """The run that holds a row."""
    return encoded.where((F.col("first_row") <= row) & (F.col("first_row") + F.col("rows") > row))


def run_ratio(encoded: DataFrame) -> DataFrame:
    """(ratio): rows for each run, 1.0 for no rows."""
    return encoded.agg(F.coalesce(F.try_divide(F.sum("rows"), F.count("*")), F.lit(1.0)).alias("ratio"))


def bitmap(df: DataFrame, column: str) -> DataFrame:
    """(bucket, bits): a set of natural numbers as bitmaps of 32,768 each."""
    return df.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(column).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(column))).alias("bits"))


def bitmap_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b).groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where("n = 2").select("bucket", "bits")


def bitmap_size(bits: DataFrame) -> DataFrame:
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("size"))


def bitmap_values(bits: DataFrame) -> DataFrame:
    """(value): the numbers of a set."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("bits") - 1)).alias("at")
    byte = bits.select("bucket", "bits", at).select("bucket", "at", F.conv(F.hex(F.substr("bits", F.col("at").cast("int") + 1, F.lit(1))), 16, 10).cast("int").alias("byte"))
    each = byte.where("byte <> 0").select("bucket", "at", F.explode(F.filter(F.array(*(F.when(F.col("byte").bitwiseAND(1 << b) != 0, F.lit(b)) for b in range(8))), lambda b: b.isNotNull())).alias("bit"))
    place = F.col("at") * 8 + F.col("bit")  # buckets from 1 on begin with 1, 32769, ...; 0 and what is under it count downwards
    return each.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(F.col("bucket") * 32768 - place).cast("long").alias("value"))


def bitmap_contains(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """``df`` with whether its number is in the set, false for null."""
    own = df.withColumn("__bucket", F.bitmap_bucket_number(column))
    joined = own.join(bits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")), "__bucket", "left")
    at = F.bitmap_bit_position(F.col(column))
    byte = F.conv(F.hex(F.substr("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(at, F.lit(8)))), F.lit(2)) == 1, F.lit(False))
    return joined.withColumn("contained", held).drop("__bucket", "__bits")


#: Bits of a bitmap of ``bitmap``, and of a Bloom filter for each of its rows: with 7 hashes about one other row in 90,000 passes.
BLOCK, BLOOM_BITS = 32768, 32


def bloom_bits(rows: int) -> int:
    """The size of a Bloom filter for so many rows: 4 to 8 bytes a row, 2**20 bits at least."""
    return max(1 << 20, 1 << (BLOOM_BITS * rows).bit_length())


def _bloom_places(column: str, bits: int, hashes: int):
    """A row's block, from 1 on, and its places in there; all of a row's bits are in one block."""
    block = F.pmod(F.xxhash64(F.lit(hashes), F.col(column)), F.lit(max(1, bits // BLOCK))) + 1
    return block, [F.pmod(F.xxhash64(F.lit(k), F.col(column)), F.lit(BLOCK)) for k in range(hashes)]


def bloom(df: DataFrame, column: str, bits: int, hashes: int = 7) -> DataFrame:
    """(bucket, bits): a Bloom filter of ``bits`` bits, as ``bloom_bits`` gives them for the rows, as bitmaps; each task builds its own before the shuffle."""
    block, places = _bloom_places(column, bits, hashes)
    return bitmap(df.where(F.col(column).isNotNull()).select(F.explode(F.array(*((block - 1) * BLOCK + p + 1 for p in places))).alias("place")), "place")


def bloom_contains(df: DataFrame, column: str, built: DataFrame, bits: int, hashes: int = 7) -> DataFrame:
    """The rows that the filter may hold: all that it does, and a few more; ``bits`` and ``hashes`` are those of ``bloom``.

    A filter of up to 8 MB is broadcast; a larger one is left to Spark, as a join by block.
    """
    block, places = _bloom_places(column, bits, hashes)
    own = built.select(F.col("bucket").alias("__block"), F.col("bits").alias("__bloom"))
    out = df.where(F.col(column).isNotNull()).withColumn("__block", block).join(F.broadcast(own) if bits <= 1 << 26 else own, "__block")
    for at in places:
        byte = F.conv(F.hex(F.substr("__bloom", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out.where(F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(at, F.lit(8)))), F.lit(2)) == 1, F.lit(False)))
    return out.drop("__block", "__bloom")


def column_filter(df: DataFrame, column: str, op: str, value, id_col: str) -> DataFrame:
    """The ids of the rows whose column compares so; nulls and values of another kind never match."""
    kind, own = df.schema[column].dataType.typeName(), type(value)
    fits = {"string": own is str, "boolean": own is bool}.get(kind, own in (int, float))
    c, v = df[column], F.lit(value)
    test = {"eq": c == v, "ne": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op] if fits else F.lit(False)
    return df.where(F.coalesce(test, F.lit(False))).select(id_col)
