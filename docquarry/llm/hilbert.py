"""Sharding by Hilbert-curve order.

Several metadata columns are quantised to ``BITS`` bits each, the cells are put in
the order of a Hilbert curve through the grid, and the sorted rows are cut into runs
of ``RUN_ROWS``.  Rows of a run are close in all dimensions at once, so a file or row
group per run has narrow ranges of each, and filters on any of them skip most runs.

A dimension is ``linear`` (equal widths between the least and the greatest value),
``log`` (equal ratios, of the distance from the least value) or ``rank`` (equal
numbers of distinct values in byte order).  Cell 0 is for nulls and NaN.

Positions in the global order come from a range shuffle, written once to the shared
checkpoint folder, and a count for each partition; no step puts the rows into one
task, and only the columns that are named take part.

Defined cases: nulls share cell 0; a column of one value has cell 1; ties on the
curve go by id, null ids first; rows that repeat take neighbouring places; an empty
table gives an empty result.  Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import positioned

BITS, RUN_ROWS = 8, 8192
DIMENSIONS = (("doc_id", "linear"), ("n_chars", "log"), ("lang", "rank"), ("source", "rank"))


def curve_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Places on the curve (Skilling's transposed form, then the bits interleaved)."""
    x = [np.asarray(c).astype(np.int64).copy() for c in cells]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def cells(docs: DataFrame, dimensions=DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """(id, d0, d1, ...): the id as a long and each row's cell in each dimension; with ``whole`` the row too, as a struct."""
    top = (1 << bits) - 2
    own = docs.select(docs[id_col].cast("long").alias("id"), *(docs[c].cast("double" if kind != "rank" else "string").alias(f"v{i}") for i, (c, kind) in enumerate(dimensions)), *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if whole else []))
    numeric = [i for i, (_, kind) in enumerate(dimensions) if kind != "rank"]
    ends = own.agg(F.count("*").alias("n"), *(f(F.when(~F.isnan(f"v{i}"), F.col(f"v{i}"))).alias(f"{f.__name__}{i}") for i in numeric for f in (F.min, F.max))).first()
    for i, (_, kind) in enumerate(dimensions):
        v = F.col(f"v{i}")
        if kind == "rank":
            ranks = positioned(own.select(v.alias(f"r{i}")).where(v.isNotNull()).distinct(), [F.col(f"r{i}")], "rank")
            last = ranks.count() - 1
            ranks = ranks.select(f"r{i}", (F.lit(1) + (F.floor(F.col("rank") * top / F.lit(last)) if last > 0 else F.lit(0))).cast("int").alias(f"c{i}"))
            own = own.join(ranks, v == ranks[f"r{i}"], "left").drop(f"r{i}").withColumn(f"d{i}", F.coalesce(f"c{i}", F.lit(0))).drop(f"c{i}")
            continue
        lo, hi = ends[f"min{i}"], ends[f"max{i}"]
        if lo is None or hi == lo:
            at = F.lit(1)
        elif kind == "log":
            at = F.lit(1) + F.floor(F.log(v - F.lit(lo) + F.lit(1.0)) * F.lit(float(top)) / F.log(F.lit(hi) - F.lit(lo) + F.lit(1.0)))
        else:
            at = F.lit(1) + F.floor((v - F.lit(lo)) * F.lit(float(top)) / (F.lit(hi) - F.lit(lo)))
        own = own.withColumn(f"d{i}", F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(F.least(at, F.lit(top + 1))).cast("int"))
    return own.select("id", *(f"d{i}" for i in range(len(dimensions))), *(["row"] if whole else []))


def shards(docs: DataFrame, dimensions=DIMENSIONS, bits: int = BITS, run_rows: int = RUN_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(id, curve, position, run, d0, d1, ...) of every row, the id under its own name."""
    out = _placed(docs, dimensions, bits, id_col, False)
    return out.select(F.col("id").alias(id_col), "curve", "position", F.floor(F.col("position") / F.lit(run_rows)).cast("long").alias("run"), *(f"d{i}" for i in range(len(dimensions))))


def _placed(docs: DataFrame, dimensions, bits: int, id_col: str, whole: bool) -> DataFrame:
    names = [f"d{i}" for i in range(len(dimensions))]
    if bits * len(names) > 63:
        raise ValueError("the curve's index takes bits times dimensions, 63 at most")

    @F.pandas_udf("long")
    def index(*dims: pd.Series) -> pd.Series:
        return pd.Series(curve_index([d.to_numpy() for d in dims], bits))

    placed = cells(docs, dimensions, bits, id_col, whole).withColumn("curve", index(*names))
    return positioned(placed, [F.col("curve").asc(), F.col("id").asc_nulls_first()])


def zone_map(docs: DataFrame, assigned: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """(run, n, min and max of each column): what a reader prunes runs by."""
    own = docs.select(docs[id_col].cast("long").alias("__id"), *(docs[c] for c in columns if c != id_col)).distinct()
    both = assigned.select("run", F.col(id_col).alias("__id")).join(own, "__id")
    return both.groupBy("run").agg(F.count("*").alias("n"), *(f(F.col("__id" if c == id_col else c)).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)))


def write_runs(docs: DataFrame, path: str, dimensions=DIMENSIONS, bits: int = BITS, run_rows: int = RUN_ROWS, id_col: str = "doc_id") -> None:
    """All rows of ``docs``, null and repeated ids too, as Parquet in the order of the curve, a file for each run of at most ``run_rows``.

    The rows go along through the range shuffle, so nothing is joined back by the id;
    a partition's last file may be short.
    """
    out = _placed(docs, dimensions, bits, id_col, True)
    out.select("row.*").write.option("maxRecordsPerFile", run_rows).parquet(path)


def _oracle() -> str:
    n, top = len(DIMENSIONS), (1 << BITS) - 2
    sql, ends = [], []
    for i, (c, kind) in enumerate(DIMENSIONS):
        if kind == "rank":
            ends.append(f"r{i} AS (SELECT {c} AS k{i}, (1 + CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY {c}) - 1) * {top} // (count(*) OVER () - 1) ELSE 0 END) AS c{i} FROM (SELECT DISTINCT {c} FROM documents WHERE {c} IS NOT NULL))")
            sql.append(f"coalesce(c{i}, 0)::BIGINT AS x{i}")
        else:
            v, lo, hi = f"{c}::DOUBLE", f"(SELECT min({c})::DOUBLE FROM documents)", f"(SELECT max({c})::DOUBLE FROM documents)"
            at = f"ln({v} - {lo} + 1) * {top}::DOUBLE / ln({hi} - {lo} + 1)" if kind == "log" else f"({v} - {lo}) * {top}::DOUBLE / ({hi} - {lo})"
            sql.append(f"(CASE WHEN {c} IS NULL THEN 0 WHEN {hi} = {lo} THEN 1 ELSE least(1 + floor({at}), {top + 1}) END)::BIGINT AS x{i}")
    keep = ", ".join(f"d{i}" for i in range(n))
    xs = [f"x{i}" for i in range(n)]
    steps = [f"s0 AS (SELECT doc_id, {', '.join(x.split(' AS ')[0] + f' AS d{i}' for i, x in enumerate(sql))} FROM documents " + " ".join(f"LEFT JOIN r{i} ON {c} = k{i}" for i, (c, k) in enumerate(DIMENSIONS) if k == "rank") + ")", f"t0 AS MATERIALIZED (SELECT doc_id, {keep}, {', '.join(f'd{i} AS x{i}' for i in range(n))} FROM s0)"]
    last, k = "t0", 0

    def add(changes: dict[str, str]) -> None:
        nonlocal last, k
        k += 1
        steps.append(f"t{k} AS MATERIALIZED (SELECT doc_id, {keep}, {', '.join(changes.get(x, x) + f' AS {x}' for x in xs)} FROM {last})")
        last = f"t{k}"

    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            t = f"(CASE WHEN x{i} & {q} <> 0 THEN 0 ELSE xor(x0, x{i}) & {p} END)"
            if i:
                add({"x0": f"xor(x0, CASE WHEN x{i} & {q} <> 0 THEN {p} ELSE {t} END)", f"x{i}": f"xor(x{i}, {t})"})
            else:
                add({"x0": f"CASE WHEN x0 & {q} <> 0 THEN xor(x0, {p}) ELSE x0 END"})
        q >>= 1
    for i in range(1, n):
        add({f"x{i}": f"xor(x{i}, x{i - 1})"})
    t = "0"
    for b in range(1, BITS):
        t = f"xor({t}, CASE WHEN x{n - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    add({x: f"xor({x}, {t})" for x in xs})
    bits = " + ".join(f"((x{i} >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(BITS) for i in range(n))
    return f"WITH {', '.join(ends + steps)}, placed AS (SELECT doc_id, {bits} AS curve, {keep} FROM {last}), numbered AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST) - 1 AS position FROM placed) SELECT doc_id, curve::BIGINT AS curve, position, position // {RUN_ROWS} AS run, {', '.join(f'd{i}::INT AS d{i}' for i in range(n))} FROM numbered"


ORACLE_SQL = _oracle()
