"""All-pairs nearest neighbours by a block matrix join.

Vectors are dealt to blocks by a hash of their id, and every pair of blocks is a
cell, to which both are sent; a cell looks from each block into the other, so each
pair of vectors meets once.  In a cell the vectors are quantised to int8 (a scale for
each vector).  A tile's products of integers, exact in a float32 matrix product as
they stay under 2**24, give approximate distances; what quantisation can add or take
away follows from the lengths of the residuals (Cauchy-Schwarz).  A pair whose least
possible distance is more than the k-th least of the greatest possible ones is
dropped, the rest is recomputed in float64 from the vectors, and heaps of k merge
tiles and cells.  Nothing true is dropped, so the result is that of brute force.

The number of cells, and so of copies of a block, grows with the number of blocks:
the join is one of all pairs.

Defined cases: unusable vectors (see ``neighbours``) are left out; a null id is passed
over; equal distances go by id; fewer than k others give as many as there are; an
empty table gives an empty result.  Other columns aren't read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, BLOCK, TILE = 10, 8192, 1024
_OUT = "vec_id long, neighbours array<long>, squares array<double>"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32), scales, lengths of the quantised vectors, lengths of the residuals."""
    top = np.abs(x).max(1, initial=0.0)
    scale = np.where(top > 0, top / 127.0, 1.0)
    codes = np.rint(x / scale[:, None])
    near = codes * scale[:, None]
    return codes.astype(np.int8).astype(np.float32), scale, np.sqrt((near**2).sum(1)), np.sqrt(((x - near) ** 2).sum(1))


def _prepared(x: np.ndarray):
    """Vectors, codes, and as columns: scales, squared lengths, what bounds a product's error; in float32 where that can't overflow."""
    codes, scale, near, rest = quantise(x)
    square = (x**2).sum(1)
    kind = np.float32 if square.max(initial=0.0) < 1e30 else np.float64
    return x, codes.astype(kind), scale.astype(kind), square.astype(kind), near, rest, np.sqrt(square)


def _tile(a, b, limit: np.ndarray, k: int, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, squared distance) of the pairs that survive; ``limit`` is the k-th least squared distance of each row so far."""
    (x, qx, sx, lx, nx, ex, rx), (y, qy, sy, ly, _, ey, ry) = a, b
    exact = x.shape[1] * 127 * 127 < 1 << 24  # of integers in float32
    square = qx @ qy.T if exact else (qx.astype(np.float64) @ qy.astype(np.float64).T)
    square *= sx[:, None]
    square *= -2 * sy
    square += lx[:, None]
    square += ly
    # |xy - x'y'| <= |x'||y - y'| + |x - x'||y|, for the tile's worst y; then the rounding of the sums above
    slack = 2.0 * (nx * ey.max() + ex * ry.max()) + 1e-5 * (rx**2 + ry.max() ** 2) + 1e-30
    if same is not None:
        square[same] = np.inf
    open_ = np.flatnonzero(np.isinf(limit))
    if len(open_) and square.shape[1] >= k:
        limit = limit.copy()
        limit[open_] = np.partition(square[open_], k - 1, axis=1)[:, k - 1] + slack[open_]
    row, column = np.nonzero(square <= (limit + slack)[:, None])
    if same is not None:
        ok = ~same[row, column]
        row, column = row[ok], column[ok]
    return row, column, ((x[row] - y[column]) ** 2).sum(1)


def search(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, k: int, tile: int = TILE) -> list[list[tuple[float, int]]]:
    """For each row of ``a`` the k nearest of ``b`` with another id, as (squared distance, id)."""
    order = np.argsort((b**2).sum(1), kind="stable")  # tiles of like lengths have close bounds
    ids_b, b = ids_b[order], b[order]
    full_a, full_b = _prepared(a), _prepared(b)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(a))]
    for lo in range(0, len(a), tile):
        part = tuple(v[lo : lo + tile] for v in full_a)
        n = len(part[0])
        limit = np.full(n, np.inf)
        kept_row, kept_id, kept_square = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(b), tile):
            other = tuple(v[at : at + tile] for v in full_b)
            same = ids_a[lo : lo + tile, None] == ids_b[None, at : at + tile]
            row, column, square = _tile(part, other, limit, k, same if same.any() else None)
            row = np.concatenate([kept_row, row])
            num = np.concatenate([kept_id, ids_b[at + column]])
            square = np.concatenate([kept_square, square])
            order = np.lexsort((num, square, row))
            row, num, square = row[order], num[order], square[order]
            start = np.searchsorted(row, np.arange(n))
            keep = np.arange(len(row)) - start[row] < k
            kept_row, kept_id, kept_square = row[keep], num[keep], square[keep]
            count = np.bincount(kept_row, minlength=n)
            full = np.flatnonzero(count == k)
            limit[full] = kept_square[np.cumsum(count)[full] - 1]
        for r, s, i in zip(kept_row.tolist(), kept_square.tolist(), kept_id.tolist()):
            heaps[lo + r].append((s, i))
    return heaps


def _cells(k: int):
    def run(batches):
        """The input is sorted by cell: length, first and last block, own block, id, vector."""
        rest: list[pa.RecordBatch] = []

        def of(t: pa.Table):
            t = t.combine_chunks()
            block, ids = t.column("block").to_numpy(), t.column("vec_id").to_numpy()
            vectors = t.column("vector")
            flat = np.concatenate([c.flatten().to_numpy() for c in vectors.chunks]) if vectors.num_chunks else np.empty(0)
            x = flat.astype(np.float64).reshape(len(ids), -1)
            first, last = t.column("first")[0].as_py(), t.column("last")[0].as_py()
            own, other = block == first, block == last
            jobs = [(own, other)] if first == last else [(own, other), (other, own)]
            for p, q in jobs:
                if p.any() and q.any():
                    heaps = search(ids[p], x[p], ids[q], x[q], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array([[i for _, i in h] for h in heaps], pa.list_(pa.int64())), pa.array([[s for s, _ in h] for h in heaps], pa.list_(pa.float64()))], ["vec_id", "neighbours", "squares"])

        for batch in batches:
            at = [batch.column(c).to_numpy() for c in range(3)]
            new = np.zeros(max(0, len(batch) - 1), bool)
            for x in at:
                new |= x[1:] != x[:-1]
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if rest and any(rest[-1].column(c)[0].as_py() != at[c][a] for c in range(3)):
                    yield from of(pa.Table.from_batches(rest))
                    rest = []
                rest.append(part)
        if rest:
            yield from of(pa.Table.from_batches(rest))

    return run


def _merge(k: int):
    def run(batches):
        """Heaps of k over the cells' lists; the input is sorted by vec_id."""
        now, heap = None, []
        for batch in batches:
            out: list[tuple[int, int, int, float]] = []
            for v, ids, squares in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if v != now:
                    out += [(now, r, -i, -s) for r, (s, i) in enumerate(sorted(heap, reverse=True), 1)]
                    now, heap = v, []
                for s, i in zip(squares, ids):
                    if len(heap) < k:
                        heapq.heappush(heap, (-s, -i))
                    elif (-s, -i) > heap[0]:
                        heapq.heapreplace(heap, (-s, -i))
                    else:
                        break  # each list is sorted
            yield _rows(out)
        yield _rows([(now, r, -i, -s) for r, (s, i) in enumerate(sorted(heap, reverse=True), 1)])

    return run


def _rows(rows: list) -> pa.RecordBatch:
    v, r, i, s = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(r, pa.int32()), pa.array(i, pa.int64()), pa.array([round(math.sqrt(x), 6) for x in s], pa.float64())], ["vec_id", "rank", "neighbour", "distance"])


def neighbours(vectors: DataFrame, k: int = K, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbour, distance): every vector's k nearest others by Euclidean distance, rounded to six decimals.

    Vectors of different lengths have no distance: each length is searched by itself.
    Left out: null ids and vectors, empty vectors, vectors with a null or a value that
    isn't finite.  Of the rows of one id the vector that sorts first counts.
    """
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"))
    fine = own.where("vec_id is not null and size(vector) > 0").where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    fine = fine.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))
    lengths = fine.groupBy("size").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = fine.join(lengths, "size").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    sent = dealt.select("size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), "block", "vec_id", "vector")
    sent = sent.select("size", F.least("x", "block").alias("first"), F.greatest("x", "block").alias("last"), "block", "vec_id", F.col("vector").cast("array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>").alias("vector"))
    # a number of its own: cells are much work in few bytes, so adaptive execution mustn't join these partitions
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = sent.repartition(parts, "size", "first", "last").sortWithinPartitions("size", "first", "last").mapInArrow(_cells(k), _OUT)
    return found.repartition("vec_id").sortWithinPartitions("vec_id").mapInArrow(_merge(k), "vec_id long, rank int, neighbour long, distance double").where("vec_id is not null")


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, min(embedding)::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, neighbour) AS rank FROM p)
SELECT vec_id, rank::INT AS rank, neighbour, round(sqrt(s), 6) AS distance FROM r WHERE rank <= {K}
"""
