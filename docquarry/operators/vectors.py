"""Vector search: exact, int8, b-bit codes with table lookups, clusters.

Approximate searches take candidates by approximate scores and rank them by exact
ones, for each metric as it is defined.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from ..functions.vector import dot, literal, score
from .search import vector_scores

exact = vector_scores


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def codebook(bits: int) -> np.ndarray:
    """Lloyd-Max levels of the standard normal distribution."""
    cdf = lambda x: 0.5 * (1 + erf(x / sqrt(2)))
    pdf = lambda x: exp(-x * x / 2) / sqrt(2 * pi)
    levels = np.linspace(-2, 2, 1 << bits)
    for _ in range(300):
        edges = [-np.inf, *((levels[1:] + levels[:-1]) / 2), np.inf]
        levels = np.array([(pdf(a) - pdf(b)) / max(1e-12, cdf(b) - cdf(a)) for a, b in zip(edges, edges[1:])])
    return levels


def pack_bits(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes as bytes, the lowest bits first."""
    flat = (codes[..., None].astype(np.uint8) >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(flat.reshape(*codes.shape[:-1], -1), axis=-1, bitorder="little")


def unpack_bits(data: np.ndarray, bits: int, dims: int) -> np.ndarray:
    flat = np.unpackbits(data, axis=-1, bitorder="little")[..., : bits * dims].reshape(*data.shape[:-1], dims, bits)
    return (flat << np.arange(bits, dtype=np.uint8)).sum(-1).astype(np.uint8)


class Quantizer:
    """b bits a dimension after a random rotation; the vector's length is kept beside the codes."""

    def __init__(self, dims: int, bits: int = 4, seed: int = 42):
        if not 1 <= bits <= 4:
            raise ValueError("1 to 4 bits")
        self.dims, self.bits, self.rotation = dims, bits, rotation(dims, seed)
        self.levels = codebook(bits) / sqrt(dims)
        self.edges = (self.levels[1:] + self.levels[:-1]) / 2

    def quantize(self, x: np.ndarray) -> np.ndarray:
        """Rows of 4 bytes of length and the packed codes."""
        length = np.linalg.norm(x, axis=1).astype("<f4")
        unit = x / np.where(length > 0, length, 1)[:, None]
        codes = np.searchsorted(self.edges, unit @ self.rotation.T).astype(np.uint8)
        return np.concatenate([length[:, None].view(np.uint8).reshape(len(x), 4), pack_bits(codes, self.bits)], axis=1)

    def split(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.ascontiguousarray(data[:, :4]).view("<f4")[:, 0].astype(np.float64), unpack_bits(data[:, 4:], self.bits, self.dims)

    def dequantize(self, data: np.ndarray) -> np.ndarray:
        length, codes = self.split(data)
        return length[:, None] * (self.levels[codes] @ self.rotation)

    def table(self, query: np.ndarray) -> np.ndarray:
        """Products of the rotated query with every level: (dims, 2**bits)."""
        return (self.rotation @ query)[:, None] * self.levels[None, :]

    def dots(self, data: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Approximate dot products, by looking up and adding."""
        length, codes = self.split(data)
        return length * self.table(query)[np.arange(self.dims), codes].sum(1)

    def squares(self, data: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Approximate squared distances."""
        length, codes = self.split(data)
        own = length**2 * (self.levels[codes] ** 2).sum(1)
        return own + float(query @ query) - 2 * self.dots(data, query)

    def symmetric_squares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances between two rows of codes each."""
        (la, ca), (lb, cb) = self.split(a), self.split(b)
        return ((la[:, None] * self.levels[ca] - lb[:, None] * self.levels[cb]) ** 2).sum(1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint8) for x in column.to_pylist()]) if len(column) else np.empty((0, 4), np.uint8)


def quantized(vectors: DataFrame, q: Quantizer, vector: str = "embedding") -> DataFrame:
    """``vectors`` of the quantizer's length with a binary column ``codes``."""

    @F.arrow_udf(BinaryType())
    def code(column: pa.Array) -> pa.Array:
        return pa.array([r.tobytes() for r in q.quantize(_matrix(column, q.dims))], pa.binary())

    return vectors.where(F.size(vector) == q.dims).withColumn("codes", code(F.col(vector)))


def quantized_search(coded: DataFrame, q: Quantizer, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vector: str | None = "embedding") -> DataFrame:
    """The k best of 2k candidates by their codes; ``vector=None``: by the codes alone."""
    target = np.array(query, float)

    @F.arrow_udf(DoubleType())
    def near(codes: pa.Array) -> pa.Array:
        data = _bytes(codes)
        if not len(data):
            return pa.array([], pa.float64())
        if metric == "l2":
            return pa.array(np.sqrt(np.maximum(0, q.squares(data, target))))
        dots = q.dots(data, target)
        if metric == "cosine":
            lengths = q.split(data)[0] * np.linalg.norm(target)
            dots = np.where(lengths > 0, dots / np.where(lengths > 0, lengths, 1), 0)
        return pa.array(dots)

    best = F.asc("near") if metric == "l2" else F.desc("near")
    rough = coded.withColumn("near", near("codes")).orderBy(best, id_col).limit(2 * k if vector else k)
    return vector_scores(rough, query, k, vector, id_col, metric) if vector else rough.select(id_col, F.col("near").alias("score"))


def int8_codes(vector: Column) -> tuple[Column, Column]:
    """(codes, scale): rounded to -127..127, as JVM expressions."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return F.transform(vector, lambda x: F.round(x / scale).cast("tinyint")), scale


def with_int8(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    codes, scale = int8_codes(F.col(vector))
    return vectors.withColumn("codes", codes).withColumn("scale", scale)


def int8_search(coded: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", oversample: int = 4) -> DataFrame:
    """Candidates by integer products, the k best of them by exact scores."""
    top = max((abs(float(x)) for x in query), default=0.0) or 1.0
    own = [round(float(x) * 127 / top) for x in query]
    product = F.aggregate(F.zip_with("codes", F.array(*map(F.lit, own)), lambda x, y: x.cast("int") * y), F.lit(0), lambda a, x: a + x)
    approximate = product * F.col("scale") * F.lit(top / 127)
    squares = F.aggregate("codes", F.lit(0), lambda a, x: a + x.cast("int") * x.cast("int")) * F.col("scale") * F.col("scale")
    if metric == "l2":
        order = F.asc(squares - 2 * approximate)
    elif metric == "cosine":
        order = F.desc(F.when(squares > 0, approximate / F.sqrt(squares)).otherwise(F.lit(0.0)))
    else:
        order = F.desc(approximate)
    rough = coded.where(F.size(vector) == len(query)).orderBy(order, id_col).limit(oversample * k)
    return vector_scores(rough, query, k, vector, id_col, metric)


class Clusters:
    """k-means cells, each with what bounds its vectors: their number, the farthest from the centre, the widest angle to it.

    A search looks into the cells in the order of their centres' distance to the
    query until they hold k vectors, and from there on into all whose bound
    reaches the k-th best score found, so it misses nothing; ``probes`` looks into
    that many cells only, whatever is lost.
    """

    def __init__(self, vectors: DataFrame, clusters: int = 16, seed: int = 42, vector: str = "embedding"):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        ready = vectors.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
        model = KMeans(k=clusters, seed=seed, maxIter=10, featuresCol="__v", predictionCol="cluster").fit(ready)
        self.centers = np.array(model.clusterCenters())
        self.assigned = model.transform(ready).drop("__v")
        self.bounds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _bounds(self, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By cell: vectors, largest distance from the centre, largest angle to it (pi where one of the two has no length)."""
        if vector not in self.bounds:
            centers = self.centers

            @F.arrow_udf("struct<far: double, wide: double>")
            def spread(column: pa.Array, cluster: pa.Array) -> pa.Array:
                x, c = _matrix(column, centers.shape[1]), centers[cluster.to_numpy()]
                lengths = np.linalg.norm(x, axis=1) * np.linalg.norm(c, axis=1)
                cosine = np.where(lengths > 0, (x * c).sum(1) / np.where(lengths > 0, lengths, 1), -1.0)
                return pa.StructArray.from_arrays([pa.array(np.linalg.norm(x - c, axis=1)), pa.array(np.arccos(np.clip(cosine, -1, 1)))], ["far", "wide"])

            rows = self.assigned.select("cluster", spread(vector, "cluster").alias("s")).groupBy("cluster").agg(F.count("*").alias("n"), F.max("s.far").alias("far"), F.max("s.wide").alias("wide")).collect()  # a row for each cell
            n, far, wide = np.zeros(len(centers), np.int64), np.zeros(len(centers)), np.zeros(len(centers))
            for r in rows:
                n[r.cluster], far[r.cluster], wide[r.cluster] = r.n, r.far, r.wide
            self.bounds[vector] = n, far, wide
        return self.bounds[vector]

    def cells(self, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding") -> list[int]:
        """The cells that may hold one of the k best."""
        n, far, wide = self._bounds(vector)
        target = np.array(query, float)
        length, lengths = np.linalg.norm(target), np.linalg.norm(self.centers, axis=1)
        away = np.linalg.norm(self.centers - target, axis=1)
        order = np.argsort(away, kind="stable")
        first = order[: int(np.searchsorted(n[order].cumsum(), k)) + 1]
        found = [r.score for r in vector_scores(self.assigned.where(F.col("cluster").isin(first.tolist())), query, k, vector, id_col, metric).collect()]  # at most k rows
        if len(found) < k:
            return order.tolist()
        if metric == "l2":
            best, worst = -np.maximum(0, away - far), -found[-1]
        elif metric == "dot":
            best, worst = self.centers @ target + length * far, found[-1]
        else:
            both = length * lengths
            angle = np.arccos(np.clip(np.where(both > 0, self.centers @ target / np.where(both > 0, both, 1), 1.0), -1, 1))
            best, worst = np.cos(np.maximum(0, angle - wide)), found[-1]
            best = np.where(wide >= np.pi, 1.0, best)  # a vector without length scores 0
        slack = 1e-6 * (1 + abs(worst))
        return sorted({*first.tolist(), *np.flatnonzero((n > 0) & ~(best < worst - slack)).tolist()})

    def search(self, query: Sequence[float], k: int, probes: int | None = None, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        if probes is None:
            near = self.cells(query, k, metric, id_col, vector)
        else:
            near = np.argsort(((self.centers - np.array(query, float)) ** 2).sum(1))[:probes].tolist()
        return vector_scores(self.assigned.where(F.col("cluster").isin(near)), query, k, vector, id_col, metric)


def memory_bytes(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.agg(F.count("*").alias("vectors"), F.coalesce(F.sum(F.size(vector) * 4), F.lit(0)).alias("bytes"))


__all__ = ["Clusters", "Quantizer", "dot", "exact", "int8_search", "literal", "quantized", "quantized_search", "score", "with_int8"]
