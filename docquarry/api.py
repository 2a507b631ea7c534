"""Indexes with a memory: text and vectors that are searched again and again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import search as S
from .operators import vectors as X


class TextIndex:
    """A table of texts and the postings of its trigrams, in Parquet sorted by trigram."""

    def __init__(self, docs: DataFrame, postings: DataFrame, column: str = "text", key: str = "doc_id"):
        self.docs, self.postings, self.column, self.key = docs, postings, column, key

    @classmethod
    def build(cls, docs: DataFrame, path: str, column: str = "text", key: str = "doc_id") -> TextIndex:
        """Files hold ranges of trigrams, so that a search reads few row groups of few files."""
        S.postings(docs, column, key).repartitionByRange("tri").sortWithinPartitions("tri", key).write.option("parquet.bloom.filter.enabled#tri", "true").parquet(path)
        return cls.load(docs, path, column, key)

    @classmethod
    def load(cls, docs: DataFrame, path: str, column: str = "text", key: str = "doc_id") -> TextIndex:
        return cls(docs, docs.sparkSession.read.parquet(path), column, key)

    def add(self, more: DataFrame, path: str) -> TextIndex:
        """Appends the postings of new texts."""
        S.postings(more, self.column, self.key).repartitionByRange("tri").sortWithinPartitions("tri", self.key).write.mode("append").parquet(path)
        return TextIndex.load(self.docs.unionByName(more), path, self.column, self.key)

    def remove(self, keys: DataFrame) -> TextIndex:
        return TextIndex(self.docs.join(keys, self.key, "left_anti"), self.postings.join(keys, self.key, "left_anti"), self.column, self.key)

    def search(self, query: str) -> DataFrame:
        return S.indexed_search(self.docs, self.postings, query, self.column, self.key)

    def regex(self, pattern: str) -> DataFrame:
        own = S.regex_candidates(self.postings, pattern, self.key)
        return S.regex_search(self.docs if own is None else self.docs.join(own, self.key, "left_semi"), pattern, self.column)


class VectorIndex:
    """Vectors with the codes that approximate searches use, made at the first such search."""

    def __init__(self, vectors: DataFrame, dims: int, id_col: str = "vec_id", vector: str = "embedding"):
        self.vectors, self.dims, self.id_col, self.vector = vectors, dims, id_col, vector
        self._int8: DataFrame | None = None
        self._coded: DataFrame | None = None
        self._quantizer: X.Quantizer | None = None
        self._clusters: X.Clusters | None = None

    def append(self, more: DataFrame) -> VectorIndex:
        wrong = more.where(f"size({self.vector}) <> {self.dims}").limit(1).count()
        if wrong:
            raise ValueError(f"vectors have {self.dims} dimensions here")
        return VectorIndex(self.vectors.unionByName(more), self.dims, self.id_col, self.vector)

    def exact(self, query: Sequence[float], k: int = 10, metric: str = "cosine") -> DataFrame:
        return X.exact(self.vectors, query, k, self.vector, self.id_col, metric)

    def int8(self, query: Sequence[float], k: int = 10, metric: str = "cosine") -> DataFrame:
        self._int8 = self._int8 if self._int8 is not None else X.with_int8(self.vectors, self.vector)
        return X.int8_search(self._int8, query, k, metric, self.id_col, self.vector)

    def quantized(self, query: Sequence[float], k: int = 10, metric: str = "cosine", bits: int = 4, codes_only: bool = False) -> DataFrame:
        if self._quantizer is None or self._quantizer.bits != bits:
            self._quantizer = X.Quantizer(self.dims, bits)
            self._coded = X.quantized(self.vectors, self._quantizer, self.vector)
        return X.quantized_search(self._coded, self._quantizer, query, k, metric, self.id_col, None if codes_only else self.vector)

    def clustered(self, query: Sequence[float], k: int = 10, metric: str = "cosine", clusters: int = 16, probes: int | None = None) -> DataFrame:
        self._clusters = self._clusters or X.Clusters(self.vectors, clusters, vector=self.vector)
        return self._clusters.search(query, k, probes, metric, self.id_col, self.vector)

    def memory(self) -> DataFrame:
        return X.memory_bytes(self.vectors, self.vector)


def read(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """Any table that Spark reads, to make a collection or an index of."""
    return spark.read.format(kind).options(**options).load(path)
