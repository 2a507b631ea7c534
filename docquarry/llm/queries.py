"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, hilbert, imatch, linededup, minhash, neighbours, packing, pii, quality, secrets
from .common import table


def op1_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.entities(table(spark, sf_dir, "documents"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(table(spark, sf_dir, "documents"))


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.duplicate_lines(table(spark, sf_dir, "documents")).drop("h")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op9_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


_ALL = (op1_pii_semicrf, op2_imatch, op3_hilbert_shards, op4_quality_resampling, op5_nearest_neighbours, op6_probminhash, op7_line_dedup, op8_secret_scan, op9_bin_packing, op10_bpe)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op2_imatch": imatch.ORACLE_SQL, "op3_hilbert_shards": hilbert.ORACLE_SQL, "op4_quality_resampling": quality.ORACLE_SQL, "op5_nearest_neighbours": neighbours.ORACLE_SQL}
