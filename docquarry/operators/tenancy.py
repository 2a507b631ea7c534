"""Tenants: quotas, keys, activity."""

from __future__ import annotations

import hashlib
import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("read", "write", "admin")


class QuotaExceeded(Exception):
    pass


class PermissionDenied(Exception):
    pass


@dataclass(frozen=True)
class Quota:
    collections: int | None = None
    bytes: int | None = None
    ops_per_second: int | None = None


@dataclass
class Keys:
    """API keys by their digests; without any key everything is allowed."""

    levels: dict[str, str] = field(default_factory=dict)
    most: int = 64

    def add(self, level: str = "read", key: str | None = None) -> str:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}")
        if len(self.levels) >= self.most:
            raise QuotaExceeded("too many keys")
        key = key or secrets.token_urlsafe(24)
        self.levels[hashlib.sha256(key.encode()).hexdigest()] = level
        return key

    def level(self, key: str | None) -> str | None:
        return "admin" if not self.levels else self.levels.get(hashlib.sha256((key or "").encode()).hexdigest())

    def require(self, key: str | None, level: str) -> None:
        own = self.level(key)
        if own is None or LEVELS.index(own) < LEVELS.index(level):
            raise PermissionDenied(f"this needs {level}")


def over_quota(ops: DataFrame, limit: int, tenant: str = "tenant", ts: str = "ts", order: str = "id") -> DataFrame:
    """The operations beyond ``limit`` in their tenant's second."""
    w = Window.partitionBy(tenant, F.date_trunc("second", F.col(ts))).orderBy(ts, order)
    return ops.withColumn("n", F.row_number().over(w)).where(F.col("n") > limit)


def storage(log: DataFrame, limits: DataFrame) -> DataFrame:
    """(tenant, bytes, limit, over) of all tenants with a limit."""
    used = log.groupBy("tenant").agg(F.sum(F.octet_length("value")).alias("bytes"))
    return limits.join(used, "tenant", "left").fillna({"bytes": 0}).withColumn("over", F.col("bytes") > F.col("limit"))


def activity(idle_seconds: Column, per_second: Column) -> Column:
    """deep from 30 minutes idle, light from one, hot from 100 queries a second, else warm."""
    return F.when(idle_seconds >= 1800, "deep").when(idle_seconds >= 60, "light").when(per_second >= 100, "hot").otherwise("warm")
