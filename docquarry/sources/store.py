"""Collections on Parquet: an append-only log in a folder for each tenant and collection.

One writer at a time for each collection; readers see whole appends, as Spark commits
a job's files together.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import embedding
from ..functions.text import fnv1a64_int
from ..operators import branches as B
from ..operators import log as L
from ..operators.aggregates import aggregate
from ..operators.distribution import hash_partition
from ..operators.search import context, hybrid, search, word_hits, word_index
from ..operators.tenancy import Keys, Quota, QuotaExceeded
from ..operators.vectors import exact
from ..plans.filters import where
from ..session import checkpoint

LOG = "doc_id long, key string, value string, op string, version int, epoch long, ts_ms long, expires_at long, embedding array<float>"
WRITES = "branch string, key string, value string, deleted boolean, epoch long"
SETTLED = "branch string, key string, how string, at long"
BRANCHES = "name string, agent string, base_epoch long, status string, at long"
_NAME = re.compile(r"[A-Za-z0-9_.-]{1,64}")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of one object a line; without ``value`` the whole line counts, without ``key`` the line is passed over."""
    lines = spark.read.text(path).where(F.length("value") >= 2)
    found = lines.select(F.get_json_object("value", "$.key").alias("key"), F.coalesce(F.get_json_object("value", "$.value"), F.col("value")).alias("value"))
    return found.where("key is not null")


def read_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(key, value) of the text files under a folder; the key is the path in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    inside = F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/")) + "/", "")
    return files.select(inside.alias("key"), F.decode("content", "utf-8").alias("value"))


class Collection:
    def __init__(self, db: Database, tenant: str, name: str):
        self.db, self.tenant, self.name = db, tenant, name
        self.path = f"{db.path}/{tenant}/{name}"

    # reading

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.db.spark.read.schema(schema).parquet(f"{self.path}/{part}") if self.db.exists(f"{self.path}/{part}") else self.db.spark.createDataFrame([], schema)

    @property
    def log(self) -> DataFrame:
        return self._read("log", LOG)

    def view(self, now_ms: int | None = None) -> DataFrame:
        return L.latest(self.log, now_ms=int(time.time() * 1000) if now_ms is None else now_ms)

    def get(self, key: str) -> DataFrame:
        return L.latest(L.point_get(self.log, key), now_ms=int(time.time() * 1000))

    def as_of(self, epoch: int | None = None, ts_ms: int | None = None) -> DataFrame:
        return L.as_of_epoch(self.log, epoch) if epoch is not None else L.as_of_time(self.log, ts_ms)

    def scan(self, limit: int = 20, offset: int = 0, query: dict | str | None = None) -> DataFrame:
        found = self.view()
        return L.scan(where(found, query, "value") if query else found, limit, offset)

    def page(self, limit: int, after: str | None = None) -> DataFrame:
        return L.page(self.view(), limit, after)

    def find(self, query: dict | str) -> DataFrame:
        return where(self.view(), query, "value")

    def aggregate(self, field: str, query: dict | str | None = None) -> DataFrame:
        return aggregate(self.find(query) if query else self.view(), field, "value")

    def search(self, text: str, limit: int | None = None) -> DataFrame:
        return search(self.view(), text, "value", "key", limit)

    def words(self, word: str) -> DataFrame:
        return word_hits(word_index(self.view(), "value", "key"), word, "key")

    def nearest(self, query: Sequence[float], k: int = 10, metric: str = "cosine") -> DataFrame:
        return exact(self.view(), query, k, "embedding", "doc_id", metric)

    def hybrid(self, text: str, query: Sequence[float], limit: int = 10, **weights: float) -> DataFrame:
        own = self.view()
        return hybrid(own, own.where("embedding is not null"), text, query, limit, id_col="doc_id", column="value", **weights)

    def count(self) -> int:
        return self.view().count()

    # writing

    def _last(self, column: str) -> int:
        return self.log.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]

    def _heads(self) -> tuple[int, int]:
        """The next epoch and the last document's id, in one pass over two columns."""
        row = self.log.agg(F.coalesce(F.max("epoch"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
        return row[0] + 1, row[1]

    def _append(self, rows: DataFrame, part: str, schema: str) -> None:
        ordered = [c.split()[0] for c in schema.split(", ")]
        rows.select(*ordered).write.mode("append").parquet(f"{self.path}/{part}")

    def write(self, rows: DataFrame, ttl_seconds: int | None = None, vector: tuple[str, int] | None = None) -> None:
        """Inserts or updates (key, value, embedding): of a key that repeats the last row counts, by ``seq`` where the rows have it, else in the order of their files.

        ``vector``: the JSON field, and its length, that embeddings are taken from where rows bring none.
        """
        self.db.check_storage(self.tenant, rows)
        epoch, last, now = *self._heads(), int(time.time() * 1000)
        own = embedding(F.col("value"), vector[1], vector[0]) if vector else F.lit(None).cast("array<float>")
        rows = rows.withColumn("embedding", F.coalesce(F.col("embedding").cast("array<float>"), own) if "embedding" in rows.columns else own)
        order = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
        rows = rows.withColumn("__seq", order).groupBy("key").agg(F.max_by(F.struct("value", "embedding"), "__seq").alias("r")).select("key", "r.value", "r.embedding")
        old = L.compact(self.log).select("key", F.col("doc_id").alias("old_id"), F.col("version").alias("old_version"), "op")
        joined = rows.join(old, "key", "left")
        there = F.col("old_id").isNotNull()
        # new ids follow the hash order of the keys; they needn't be dense, so no global sort is done
        fresh = F.monotonically_increasing_id() + F.lit(last + 1)
        self._append(
            joined.select(
                F.when(there, F.col("old_id")).otherwise(fresh).alias("doc_id"), "key", "value", F.when(there & (F.col("op") != "delete"), "update").otherwise("insert").alias("op"),
                F.coalesce(F.col("old_version") + 1, F.lit(0)).alias("version"), F.lit(epoch).cast("long").alias("epoch"), F.lit(now).cast("long").alias("ts_ms"),
                F.lit(None if ttl_seconds is None else now + 1000 * ttl_seconds).cast("long").alias("expires_at"), F.col("embedding").cast("array<float>").alias("embedding"),
            ),
            "log", LOG,
        )

    def insert(self, documents: Mapping[str, object] | Iterable[tuple], **options) -> None:
        """A mapping of keys to values, or (key, value[, embedding]) rows; values that aren't text become JSON."""
        items = documents.items() if isinstance(documents, Mapping) else documents
        rows = [(r[0], r[1] if isinstance(r[1], str) else json.dumps(r[1]), r[2] if len(r) > 2 else None, n) for n, r in enumerate(items)]
        self.write(self.db.spark.createDataFrame(rows, "key string, value string, embedding array<float>, seq long"), **options)

    def delete(self, keys: Sequence[str]) -> int:
        """How many of the keys there were."""
        there = self.view().where(F.col("key").isin(list(keys)))
        n = there.count()
        if n:
            epoch, now = self._last("epoch") + 1, int(time.time() * 1000)
            self._append(there.withColumns({"op": F.lit("delete"), "value": F.lit(None).cast("string"), "epoch": F.lit(epoch).cast("long"), "ts_ms": F.lit(now).cast("long"), "version": F.col("version") + 1, "embedding": F.lit(None).cast("array<float>")}), "log", LOG)
        return n

    def expire(self, keys: Sequence[str], at_ms: int | None) -> int:
        """Sets, or with None takes away, the time from which these keys are gone; how many there were."""
        there = self.view().where(F.col("key").isin(list(keys)))
        n = there.count()
        if n:
            epoch, now = self._last("epoch") + 1, int(time.time() * 1000)
            self._append(there.withColumns({"op": F.lit("update"), "epoch": F.lit(epoch).cast("long"), "ts_ms": F.lit(now).cast("long"), "version": F.col("version") + 1, "expires_at": F.lit(at_ms).cast("long")}), "log", LOG)
        return n

    def load_ndjson(self, path: str) -> None:
        self.write(read_ndjson(self.db.spark, path))

    # branches

    @property
    def branch_writes(self) -> DataFrame:
        return self._read("branch_writes", WRITES)

    def branches(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("name").orderBy(F.desc("at"))
        return self._read("branches", BRANCHES).withColumn("n", F.row_number().over(w)).where("n = 1 and status <> 'removed'").drop("n", "at")

    def _mark(self, name: str, agent: str, base: int, status: str) -> None:
        self._append(self.db.spark.createDataFrame([(name, agent, base, status, time.time_ns())], BRANCHES), "branches", BRANCHES)

    def branch(self, name: str, agent: str = "") -> None:
        if self.branches().where(F.col("name") == name).count():
            raise ValueError(f"there is a branch {name!r}")
        self._mark(name, agent, self._last("epoch") + 1, "active")

    def _branch(self, name: str):
        row = self.branches().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        return row

    def branch_write(self, branch: str, documents: Mapping[str, str | None]) -> None:
        """Writes, or with None deletions, on a branch."""
        self._branch(branch)
        rows = [(branch, k, v, v is None, time.time_ns()) for k, v in documents.items()]
        self._append(self.db.spark.createDataFrame(rows, WRITES), "branch_writes", WRITES)

    def on_branch(self, branch: str) -> DataFrame:
        self._branch(branch)
        return B.view(self.view(), self.branch_writes, branch)

    def search_branch(self, branch: str, text: str) -> DataFrame:
        return search(self.on_branch(branch), text, "value", "key")

    def context_on(self, branch: str, query: str, limit: int = 10) -> DataFrame:
        """(key, role) of what belongs to a query, as the branch sees the texts."""
        return context(self.on_branch(branch), query, limit, "value", "key")

    @property
    def settled(self) -> DataFrame:
        """(branch, key, how, at): what has been merged and which conflicts were resolved."""
        return self._read("settled", SETTLED)

    def resolve(self, branch: str, keys: Sequence[str]) -> None:
        """Lets the branch's writes of these keys win over the main line's at the next merge."""
        self._branch(branch)
        self._append(self.db.spark.createDataFrame([(branch, k, "resolved", time.time_ns()) for k in keys], SETTLED), "settled", SETTLED)

    def _open_writes(self, branch: str) -> DataFrame:
        """The branch's newest writes that haven't been merged yet."""
        done = self.settled.where((F.col("branch") == branch) & (F.col("how") == "merged")).groupBy("key").agg(F.max("at").alias("__at"))
        left = B.newest_writes(self.branch_writes, branch).join(done, "key", "left")
        return left.where(F.col("__at").isNull() | (F.col("epoch") > F.col("__at"))).drop("__at")

    def conflicts(self, branch: str) -> DataFrame:
        """(key): keys of the branch that the main line wrote or deleted since the fork, without the resolved ones."""
        row = self._branch(branch)
        resolved = self.settled.where((F.col("branch") == branch) & (F.col("how") == "resolved")).select("key").distinct()
        return B.conflicts(L.compact(self.log), self._open_writes(branch), branch, row.base_epoch).join(resolved, "key", "left_anti")

    def merge(self, branch: str) -> DataFrame:
        """(key) of the conflicts; what isn't in conflict is merged by one append, and the branch is if nothing is."""
        row, main = self._branch(branch), L.compact(self.log)
        clash = checkpoint(self.conflicts(branch))  # as of now, before the log changes
        resolved = self.settled.where((F.col("branch") == branch) & (F.col("how") == "resolved")).select("key").distinct()
        epoch, last, now = *self._heads(), int(time.time() * 1000)
        rows = checkpoint(B.merge(main, self._open_writes(branch), branch, row.base_epoch, epoch, resolved))
        old = main.select("key", F.col("doc_id").alias("old_id"), F.col("version").alias("old_version"))
        full = rows.join(old, "key", "left").withColumns({
            "doc_id": F.coalesce("old_id", F.monotonically_increasing_id() + F.lit(last + 1)), "version": F.coalesce(F.col("old_version") + 1, F.lit(0)), "ts_ms": F.lit(now).cast("long"),
            "expires_at": F.lit(None).cast("long"), "embedding": F.lit(None).cast("array<float>"),
        })
        self._append(full, "log", LOG)
        self._append(rows.select(F.lit(branch).alias("branch"), "key", F.lit("merged").alias("how"), F.lit(time.time_ns()).cast("long").alias("at")), "settled", SETTLED)
        if clash.isEmpty():
            self._mark(branch, row.agent, row.base_epoch, "merged")
        return clash

    def drop_branch(self, branch: str) -> None:
        row = self._branch(branch)
        self._mark(branch, row.agent, row.base_epoch, "removed")

    # upkeep

    def compact(self, keep_from: int) -> None:
        """Rewrites the log without versions that no view from ``keep_from`` on needs."""
        new = f"{self.path}/log-{time.time_ns()}"
        L.collect_garbage(self.log, keep_from).write.parquet(new)
        self.db.move(new, f"{self.path}/log")

    def release(self, note: str = "") -> int:
        """Publishes the live rows as the next numbered release."""
        n = max([0, *(int(x[1:]) for x in self.db.children(f"{self.path}/releases") if re.fullmatch(r"v\d+", x))]) + 1
        self.view().withColumn("note", F.lit(note)).write.parquet(f"{self.path}/releases/v{n}")
        return n

    def releases(self) -> list[int]:
        return sorted(int(x[1:]) for x in self.db.children(f"{self.path}/releases") if re.fullmatch(r"v\d+", x))

    def read_release(self, n: int) -> DataFrame:
        return self.db.spark.read.parquet(f"{self.path}/releases/v{n}").drop("note")

    def install(self, n: int, target: Collection) -> None:
        target.write(self.read_release(n).select("key", "value", "embedding"))


class Partitioned(Collection):
    """A collection whose log lies in ``parts`` folders by a hash of the key: a key's rows are read from its folder alone."""

    def __init__(self, db: Database, tenant: str, name: str, parts: int = 16):
        super().__init__(db, tenant, name)
        self.parts = parts

    @property
    def log(self) -> DataFrame:
        return self._read("log", LOG + ", part int")

    def _append(self, rows: DataFrame, part: str, schema: str) -> None:
        if part != "log":
            return super()._append(rows, part, schema)
        ordered = [c.split()[0] for c in LOG.split(", ")]
        rows.select(*ordered, hash_partition(F.col("key"), self.parts).cast("int").alias("part")).write.mode("append").partitionBy("part").parquet(f"{self.path}/log")

    def get(self, key: str) -> DataFrame:
        own = self.log.where(F.col("part") == fnv1a64_int(key) % self.parts)
        return L.latest(L.point_get(own, key), now_ms=int(time.time() * 1000))

    def migrate(self, parts: int) -> Partitioned:
        """The same rows over another number of folders."""
        new = f"{self.path}/log-{time.time_ns()}"
        self.log.drop("part").withColumn("part", hash_partition(F.col("key"), parts).cast("int")).write.partitionBy("part").parquet(new)
        self.db.move(new, f"{self.path}/log")
        return Partitioned(self.db, self.tenant, self.name, parts)


class Database:
    def __init__(self, spark: SparkSession, path: str, keys: Keys | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys or Keys()
        self.quotas: dict[str, Quota] = {}

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def children(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def move(self, source: str, target: str) -> None:
        (a, fs), (b, _) = self._fs(source), self._fs(target)
        fs.delete(b, True)
        fs.rename(a, b)

    def set_quota(self, tenant: str, quota: Quota) -> None:
        self.quotas[tenant] = quota

    def check_storage(self, tenant: str, rows: DataFrame) -> None:
        limit = self.quotas.get(tenant, Quota()).bytes
        if limit is None:
            return
        size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
        if size(rows) + sum(size(Collection(self, tenant, c).log) for c in self.collections(tenant)) > limit:
            raise QuotaExceeded(f"{tenant}: storage")

    def collections(self, tenant: str = "default") -> list[str]:
        return sorted(self.children(f"{self.path}/{tenant}"))

    def collection(self, name: str, tenant: str = "default") -> Collection:
        if not _NAME.fullmatch(name) or not _NAME.fullmatch(tenant):
            raise ValueError("names have 1 to 64 letters, digits, _ . -")
        limit, there = self.quotas.get(tenant, Quota()).collections, self.collections(tenant)
        if limit is not None and name not in there and len(there) >= limit:
            raise QuotaExceeded(f"{tenant}: collections")
        _, fs = self._fs(self.path)
        fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tenant}/{name}"))
        return Collection(self, tenant, name)

    def partitioned(self, name: str, tenant: str = "default", parts: int = 16) -> Partitioned:
        self.collection(name, tenant)
        return Partitioned(self, tenant, name, parts)

    def drop(self, name: str, tenant: str = "default") -> None:
        p, fs = self._fs(f"{self.path}/{tenant}/{name}")
        fs.delete(p, True)

    def fork(self, path: str) -> Fork:
        """A database that starts as this one is and keeps its own writes under ``path``."""
        return Fork(self, Database(self.spark, path, self.keys))

    def tenant(self, name: str) -> Tenant:
        return Tenant(self, name)


class Tenant:
    """A database seen by one tenant."""

    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name

    def collection(self, name: str) -> Collection:
        return self.db.collection(name, self.name)

    def collections(self) -> list[str]:
        return self.db.collections(self.name)

    def drop(self, name: str) -> None:
        self.db.drop(name, self.name)


class Fork:
    """Own writes over another database, which stays as it is; deletions hide the other's rows."""

    def __init__(self, base: Database, own: Database):
        self.base, self.own = base, own

    def view(self, name: str, tenant: str = "default") -> DataFrame:
        """(key, value) of the live rows."""
        overlay = L.compact(self.own.collection(name, tenant).log).select("key", "value", (F.col("op") == "delete").alias("deleted"))
        return B.overlay_scan(self.base.collection(name, tenant).view(), overlay)

    def insert(self, name: str, documents: Mapping[str, object], tenant: str = "default") -> None:
        self.own.collection(name, tenant).insert(documents)

    def delete(self, name: str, keys: Sequence[str], tenant: str = "default") -> int:
        """Deletes keys of either; how many there were."""
        there = [r.key for r in self.view(name, tenant).where(F.col("key").isin(list(keys))).select("key").collect()]  # of the keys given
        if there:
            mine = self.own.collection(name, tenant)
            mine.insert({k: "" for k in there})
            mine.delete(there)
        return len(there)
