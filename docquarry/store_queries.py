"""Registered queries over stored collections, indexes and package tables: what a user of the API does, step by step, with the SQL for what is there at the end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .api import TextIndex
from .functions import text as T
from .functions.json import embedding, project
from .operators import columnar as C
from .operators import distribution as D
from .operators import registry as R
from .operators import search as S
from .operators import tenancy as N
from .operators import vectors as X
from .session import shared_folder, table
from .sources.store import Collection, Database

query, _on = Q.query, Q._on


def _database(spark: SparkSession) -> Database:
    return Database(spark, f"{shared_folder(spark)}/db-{uuid.uuid4().hex}")


def _rows(spark: SparkSession, d: str, where: str = "true", segment: F.Column | str = "c_mktsegment") -> DataFrame:
    """(key, value, seq) of customers."""
    c = table(spark, d, "customer").where(where)
    value = F.to_json(F.struct(F.col("c_custkey").alias("n"), F.col(segment).alias("seg") if isinstance(segment, str) else segment.alias("seg")))
    return c.select(F.col("c_name").alias("key"), value.alias("value"), F.col("c_custkey").alias("seq"))


def _filled(spark: SparkSession, d: str, kind: Callable[[Database], Collection] | None = None) -> Collection:
    """All customers, then every third one again, twice in one write."""
    c = (kind or (lambda db: db.collection("customers")))(_database(spark))
    c.write(_rows(spark, d))
    more = _rows(spark, d, "c_custkey % 3 = 0", F.lit("zz first"))
    c.write(more.unionByName(_rows(spark, d, "c_custkey % 3 = 0", F.lit("aa last")).withColumn("seq", F.col("seq") + 10_000_000_000)))
    return c


_V = """'{{"n":' || c_custkey || ',"seg":"' || {0} || '"}}'"""
_SEG = "CASE WHEN c_custkey % 3 = 0 THEN 'aa last' ELSE c_mktsegment END"
_NOW = f"(SELECT c_name AS key, {_V.format(_SEG)} AS value, c_custkey AS n, {_SEG} AS seg FROM customer)"


def _store(name: str, sql: str, f: Callable[[Collection], DataFrame], kind: Callable[[Database], Collection] | None = None) -> None:
    query(sql, name)(lambda spark, d: f(_filled(spark, d, kind)))


_kv = lambda df: df.select("key", "value")


def _did(c: Collection, *steps: Callable[[Collection], object]) -> Collection:
    for step in steps:
        step(c)
    return c


_keys = lambda n: [f"Customer#{i:09d}" for i in range(1, n + 1)]
_IN = "('" + "', '".join(_keys(20)) + "')"
_store("store_write", f"SELECT key, value, CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END::INT AS version FROM {_NOW}", lambda c: c.view().select("key", "value", "version"))
_store("store_delete", f"SELECT key, value FROM {_NOW} WHERE key NOT IN {_IN}", lambda c: _kv(_did(c, lambda c: c.delete([*_keys(20), "nobody"])).view()))
_store("store_write_again", f"SELECT key, value, 2 AS version FROM {_NOW} WHERE n = 1", lambda c: _did(c, lambda c: c.delete(_keys(1)), lambda c: c.write(c.as_of(2).where(F.col("key") == _keys(1)[0]).select("key", "value"))).get(_keys(1)[0]).select("key", "value", "version"))
_store("store_get", f"SELECT key, value FROM {_NOW} WHERE n = 3", lambda c: _kv(c.get(_keys(3)[2])))
_store("store_as_of", f"SELECT c_name AS key, {_V.format('c_mktsegment')} AS value FROM customer", lambda c: _kv(c.as_of(1)))
_store("store_find", f"SELECT key, value FROM {_NOW} WHERE n > 50 AND seg = 'aa last'", lambda c: _kv(c.find({"n": {"$gt": 50}, "seg": "aa last"})))
_store("store_aggregate", f"SELECT count(n) AS count, sum(n)::DOUBLE AS sum, round(avg(n), 4) AS avg, min(n)::DOUBLE AS min, max(n)::DOUBLE AS max FROM {_NOW} WHERE seg = 'aa last'", lambda c: c.aggregate("n", {"seg": "aa last"}).withColumn("avg", F.round("avg", 4)))
_store("store_search", f"SELECT key FROM {_NOW} WHERE contains(lower(value), 'aa') AND contains(lower(value), 'last')", lambda c: c.search("LAST aa").select("key"))
_store("store_words", f"SELECT key, 1 AS line FROM {_NOW} WHERE seg = 'aa last'", lambda c: c.words("last"))
_store("store_count", f"SELECT count(*) AS n FROM {_NOW}", lambda c: c.db.spark.createDataFrame([(c.count(),)], "n long"))
_store("store_expiry", f"SELECT key FROM {_NOW} WHERE key NOT IN {_IN}", lambda c: _did(c, lambda c: c.expire(_keys(20), 1000)).view().select("key"))
_store("store_expiry_removed", f"SELECT key, value FROM {_NOW}", lambda c: _kv(_did(c, lambda c: c.write(c.view().where(F.col("key").isin(_keys(5))).select("key", "value"), ttl_seconds=-5), lambda c: c.write(c.as_of(2).where(F.col("key").isin(_keys(5))).select("key", "value"))).view()))
_store("store_compacted", f"SELECT key, value FROM {_NOW}", lambda c: _kv(_did(c, lambda c: c.compact(2)).log))
_store("store_release", f"SELECT key, value, 2::BIGINT AS releases FROM {_NOW}", lambda c: _installed(c))
_store("store_partitioned", f"SELECT key, value FROM {_NOW} WHERE key NOT IN {_IN}", lambda c: _kv(_did(c, lambda c: c.delete(_keys(20))).view()), lambda db: db.partitioned("customers", parts=8))
_store("store_partitioned_get", f"SELECT key, value FROM {_NOW} WHERE n = 3", lambda c: _kv(c.get(_keys(3)[2])), lambda db: db.partitioned("customers", parts=8))
_store("store_partition_migrated", f"SELECT key, value FROM {_NOW}", lambda c: _kv(c.migrate(5).view()), lambda db: db.partitioned("customers", parts=8))


def _installed(c: Collection) -> DataFrame:
    c.release("first")
    c.release("second")
    other = c.db.collection("copy")
    c.install(2, other)
    return _kv(other.view()).withColumn("releases", F.lit(len(c.releases())).cast("long"))


# branches of a stored collection: the branch changes 1 to 20, the main line has deleted 1 to 3 and changed 6 to 9 since


def _branched(c: Collection) -> Collection:
    names = _keys(20)
    c.branch("b", "agent")
    c.branch_write("b", {k: "on b" if i % 4 else None for i, k in enumerate(names, 1)} | {"fresh": "new on b"})
    c.delete(names[:3])
    c.write(c.view().where(F.col("key").isin(names[5:9])).select("key", F.lit("on main").alias("value")))
    return c


_ONB = f"SELECT key, CASE WHEN key IN {_IN} THEN 'on b' ELSE value END AS value FROM {_NOW} WHERE NOT (key IN {_IN} AND n % 4 = 0) UNION ALL SELECT 'fresh', 'new on b'"
_CLASH = "n IN (1, 2, 3, 6, 7, 8, 9)"
_store("store_branch", _ONB, lambda c: _branched(c).on_branch("b"))
_store("store_branch_search", f"SELECT key FROM ({_ONB}) WHERE contains(value, 'on b')", lambda c: _branched(c).search_branch("b", "on b").where(F.contains("value", F.lit("on b"))).select("key"))
_store("store_conflicts", f"SELECT key FROM {_NOW} WHERE {_CLASH}", lambda c: _branched(c).conflicts("b"))
_MERGED = f"SELECT key, CASE WHEN key IN {_IN} AND NOT {_CLASH} THEN 'on b' WHEN n BETWEEN 6 AND 9 THEN 'on main' ELSE value END AS value FROM {_NOW} WHERE NOT (key IN {_IN} AND n % 4 = 0 AND NOT {_CLASH}) AND n NOT IN (1, 2, 3) UNION ALL SELECT 'fresh', 'new on b'"
_store("store_merge", _MERGED, lambda c: _kv(_did(_branched(c), lambda c: c.merge("b")).view()))
_store("store_merge_resolved", _ONB, lambda c: _kv(_did(_branched(c), lambda c: c.merge("b"), lambda c: c.resolve("b", _keys(9)), lambda c: c.merge("b")).view()))
_store("store_branch_states", "SELECT * FROM (VALUES ('b', 'agent', 'active'), ('c', '', 'merged')) t(name, agent, status)", lambda c: _did(_branched(c), lambda c: c.branch("c"), lambda c: c.branch_write("c", {"x": "y"}), lambda c: c.merge("c"), lambda c: c.branch("d"), lambda c: c.drop_branch("d")).branches().select("name", "agent", "status"))


def _forked(c: Collection) -> DataFrame:
    fork = c.db.fork(c.db.path + "-fork")
    fork.insert("customers", {k: "forked" for k in _keys(5)} | {"only": "here"})
    fork.delete("customers", _keys(8)[5:])
    return fork.view("customers")


_store("store_fork", f"SELECT key, CASE WHEN n BETWEEN 1 AND 5 THEN 'forked' ELSE value END AS value FROM {_NOW} WHERE n NOT IN (6, 7, 8) UNION ALL SELECT 'only', 'here'", _forked)


@query("SELECT c_name AS key, 'v' || c_custkey AS value FROM customer")
def store_load_ndjson(spark: SparkSession, d: str) -> DataFrame:
    db = _database(spark)
    table(spark, d, "customer").select(F.to_json(F.struct(F.col("c_name").alias("key"), F.concat(F.lit("v"), "c_custkey").alias("value")))).write.text(f"{db.path}-lines")
    c = db.collection("loaded")
    c.load_ndjson(f"{db.path}-lines")
    return _kv(c.view())


@query(f"SELECT vec_id AS key, round(list_cosine_similarity({Q._E}, {Q._q}), 5) AS score FROM embeddings ORDER BY list_cosine_similarity({Q._E}, {Q._q}) DESC, vec_id LIMIT 10")
def store_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that came in the JSON of their documents."""
    c = _database(spark).collection("vectors")
    c.write(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.to_json(F.struct(F.col("embedding").alias("v"))).alias("value")), vector=("v", 64))
    found = c.nearest(Q._QUERY, 10)
    return c.view().join(found, "doc_id").select(F.col("key").cast("long").alias("key"), F.round("score", 5).alias("score"))


@query("SELECT * FROM (VALUES ('collections', 'refused'), ('bytes', 'refused'), ('read key writes', 'refused'), ('unknown key', 'refused'), ('admin key', 'admin'), ('tenants', 'a,b')) t(what, outcome)")
def store_tenants(spark: SparkSession, d: str) -> DataFrame:
    db, out = _database(spark), []
    one, two = db.tenant("one"), db.tenant("two")
    db.set_quota("one", N.Quota(collections=2))
    db.set_quota("two", N.Quota(bytes=100))

    def tried(what: str, step: Callable[[], object]) -> None:
        try:
            out.append((what, str(step() or "done")))
        except (N.QuotaExceeded, N.PermissionDenied):
            out.append((what, "refused"))

    one.collection("a"), one.collection("b")
    tried("collections", lambda: one.collection("c"))
    tried("bytes", lambda: two.collection("x").write(_rows(spark, d)))
    keys = N.Keys()
    keys.add("admin", "k-admin"), keys.add("read", "k-read")
    tried("read key writes", lambda: keys.require("k-read", "write"))
    tried("unknown key", lambda: keys.require("k-none", "read"))
    tried("admin key", lambda: keys.level("k-admin"))
    tried("tenants", lambda: ",".join(one.collections()))
    return spark.createDataFrame(out, "what string, outcome string")


# expiry with rows that do expire: what even users wrote lasts an hour

_LATE = 2_000_000_000_000
_XLOG = Q._ELOG.replace("CASE WHEN event_type = 'view' THEN epoch_ms(ts) + 3600000 END AS expires_at", "CASE WHEN user_id % 2 = 0 THEN epoch_ms(ts) + 3600000 END AS expires_at")
_XVER = f"WITH log AS ({_XLOG}), x AS {Q._LATEST.format('log')} "


def _expiring(e: DataFrame) -> DataFrame:
    return Q._events_log(e).withColumn("expires_at", F.when(F.col("doc_id") % 2 == 0, F.col("ts_ms") + 3600000))


_on("ttl_expired_users", _XVER + f"SELECT key, epoch FROM x WHERE expires_at <= {_LATE}", "events", lambda e: Q.L.expired(_expiring(e), _LATE).select("key", "epoch"))
_on("ttl_purged_users", _XVER + f"SELECT key, epoch FROM log WHERE key NOT IN (SELECT key FROM x WHERE expires_at <= {_LATE})", "events", lambda e: Q.L.purge_expired(_expiring(e), _LATE).select("key", "epoch"))
_on("ttl_live_users", _XVER + f"SELECT key, epoch FROM x WHERE expires_at IS NULL OR expires_at > {_LATE}", "events", lambda e: Q.L.latest(_expiring(e), now_ms=_LATE).select("key", "epoch"))
Q._two("join_anti_rows", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)", "customer", "orders", lambda c, o: c.join(o.where("o_orderkey % 5 = 0"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey"))
Q._two("set_except_rows", "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier", "customer", "supplier", lambda c, s: c.select(F.col("c_custkey").alias("k")).subtract(s.select("s_suppkey")))

# text

_q1 = lambda s: "'" + s.replace("'", "''") + "'"
_PLAIN, _TO = "".join(c for c in T.ASCII[1:]), "".join(T.REDUCED[1:])
_CHR = lambda s: " || ".join(f"chr({ord(c)})" for c in s)
_on("text_reduced", f"SELECT doc_id, md5(translate(regexp_replace(text, '[^\\x01-\\x7f]', '.', 'g'), {_CHR(_PLAIN)}, {_q1(_TO)})) AS reduced FROM documents", "documents", lambda t: t.select("doc_id", F.md5(T.reduced(F.col("text"))).alias("reduced")))
_on("text_hex", "SELECT doc_id, md5(lower(hex(encode(text)))) AS digest FROM documents", "documents", lambda t: t.select("doc_id", F.md5(F.lower(T.hex_of(F.encode("text", "utf-8")))).alias("digest")))
_on("word_index_removed", Q._WORDS + "SELECT DISTINCT word, doc_id, line::INT AS line FROM l WHERE length(word) >= 2 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')", "documents", lambda t: S.word_index_without(S.word_index(t), t.where("source = 'src1'")))
_on("pages_context_roles", f"SELECT count(*) AS matches FROM (SELECT url FROM pages WHERE contains({Q._FOLD.replace('text', 'html')}, 'the') ORDER BY url LIMIT 20)", "pages", lambda t: S.context(t.select(F.col("url").alias("path"), F.col("html").alias("text")), "the", 10).where("role <> 'caller'").join(S.search(t.select(F.col("url").alias("path"), F.col("html").alias("text")), "the", key="path", limit=20).select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("matches")))

_indexes: dict[tuple, object] = {}


def _kept(spark: SparkSession, d: str, kind: str, make: Callable[[str], object]):
    """An index in the shared folder, made at its first use in a session."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _indexes:
        _indexes[key] = make(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    return _indexes[key]


@query(f"SELECT doc_id FROM documents WHERE contains({Q._FOLD}, 'example') AND contains({Q._FOLD}, 'mail')")
def text_search_stored(spark: SparkSession, d: str) -> DataFrame:
    """Over an index that is there already."""
    docs = table(spark, d, "documents")
    return _kept(spark, d, "trigrams", lambda path: TextIndex.build(docs, path)).search("example Mail").select("doc_id")


@query(Q._exact["cosine"])
def vector_int8_stored(spark: SparkSession, d: str) -> DataFrame:
    """Over int8 codes that are there already."""

    def made(path: str) -> DataFrame:
        X.with_int8(table(spark, d, "embeddings")).write.parquet(path)
        return spark.read.parquet(path)

    return Q._six(X.int8_search(_kept(spark, d, "int8", made), Q._QUERY, 10))


def _recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    return exact.select("vec_id").join(found.select("vec_id"), "vec_id", "left_semi").agg((F.count("*") >= 9).alias("nine_of_ten"))


for _metric in ("cosine", "dot", "l2"):
    _on(f"vector_quantized_recall_{_metric}", "SELECT true AS nine_of_ten", "embeddings", lambda t, m=_metric: _recall(X.quantized_search(X.quantized(t, q := X.Quantizer(64)), q, Q._QUERY, 10, metric=m), X.exact(t, Q._QUERY, 10, metric=m)))
_on("vector_ivf_recall", "SELECT true AS nine_of_ten", "embeddings", lambda t: _recall(X.Clusters(t).search(Q._QUERY, 10), X.exact(t, Q._QUERY, 10)))
_on("vector_hadamard_norms", f"SELECT vec_id, round(sqrt(list_dot_product({Q._E}, {Q._E})), 4) AS norm FROM embeddings", "embeddings", lambda t: t.select("vec_id", F.round(Q.V.norm(Q.V.hadamard(F.col("embedding"))), 4).alias("norm")))
_on("embedding_from_json", f"SELECT vec_id, 64 AS dims, round(list_sum({Q._E}), 4) AS total FROM embeddings", "embeddings", lambda t: t.select("vec_id", embedding(F.to_json(F.struct("embedding")), 64).alias("e")).select("vec_id", F.size("e").alias("dims"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total")))
_on("json_projection", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::DOUBLE AS k_float FROM events", "events", lambda e: e.select("event_id", *project(e["props"], {"k": "integer"}), project(e["props"], {"k": "float"})[0].alias("k_float")))

# encodings

_on("dictionary_decode", "SELECT o_orderkey, o_orderpriority AS value FROM orders", "orders", lambda t: C.decode(C.encode(t, "o_orderpriority", k := C.dictionary(t, "o_orderpriority", "o_orderkey")).select("o_orderkey", "code"), k).select("o_orderkey", "value"))
_on("dictionary_cardinality", "SELECT count(DISTINCT o_orderpriority) AS codes FROM orders", "orders", lambda t: C.dictionary(t, "o_orderpriority", "o_orderkey").agg(F.count("*").alias("codes")))
_on("bitmap_values", "SELECT DISTINCT doc_id AS value FROM documents WHERE lang = 'en'", "documents", lambda t: C.bitmap_values(C.bitmap(t.where("lang = 'en'"), "doc_id")))
_on("bitmap_contains", "SELECT doc_id, coalesce(lang = 'en', false) AS contained FROM documents", "documents", lambda t: C.bitmap_contains(t, "doc_id", C.bitmap(t.where("lang = 'en'"), "doc_id")).select("doc_id", "contained"))


@query("SELECT count(*) AS held, true AS few_others FROM customer WHERE c_custkey % 10 = 0")
def bloom_membership(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer")
    own = t.where("c_custkey % 10 = 0")
    bits = C.bloom_bits(own.count())
    held = C.bloom_contains(t, "c_name", C.bloom(own, "c_name", bits), bits)
    return held.agg(F.count_if(F.col("c_custkey") % 10 == 0).alias("held"), (F.count_if(F.col("c_custkey") % 10 != 0) <= 0.01 * F.count("*") + 5).alias("few_others"))


# shards and packages

_on("migration_progress", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE s_suppkey / 1000.0 END::DOUBLE AS progress FROM supplier", "supplier", lambda t: D.migration_progress(t.select("s_suppkey", F.element_at(F.array(*map(F.lit, ("done", "pending", "moving"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("state"), F.col("s_suppkey").cast("double").alias("transferred"), F.lit(1000.0).alias("total"))).select("s_suppkey", "progress"))
_on("shard_owners", "SELECT s_suppkey, 'node' || (s_suppkey % 4) AS node FROM supplier", "supplier", lambda t: D.owners(t.withColumn("partition", F.col("s_suppkey") % 4), t.sparkSession.range(4).select(F.col("id").alias("partition"), F.concat(F.lit("node"), "id").alias("node"))).select("s_suppkey", "node"))
_PACK = "SELECT 'p' || (p_partkey % 20) AS name, (p_partkey % 3) || '.' || p_size || '.' || p_partkey AS version, p_partkey % 3 AS a, p_size AS b, p_partkey AS c, p_partkey % 7 = 0 AS yanked FROM part"


def _releases(t: DataFrame) -> DataFrame:
    v = F.concat_ws(".", F.col("p_partkey") % 3, F.col("p_size"), F.col("p_partkey"))
    deps = F.when(F.col("p_partkey") % 20 == 1, F.create_map(F.lit("p2"), F.lit(">=1.0.0"))).otherwise(F.create_map().cast("map<string,string>"))
    return t.select(F.concat(F.lit("p"), F.col("p_partkey") % 20).alias("name"), v.alias("version"), F.md5(F.col("p_name")).alias("digest"), (F.col("p_partkey") % 7 == 0).alias("yanked"), deps.alias("deps"))


_BEST = f"WITH r AS ({_PACK}), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY a DESC, b DESC, c DESC) AS rn FROM r WHERE NOT yanked "
_on("package_newest", _BEST + ") SELECT name, version FROM n WHERE rn = 1", "part", lambda t: R.newest(_releases(t)).select("name", "version"))
_on("package_best", _BEST + "AND a = 1) SELECT name, version FROM n WHERE rn = 1 AND name = 'p4'", "part", lambda t: R.best(_releases(t), "p4", "^1.0.0").select("name", "version"))
_on("package_publish", f"SELECT 'p1' AS name, '9.0.' || (p_partkey % 5) AS version FROM part WHERE p_partkey <= 5 AND p_partkey > 0", "part", lambda t: R.publish(_releases(t), _releases(t).select("name", "version").unionByName(t.where("p_partkey between 1 and 5").select(F.lit("p1").alias("name"), F.concat(F.lit("9.0."), F.col("p_partkey") % 5).alias("version")))))
_on("package_resolve", _BEST + "AND a >= 1) SELECT name, version FROM n WHERE rn = 1 AND name IN ('p1', 'p2')", "part", lambda t: t.sparkSession.createDataFrame(sorted(R.resolve(_releases(t), {"p1": ">=1.0.0"}).items()), "name string, version string"))
_on("package_lockfile", _BEST + "AND a >= 1) SELECT count(*) AS locked FROM n WHERE rn = 1 AND name IN ('p1', 'p2')", "part", lambda t: R.lockfile(_releases(t), R.resolve(_releases(t), {"p1": ">=1.0.0"})).select(F.json_array_length("lock").cast("long").alias("locked")))


def _packages(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    packages = t.select(F.concat(F.lit("q"), "p_partkey").alias("name"), F.concat(F.lit("u"), F.col("p_partkey") % 5).alias("owner"), F.col("p_type").alias("description"), (F.col("p_partkey") % 2 == 0).alias("public"))
    grants = t.where("p_partkey % 9 = 0").select(F.concat(F.lit("q"), "p_partkey").alias("name"), F.lit("u1").alias("holder"), F.when(F.col("p_partkey") % 2 == 1, "read").otherwise("yank").alias("permission"))
    return packages, grants


_on("package_visible", "SELECT 'q' || p_partkey AS name FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 = 1 OR p_partkey % 9 = 0", "part", lambda t: R.visible(*_packages(t), "u1").select("name"))
_on("package_yank", "SELECT 'q' || p_partkey AS name, p_partkey = 18 AS yanked FROM part", "part", lambda t: R.yank(t.select(F.concat(F.lit("q"), "p_partkey").alias("name"), F.lit("1.0.0").alias("version"), F.lit(False).alias("yanked")), *_packages(t), "q18", "1.0.0", "u1").select("name", "yanked"))
