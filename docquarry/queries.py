"""The registered queries of the engine, each with the SQL for the same rows where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vector as V
from .functions.diff import line_diff
from .functions.json import Text, violations
from .functions.versions import satisfies
from .operators import aggregates as A
from .operators import branches as B
from .operators import columnar as C
from .operators import distribution as D
from .operators import joins as J
from .operators import log as L
from .operators import registry as R
from .operators import search as S
from .operators import tenancy as N
from .operators import vectors as X
from .plans.filters import where
from .session import shared_folder, table
from .streaming import feed as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def _on(name: str, sql: str | None, t: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """Registers a query of one table."""
    query(sql, name)(lambda spark, d: f(table(spark, d, t)))


# filters: JSON text in events.props, typed columns elsewhere

_K = "try_cast(json_extract_string(props, '$.k') AS DOUBLE)"
for _name, _filter, _sql in (
    ("eq", {"k": 69}, f"{_K} = 69"), ("ne", {"k": {"$ne": 69}}, f"{_K} <> 69"), ("gt", {"k": {"$gt": 50}}, f"{_K} > 50"), ("gte", {"k": {"$gte": 50}}, f"{_K} >= 50"),
    ("lt", {"k": {"$lt": 7.5}}, f"{_K} < 7.5"), ("lte", {"k": {"$lte": 7}}, f"{_K} <= 7"), ("in", {"k": {"$in": [1, 5, "6", 69.0, None]}}, f"{_K} IN (1, 5, 69)"),
    ("exists", {"k": {"$exists": True}, "missing": {"$exists": False}}, "json_extract(props, '$.k') IS NOT NULL"),
    ("and", {"$and": [{"k": {"$gt": 10}}, {"k": {"$lt": 20}}]}, f"{_K} > 10 AND {_K} < 20"), ("or", {"$or": [{"k": 3}, {"k": {"$gte": 90}}]}, f"{_K} = 3 OR {_K} >= 90"), ("not", {"$not": {"k": {"$gte": 20}}}, f"NOT coalesce({_K} >= 20, false)"),
    ("types_are_strict", {"$or": [{"k": "69"}, {"k": True}, {"k": {"$contains": "6"}}, {"k": [69]}, {"k": 42.0}]}, f"{_K} = 42"),
    ("missing_fields", {"$not": {"gone": {"$gt": 5}}, "$or": [{"gone": {"$ne": 1}}, {"k": {"$lt": 50}}]}, f"{_K} < 50"),
):
    _on(f"filter_{_name}", f"SELECT event_id FROM events WHERE {_sql}", "events", lambda e, q=_filter: where(e, q, "props").select("event_id"))
_on("filter_contains", "SELECT doc_id FROM documents WHERE contains(text, 'token')", "documents", lambda d: where(d, {"text": {"$contains": "token"}}).select("doc_id"))
_on("filter_typed_columns", "SELECT event_id FROM events WHERE event_type = 'click' AND value > 50", "events", lambda e: where(e, {"event_type": "click", "value": {"$gt": 50}}).select("event_id"))
_on("json_extract_field", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' END AS kind FROM events", "events", lambda e: e.select("event_id", Text(e["props"]).integer("k").alias("k"), Text(e["props"]).kind("k").alias("kind")))
_on("schema_validate", f"SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'k: missing' WHEN {_K} IS NULL THEN 'k: not a number' END AS complaint FROM events", "events", lambda e: e.select("event_id", violations(e["props"], [("k", "number", True), ("name", "string", False)]).alias("complaint")))
_on("column_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus >= 'O'", "orders", lambda o: C.column_filter(o, "o_orderstatus", "gte", "O", "o_orderkey"))

# aggregates


@query("SELECT count(value) AS count, round(coalesce(sum(value), 0), 2) AS sum, round(coalesce(avg(value), 0), 4) AS avg, coalesce(min(value), 0) AS min, coalesce(max(value), 0) AS max FROM events WHERE event_type = 'click' AND value > 50")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A filter over typed columns, then the five aggregates."""
    return _rounded(A.aggregate(where(table(spark, d, "events"), {"event_type": "click", "value": {"$gt": 50}}), "value"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 4)})


_AGG = "count({0}) AS count, round(coalesce(sum({0}), 0), 2) AS sum, round(coalesce(avg({0}), 0), 4) AS avg, coalesce(min({0}), 0)::DOUBLE AS min, coalesce(max({0}), 0)::DOUBLE AS max"
_on("agg_count_sum_avg_min_max", f"SELECT {_AGG.format(_K)} FROM events", "events", lambda e: _rounded(A.aggregate(e, "k", "props")))
_on("agg_empty", f"SELECT {_AGG.format('NULL::DOUBLE')} FROM events", "events", lambda e: _rounded(A.aggregate(e, "no.such.field", "props")))
_on("agg_grouped", f"SELECT event_type, {_AGG.format('value')} FROM events GROUP BY event_type", "events", lambda e: _rounded(A.aggregate(e, "value", by=["event_type"])))


@query(f"SELECT {_AGG.format('value')} FROM events WHERE user_id % 7 <> 3")
def agg_partial_merge(spark: SparkSession, d: str) -> DataFrame:
    """Shards by user; shard 3 has failed."""
    shards = table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("shard")).agg(F.count("value").alias("doc_count"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    return _rounded(A.merge_partials(shards.withColumn("status", F.when(F.col("shard") == 3, "error").otherwise("ok"))))


_on("agg_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem", "lineitem", lambda t: t.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers")))
_SETS = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY "
_sets = lambda: (F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
_on("agg_cube", _SETS + "CUBE (l_returnflag, l_linestatus)", "lineitem", lambda t: t.cube("l_returnflag", "l_linestatus").agg(*_sets()))
_on("agg_rollup", _SETS + "ROLLUP (l_returnflag, l_linestatus)", "lineitem", lambda t: t.rollup("l_returnflag", "l_linestatus").agg(*_sets()))
_on("agg_grouping_sets", _SETS + "GROUPING SETS ((l_returnflag), (l_linestatus))", "lineitem", lambda t: t.groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(*_sets()))
_on("storage_bytes", "SELECT source, count(*) AS docs, sum(octet_length(encode(text))) AS bytes FROM documents GROUP BY source", "documents", lambda t: A.storage_bytes(t, "text", ["source"]))
_on(
    "pair_frequencies",
    "WITH b AS (SELECT regexp_extract_all(hex(encode(text)), '..') AS b FROM documents), p AS (SELECT ('0x' || unnest([b[i + 1] || b[i + 2] for i in range(len(b) - 1)]))::BIGINT AS pair FROM b), c AS (SELECT pair, count(*) AS n FROM p GROUP BY pair) SELECT pair, n, (65024 - floor(n * 60928.0::DOUBLE / max(n) OVER ()))::INT AS weight FROM c",
    "documents", lambda t: A.pair_frequencies(t, "text"),
)
_LOG = "SELECT user_id, event_id, event_id % 977 AS cpu_us, user_id % 50 AS rows, octet_length(encode(props)) * 1000 AS bytes FROM events"


def _usage_log(e: DataFrame) -> DataFrame:
    return e.select("user_id", "event_id", (F.col("event_id") % 977).alias("cpu_us"), (F.col("user_id") % 50).alias("rows"), (F.octet_length("props") * 1000).alias("bytes"))


_on("billing_cost", f"WITH l AS ({_LOG}) SELECT user_id, count(*) AS queries, sum(rows)::BIGINT AS rows, sum(bytes)::BIGINT AS bytes, sum(cpu_us)::BIGINT AS cpu_us, sum(cpu_us * 5 + rows + bytes // 1024)::BIGINT AS cost FROM l GROUP BY user_id", "events", lambda e: A.usage(_usage_log(e), ["user_id"]))
_on("billing_recent", f"WITH l AS ({_LOG}) SELECT event_id, cpu_us FROM l ORDER BY event_id DESC LIMIT 100", "events", lambda e: A.recent(_usage_log(e), "event_id").select("event_id", "cpu_us"))

# scans and pages

_on("scan_limit_offset", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40", "documents", lambda t: L.scan(t, 20, 40).select("doc_id", "source"))
_on("cursor_page", "SELECT doc_id, lpad(lower(to_hex(doc_id)), 16, '0') AS cursor FROM documents WHERE doc_id > 99 ORDER BY doc_id LIMIT 25", "documents", lambda t: L.page(t, 25, "0000000000000063").select("doc_id", "cursor"))
_on("cursor_round_trip", "SELECT o_orderkey, o_orderkey::DOUBLE AS back FROM orders", "orders", lambda t: t.select("o_orderkey", L.cursor_id(L.cursor_of(F.col("o_orderkey"))).cast("double").alias("back")))
_on("point_get", "SELECT * FROM orders WHERE o_orderkey = 42", "orders", lambda t: L.point_get(t, 42, "o_orderkey"))
_on("prefix_scan", "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')", "pages", lambda t: L.prefix_scan(t, "https://", "url").select("page_id", "url"))
_on("parse_as_of", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1700000000000 + event_id ELSE 1000 * (1700000000 + event_id) END AS ms FROM events", "events", lambda e: e.select("event_id", L.parse_as_of(F.when(F.col("event_id") % 2 == 0, F.lit(1700000000000) + F.col("event_id")).otherwise(F.lit(1700000000) + F.col("event_id")).cast("string")).alias("ms")))

# text

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_on("text_search_single", f"SELECT doc_id FROM documents WHERE contains({_FOLD}, 'token')", "documents", lambda t: S.search(t, "ToKen").select("doc_id"))
_on("text_search_all_terms", f"SELECT doc_id FROM documents WHERE contains({_FOLD}, 'the') AND contains({_FOLD}, 'token')", "documents", lambda t: S.search(t, "The  token").select("doc_id"))
_on("text_search_limit", f"SELECT doc_id FROM documents WHERE contains({_FOLD}, 'token') ORDER BY doc_id LIMIT 10", "documents", lambda t: S.search(t, "token", limit=10).select("doc_id"))
_on("text_search_indexed", f"SELECT doc_id FROM documents WHERE contains({_FOLD}, 'example') AND contains({_FOLD}, 'mail')", "documents", lambda t: S.indexed_search(t, S.postings(t), "example Mail").select("doc_id"))
_WORDS = r"WITH l AS (SELECT doc_id, i + 1 AS line, unnest(regexp_extract_all(s[i + 1], '[A-Za-z0-9_]+')) AS word FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) x, unnest(range(len(s))) AS t(i)) "
_on("word_search", _WORDS + "SELECT DISTINCT doc_id, line::INT AS line FROM l WHERE word = 'token'", "documents", lambda t: S.word_hits(S.word_index(t), "token"))
_on("word_index", _WORDS + "SELECT DISTINCT word, doc_id, line::INT AS line FROM l WHERE length(word) >= 2", "documents", S.word_index)
_TRI = f"WITH f AS (SELECT doc_id, {_FOLD} AS t FROM documents) "
_on("trigram_postings", _TRI + ", g AS (SELECT DISTINCT doc_id, t[i:i + 2] AS tri FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM f)) SELECT tri, count(*) AS n FROM g GROUP BY tri", "documents", lambda t: S.postings(t).groupBy("tri").agg(F.count("*").alias("n")))
_on("trigram_candidates", _TRI + "SELECT doc_id FROM f WHERE contains(t, 'exa') AND contains(t, 'xam') AND contains(t, 'amp') AND contains(t, 'mpl') AND contains(t, 'ple')", "documents", lambda t: S.candidates(S.postings(t), "Example"))
_on("regex_search", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(token|password) ?= ?.[0-9a-f]{8}')", "documents", lambda t: S.regex_search(t, r"(token|password) ?= ?.[0-9a-f]{8}").select("doc_id"))
_on("regex_candidates", _TRI + "SELECT doc_id FROM f WHERE (contains(t, 'tok') AND contains(t, 'oke') AND contains(t, 'ken') OR contains(t, 'mai') AND contains(t, 'ail')) AND contains(t, 'exa') AND contains(t, 'xam')", "documents", lambda t: S.regex_candidates(S.postings(t), "(token|mail)[0-9]*exam"))
_on("ngram_search", f"SELECT doc_id FROM documents WHERE contains({_FOLD}, 'example.com')", "documents", lambda t: S.search(_narrow(t, "example.com"), "example.com").select("doc_id"))
_on("ascii_fold_and_reduce", f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents", "documents", lambda t: t.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded")))
_on("digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents", "documents", lambda t: t.select("doc_id", T.sha256_hex(F.col("text")).alias("sha256"), F.md5("text").alias("md5")))
_on("url_decode", "SELECT page_id, url_decode(url) AS url FROM pages", "pages", lambda t: t.select("page_id", T.url_decode(F.col("url")).alias("url")))
_on("line_diff", None, "documents", lambda t: t.alias("a").join(t.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).select(F.col("a.doc_id").alias("doc_id"), F.explode(line_diff(F.col("a.text"), F.col("b.text"))).alias("d")).groupBy("doc_id").agg(*(F.count_if(F.col("d.tag") == x).alias(x) for x in ("same", "added", "removed"))))


def _narrow(docs: DataFrame, q: str) -> DataFrame:
    own = S.ngram_candidates(S.ngram_index(docs), q)
    return docs if own is None else docs.join(own, "doc_id", "left_semi")


# vectors: the query is the first vector's values, written out

_QUERY = [round(((i * 37) % 64 - 31.5) / 100, 4) for i in range(64)]
_q = "[" + ", ".join(map(str, _QUERY)) + "]::DOUBLE[]"
_E = "embedding::DOUBLE[]"
_TOP = "SELECT vec_id, round({0}, 6) AS score FROM embeddings ORDER BY {0} {1}, vec_id LIMIT 10"
_exact = {"cosine": _TOP.format(f"list_cosine_similarity({_E}, {_q})", "DESC"), "dot": _TOP.format(f"list_dot_product({_E}, {_q})", "DESC"), "l2": _TOP.format(f"list_distance({_E}, {_q})", "ASC")}
_six = lambda df: df.withColumn("score", F.round("score", 6))
for _metric, _sql in _exact.items():
    _on(f"vector_topk_{_metric}", _sql, "embeddings", lambda t, m=_metric: _six(X.exact(t, _QUERY, 10, metric=m)))
    _on(f"vector_int8_topk_{_metric}", _sql, "embeddings", lambda t, m=_metric: _six(X.int8_search(X.with_int8(t), _QUERY, 10, metric=m)))
    _on(f"vector_quantized_topk_{_metric}", None, "embeddings", lambda t, m=_metric: _six(X.quantized_search(X.quantized(t, q := X.Quantizer(64)), q, _QUERY, 10, metric=m)))
_on("vector_ivf_topk", None, "embeddings", lambda t: _six(X.Clusters(t).search(_QUERY, 10)))
_on("vector_ivf_all_probes", _exact["cosine"], "embeddings", lambda t: _six(X.Clusters(t).search(_QUERY, 10, probes=16)))
_on("vector_memory", "SELECT count(*) AS vectors, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings", "embeddings", X.memory_bytes)
_on("vector_norms", f"SELECT vec_id, round(sqrt(list_dot_product({_E}, {_E})), 6) AS norm FROM embeddings", "embeddings", lambda t: t.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm")))
_on("vector_hadamard", None, "embeddings", lambda t: t.select("vec_id", V.hadamard(F.col("embedding")).alias("h")))


@query(
    f"WITH t AS (SELECT doc_id AS id, 1.0 AS t FROM documents WHERE contains({_FOLD}, 'token') ORDER BY doc_id LIMIT 30), v AS (SELECT vec_id AS id, list_cosine_similarity({_E}, {_q}) AS v FROM embeddings ORDER BY 2 DESC, 1 LIMIT 30), "
    "r AS (SELECT id, coalesce(t, 0) * 0.4 + coalesce(v, 0) * 0.6 AS score FROM t FULL JOIN v USING (id) ORDER BY 2 DESC, 1 LIMIT 10) SELECT id, round(score, 6) AS score FROM r WHERE id IN (SELECT doc_id FROM documents)"
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _six(S.hybrid(table(spark, d, "documents"), table(spark, d, "embeddings"), "token", _QUERY, 10, 0.4, 0.6))


_on("context_discovery", None, "pages", lambda t: S.context(t.select(F.col("url").alias("path"), F.col("html").alias("text")), "the", 10))

# versions: events as a log of users' documents

_ELOG = "SELECT user_id AS doc_id, 'u' || user_id AS key, props AS value, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, event_id AS epoch, epoch_ms(ts) AS ts_ms, CASE WHEN event_type = 'view' THEN epoch_ms(ts) + 3600000 END AS expires_at FROM events"
_VER = f"WITH log AS ({_ELOG}), "
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC) AS rn FROM {0}) WHERE rn = 1 AND op <> 'delete')"


def _events_log(e: DataFrame) -> DataFrame:
    kind, ms = F.col("event_type"), F.unix_millis(F.col("ts").cast("timestamp"))
    op = F.when(kind == "error", "delete").when(kind == "signup", "insert").otherwise("update")
    return e.select(F.col("user_id").alias("doc_id"), F.concat(F.lit("u"), "user_id").alias("key"), F.col("props").alias("value"), op.alias("op"), F.col("event_id").alias("epoch"), ms.alias("ts_ms"), F.when(kind == "view", ms + 3600000).alias("expires_at"))


_MID, _NOW = 1705000000000, 1706000000000
_kv = lambda df: df.select("key", "value", "epoch")
_on("latest_version", _VER + f"x AS {_LATEST.format('log')} SELECT key, value, epoch FROM x", "events", lambda e: _kv(L.latest(_events_log(e))))
_on("latest_unexpired", _VER + f"x AS {_LATEST.format('log')} SELECT key, value, epoch FROM x WHERE expires_at IS NULL OR expires_at > {_NOW}", "events", lambda e: _kv(L.latest(_events_log(e), now_ms=_NOW)))
_on("as_of_epoch", _VER + f"o AS (SELECT * FROM log WHERE epoch <= 400), x AS {_LATEST.format('o')} SELECT key, value, epoch FROM x", "events", lambda e: _kv(L.as_of_epoch(_events_log(e), 400)))
_on("as_of_time", _VER + f"o AS (SELECT * FROM log WHERE ts_ms <= {_MID}), x AS {_LATEST.format('o')} SELECT key, value, epoch FROM x", "events", lambda e: _kv(L.as_of_time(_events_log(e), _MID)))
_on("epoch_at_time", _VER + f"x AS (SELECT max(epoch) AS epoch FROM log WHERE ts_ms <= {_MID}) SELECT * FROM x", "events", lambda e: L.epoch_at(_events_log(e), _MID))
_on("version_history", _VER + "x AS (SELECT key, epoch, row_number() OVER w - 1 AS version, lag(epoch) OVER w AS previous_epoch, lead(epoch) OVER w IS NULL AS is_latest FROM log WINDOW w AS (PARTITION BY key ORDER BY epoch)) SELECT * FROM x", "events", lambda e: L.history(_events_log(e)).select("key", "epoch", "version", "previous_epoch", "is_latest"))
_on("version_gc", _VER + "x AS (SELECT key, epoch, lead(epoch) OVER (PARTITION BY key ORDER BY epoch) AS nxt FROM log) SELECT key, epoch FROM x WHERE nxt IS NULL OR nxt > 500", "events", lambda e: L.collect_garbage(_events_log(e), 500).select("key", "epoch"))
_on("log_compaction", _VER + "x AS (SELECT key, max(epoch) AS epoch, arg_max(op, epoch) AS op FROM log GROUP BY key) SELECT * FROM x", "events", lambda e: L.compact(_events_log(e)).select("key", "epoch", "op"))
_on("ttl_expired", _VER + f"x AS {_LATEST.format('log')} SELECT key, epoch FROM x WHERE expires_at <= {_NOW}", "events", lambda e: L.expired(_events_log(e), _NOW).select("key", "epoch"))
_on("ttl_purge", _VER + f"x AS {_LATEST.format('log')} SELECT key, epoch FROM log WHERE key NOT IN (SELECT key FROM x WHERE expires_at <= {_NOW})", "events", lambda e: L.purge_expired(_events_log(e), _NOW).select("key", "epoch"))

# branches: orders as the main line, branch "b" writes every 10th key and adds some, branch "c" every 15th

_BR = "WITH main AS (SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS value, o_orderkey AS epoch FROM orders), w AS (SELECT 'b' AS branch, CASE WHEN o_orderkey % 30 = 0 THEN 'new' || o_orderkey ELSE o_orderkey::VARCHAR END AS key, o_orderpriority AS value, o_orderkey % 40 = 10 AS deleted, o_orderkey AS epoch FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'c', o_orderkey::VARCHAR, o_orderpriority, false, o_orderkey FROM orders WHERE o_orderkey % 15 = 0) "


def _branch_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    main = o.select(s.alias("key"), F.col("o_orderstatus").alias("value"), k.alias("epoch"))
    b = o.where(k % 10 == 0).select(F.lit("b").alias("branch"), F.when(k % 30 == 0, F.concat(F.lit("new"), s)).otherwise(s).alias("key"), F.col("o_orderpriority").alias("value"), (k % 40 == 10).alias("deleted"), k.alias("epoch"))
    c = o.where(k % 15 == 0).select(F.lit("c").alias("branch"), s.alias("key"), F.col("o_orderpriority").alias("value"), F.lit(False).alias("deleted"), k.alias("epoch"))
    return main, b.unionByName(c)


def _branch(name: str, sql: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    query(_BR + sql, name)(lambda spark, d: f(*_branch_tables(spark, d)))


_branch("branch_overlay", "SELECT coalesce(w.key, m.key) AS key, CASE WHEN w.key IS NOT NULL THEN w.value ELSE m.value END AS value FROM main m FULL JOIN (SELECT * FROM w WHERE branch = 'b') w ON m.key = w.key WHERE w.deleted IS NULL OR NOT w.deleted", lambda m, w: B.view(m, w, "b"))
_branch("branch_diff_keys", "SELECT w.key, CASE WHEN deleted THEN 'deleted' WHEN m.key IS NOT NULL THEN 'modified' ELSE 'added' END AS change FROM w LEFT JOIN main m ON m.key = w.key WHERE branch = 'b'", lambda m, w: B.modified(m, w, "b"))
_branch("branch_merge_conflicts", "SELECT w.key FROM w JOIN main m ON m.key = w.key WHERE branch = 'b' AND m.epoch >= 500", lambda m, w: B.conflicts(m, w, "b", 500))
_branch("branch_merge", "SELECT w.key, CASE WHEN NOT deleted THEN w.value END AS value, CASE WHEN deleted THEN 'delete' WHEN m.key IS NOT NULL THEN 'update' ELSE 'insert' END AS op, 9999::BIGINT AS epoch FROM w LEFT JOIN main m ON m.key = w.key WHERE branch = 'b' AND NOT coalesce(m.epoch >= 500, false) AND (NOT deleted OR m.key IS NOT NULL)", lambda m, w: B.merge(m, w, "b", 500, 9999))
_branch("branch_compare", "SELECT w.key, max(m.value) AS main_value, count(*) AS n, string_agg(branch || ':' || w.value, ',' ORDER BY branch) AS views FROM w LEFT JOIN main m ON m.key = w.key GROUP BY w.key", lambda m, w: B.compare(m, w).select("key", "main_value", F.size("views").cast("long").alias("n"), F.concat_ws(",", F.transform("views", lambda v: F.concat_ws(":", v["branch"], v["value"]))).alias("views")))
_branch("branch_counts", "SELECT count(*) FILTER (WHERE NOT deleted AND m.key IS NULL) AS added, count(*) FILTER (WHERE NOT deleted AND m.key IS NOT NULL) AS modified, count(*) FILTER (WHERE deleted) AS deleted FROM w LEFT JOIN main m ON m.key = w.key WHERE branch = 'b'", lambda m, w: B.counts(m, w, "b"))
_branch("overlay_scan", "SELECT key, value FROM w WHERE branch = 'b' AND NOT deleted UNION ALL SELECT key, value FROM main WHERE key NOT IN (SELECT key FROM w WHERE branch = 'b')", lambda m, w: B.overlay_scan(m, w.where("branch = 'b'")))

# change feed and windows

_SUBS = [("s1", "t1", "click"), ("s2", "t1", ""), ("s3", "t2", "")]
_SECRET = "not much of a secret"
_PAD = [bytes(b ^ p for b in _SECRET.encode().ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]
_FEED = "SELECT event_id AS seq, 't' || (user_id % 3) AS tenant, event_type AS collection, 'u' || user_id AS key, value::INT::VARCHAR AS value, 'update' AS op FROM events"


def _feed(e: DataFrame) -> DataFrame:
    rows = e.select(F.col("event_id").alias("epoch"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant"), F.col("event_type").alias("collection"), F.concat(F.lit("u"), "user_id").alias("key"), F.floor("value").cast("string").alias("value"), F.lit("update").alias("op"))
    return W.changes(rows)


_FEED = _FEED.replace("value::INT::VARCHAR", "floor(value)::BIGINT::VARCHAR")
_on("cdc_feed", _FEED, "events", _feed)


@query(
    f"WITH f AS ({_FEED}), s(subscription, tenant, collection) AS (VALUES {', '.join(map(str, _SUBS))}), "
    """p AS (SELECT subscription, seq, '{"seq":' || seq || ',"tenant":"' || f.tenant || '","collection":"' || f.collection || '","key":"' || key || '","value":"' || value || '","op":"' || op || '"}' AS payload FROM f JOIN s ON f.tenant = s.tenant AND (s.collection = '' OR s.collection = f.collection)) """
    f"SELECT subscription, seq, payload, sha256(unhex('{_PAD[1]}') || unhex(sha256(unhex('{_PAD[0]}') || encode(payload)))) AS signature FROM p"
)
def cdc_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return W.deliveries(_feed(table(spark, d, "events")), spark.createDataFrame(_SUBS, "subscription string, tenant string, collection string"), _SECRET)


_WIN = "SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, round(total, 2) AS total FROM ({0})"
_HOUR = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


_on("window_tumbling", _WIN.format(_HOUR), "events", lambda e: _shown(W.tumbling(e, "1 hour", by=["event_type"])))
_on("window_sliding", _WIN.format("SELECT date_trunc('hour', ts) - to_hours(i) AS start, event_type, count(*) AS n, sum(value) AS total FROM events, range(2) AS r(i) GROUP BY 1, 2"), "events", lambda e: _shown(W.sliding(e, "2 hours", "1 hour", by=["event_type"])))
_on("window_session", _WIN.format("SELECT min(ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY event_type, s"), "events", lambda e: _shown(W.sessions(e, "10 minutes", by=["event_type"])))
_on("ops_quota", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 3, date_trunc('second', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n > 1", "events", lambda e: N.over_quota(e.withColumn("tenant", F.col("user_id") % 3), 1, order="event_id").select("event_id"))
_on("activity_state", "SELECT user_id, CASE WHEN idle >= 1800 THEN 'deep' WHEN idle >= 60 THEN 'light' WHEN qps >= 100 THEN 'hot' ELSE 'warm' END AS state FROM (SELECT user_id, max(ts) AS last, count(*) AS qps, epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) AS idle FROM events GROUP BY user_id)", "events", lambda e: e.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("qps")).crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("user_id", N.activity((F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6, F.col("qps")).alias("state")))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    batch = table(spark, d, "events")
    return W.read_stream(spark, f"{d}/event[s].parquet", batch.schema)


@query(_WIN.format(_HOUR))
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The hourly windows, from a stream in complete mode."""
    return _shown(W.run_to_table(W.tumbling(_stream(spark, d), "1 hour", by=["event_type"]), shared_folder(spark), "complete"))


@query(f"WITH f AS ({_FEED}) SELECT seq, f.tenant, subscription FROM f JOIN (VALUES {', '.join(map(str, _SUBS))}) s(subscription, tenant, collection) ON f.tenant = s.tenant AND (s.collection = '' OR s.collection = f.collection)")
def stream_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Signed deliveries, from a stream."""
    subs = spark.createDataFrame(_SUBS, "subscription string, tenant string, collection string")
    out = W.run_to_table(W.deliveries(_feed(_stream(spark, d)), subs, _SECRET), shared_folder(spark))
    return out.select("seq", F.get_json_object("payload", "$.tenant").alias("tenant"), "subscription")


# distribution

_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, [('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::HUGEINT for i in range((length(hex(encode({0}))) // 2)::BIGINT)]), lambda h, b: ((h - h % 256 + xor(h % 256, b)) * 1099511628211) % 18446744073709551616)"
_on("partition_routing", f"SELECT c_custkey, ({_FNV.format('c_name')} % 16)::INT AS partition FROM customer", "customer", lambda t: t.select("c_custkey", D.hash_partition(F.col("c_name"), 16).alias("partition")))
_on("partition_stats", f"SELECT ({_FNV.format('c_name')} % 16)::INT AS partition, count(*) AS docs FROM customer GROUP BY 1", "customer", lambda t: D.partition_stats(t, "c_name", 16))
_on("range_routing", "SELECT o_orderkey, (CASE WHEN o_orderkey >= 100 THEN 1 ELSE 0 END + CASE WHEN o_orderkey >= 200 THEN 1 ELSE 0 END + CASE WHEN o_orderkey >= 300 THEN 1 ELSE 0 END)::INT AS partition FROM orders", "orders", lambda t: t.select("o_orderkey", D.range_partition(F.col("o_orderkey"), [100, 200, 300]).alias("partition")))
_RING = f"WITH v AS (SELECT node, {_FNV.format('name')} AS place FROM (SELECT n AS node, n || '#' || i AS name FROM (VALUES ('a'), ('b'), ('c')) t(n), range(150) r(i))), k AS (SELECT c_custkey, {_FNV.format('c_name')} AS h FROM customer), "


@query(_RING + "d AS (SELECT c_custkey, node, row_number() OVER (PARTITION BY c_custkey ORDER BY (place - h + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT, node) AS n FROM k, v) SELECT c_custkey, node FROM d WHERE n = 1")
def ring_lookup(spark: SparkSession, d: str) -> DataFrame:
    return D.ring_owner(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", D.ring(spark, ["a", "b", "c"])).select("c_custkey", "node")


@query(_RING + "m AS (SELECT c_custkey, node, min((place - h + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT) AS way FROM k, v GROUP BY ALL), d AS (SELECT c_custkey, node, row_number() OVER (PARTITION BY c_custkey ORDER BY way, node) - 1 AS replica FROM m) SELECT c_custkey, replica, node FROM d WHERE replica < 2")
def ring_replicas(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return D.ring_replicas(c, "c_name", D.ring(spark, ["a", "b", "c"]), 2).join(c, "c_name").select("c_custkey", "replica", "node")


_TXN = "WITH t AS (SELECT l_orderkey // 16 AS batch, l_orderkey AS seq, l_partkey // 50 AS k FROM lineitem), p AS (SELECT DISTINCT a.batch, a.seq AS first, b.seq AS second FROM t a JOIN t b ON a.batch = b.batch AND a.k = b.k AND a.seq < b.seq) "


def _transactions(t: DataFrame) -> DataFrame:
    return t.groupBy(F.floor(F.col("l_orderkey") / 16).alias("batch"), F.col("l_orderkey").alias("seq")).agg(F.collect_list(F.floor(F.col("l_partkey") / 50)).alias("write_set"))


_on("write_set_overlaps", _TXN + "SELECT * FROM p", "lineitem", lambda t: D.overlapping_writes(_transactions(t)))
_on("write_set_survivors", _TXN + "SELECT DISTINCT batch, seq FROM t WHERE (batch, seq) NOT IN (SELECT batch, second FROM p)", "lineitem", lambda t: D.surviving(_transactions(t)).select("batch", "seq"))

# encodings

_on("dictionary_encode", "WITH f AS (SELECT o_orderpriority AS value, min(o_orderkey) AS first FROM orders GROUP BY 1), c AS (SELECT value, row_number() OVER (ORDER BY first, value) - 1 AS code FROM f) SELECT o_orderkey, code FROM orders JOIN c ON value = o_orderpriority", "orders", lambda t: C.encode(t, "o_orderpriority", C.dictionary(t, "o_orderpriority", "o_orderkey")).select("o_orderkey", "code"))
_RUNS = "WITH n AS (SELECT *, row_number() OVER w - 1 AS row, CASE WHEN lag(l_linestatus) OVER w IS NOT DISTINCT FROM l_linestatus THEN 0 ELSE 1 END AS new FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)), g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY row) - 1 AS run FROM n), r AS (SELECT l_suppkey, run::BIGINT AS run, min(l_linestatus) AS l_linestatus, min(row) AS first_row, count(*) AS rows FROM g GROUP BY 1, 2) "
_runs = lambda t: C.runs(t, "l_linestatus", ["l_shipdate", "l_orderkey", "l_linenumber"], ["l_suppkey"])
_on("rle_runs", _RUNS + "SELECT * FROM r", "lineitem", _runs)
_on("rle_access", _RUNS + "SELECT l_suppkey, l_linestatus FROM r WHERE first_row <= 5 AND first_row + rows > 5", "lineitem", lambda t: C.run_at(_runs(t), 5).select("l_suppkey", "l_linestatus"))
_on("rle_ratio", _RUNS + "SELECT round(sum(rows) / count(*), 6) AS ratio FROM r", "lineitem", lambda t: C.run_ratio(_runs(t)).select(F.round("ratio", 6).alias("ratio")))
for _op, _set, _f in (("and", "INTERSECT", C.bitmap_intersection), ("or", "UNION", C.bitmap_union)):
    query(f"SELECT count(*) AS size FROM (SELECT doc_id FROM labels WHERE quality = 1 {_set} SELECT doc_id FROM documents WHERE lang = 'en')", f"bitmap_{_op}")(
        lambda spark, d, f=_f: C.bitmap_size(f(C.bitmap(table(spark, d, "labels").where("quality = 1"), "doc_id"), C.bitmap(table(spark, d, "documents").where("lang = 'en'"), "doc_id")))
    )

# packages

_V = ["0.1.0", "0.1.5", "0.2.0", "1.0.0-beta", "1.0.0", "1.2.3", "1.3", "2.0.0", "x"]
_MEETS = {"^1.0.0": "1.0.0 1.2.3 1.3", "~1.2": "1.2.3", "^0.1.2": "0.1.5", ">=1.0.0-beta,<1.2.3": "1.0.0-beta 1.0.0", "1.2.3": "1.2.3 1.3", "=2.0.0": "2.0.0"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{v}')" for c, vs in _MEETS.items() for v in vs.split()) + ") t(wanted, version)")
def semver_match(spark: SparkSession, d: str) -> DataFrame:
    versions = spark.createDataFrame([(v,) for v in _V], "version string")
    found = [versions.where(satisfies(F.col("version"), c)).select(F.lit(c).alias("wanted"), "version") for c in _MEETS]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_on("package_search", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ECONOMY') OR contains(p_type, 'ECONOMY')", "part", lambda t: R.search_packages(t.withColumnsRenamed({"p_name": "name", "p_type": "description"}), "ECONOMY").select("p_partkey", F.col("name").alias("p_name")))
_on("content_store", "SELECT DISTINCT sha256(text) AS digest FROM documents", "documents", lambda t: R.store(t.select(F.col("text").alias("data"))).select("digest"))
_on("tree_digest", "SELECT source AS tree, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id || ':' || sha256(text))) AS digest FROM documents GROUP BY source", "documents", lambda t: R.tree_digest(t.select(F.col("source").alias("tree"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("data"))))

# what Spark brings


def _two(name: str, sql: str, a: str, b: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    query(sql, name)(lambda spark, d: f(table(spark, d, a), table(spark, d, b)))


_CO = "SELECT c_custkey, o_orderkey FROM customer {0} JOIN orders ON c_custkey = o_custkey"
_two("join_inner", _CO.format(""), "customer", "orders", lambda c, o: c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", "o_orderkey"))
_two("join_left", _CO.format("LEFT"), "customer", "orders", lambda c, o: c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey"))
_two("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "customer", "orders", lambda c, o: c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey"))
_two("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "customer", "orders", lambda c, o: c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey"))
_BANDS = [(i, -1000.0 + 1500 * i, 1000.0 + 1500 * i) for i in range(8)]


@query(f"SELECT c_custkey, band FROM customer JOIN (VALUES {', '.join(map(str, _BANDS))}) b(band, low, high) ON c_acctbal >= low AND c_acctbal < high")
def join_range(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame(_BANDS, "band int, low double, high double")
    return J.in_ranges(table(spark, d, "customer"), bands, "c_acctbal", "low", "high", 500.0).select("c_custkey", "band")


@query("SELECT c.event_id, p.event_id AS right_event_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """Clicks with the user's last purchase before."""
    e = table(spark, d, "events")
    return J.asof(e.where("event_type = 'click'").select("user_id", "ts", "event_id"), e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), ["user_id"], "ts", ["event_id"]).select("event_id", "right_event_id")


_w = lambda: Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
_W = "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_on("win_rank", f"SELECT o_orderkey, row_number() OVER w AS n, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders {_W}", "orders", lambda t: t.select("o_orderkey", F.row_number().over(_w()).alias("n"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("r"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("dr")))
_on("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after FROM orders {_W}", "orders", lambda t: t.select("o_orderkey", F.lag("o_totalprice").over(_w()).alias("before"), F.lead("o_totalprice").over(_w()).alias("after")))
_on("win_rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders", "orders", lambda t: t.select("o_orderkey", F.round(F.sum("o_totalprice").over(_w().rowsBetween(-2, 0)), 2).alias("moving")))
for _op, _f in (("union", lambda a, b: a.union(b).distinct()), ("intersect", lambda a, b: a.intersect(b)), ("except", lambda a, b: a.subtract(b))):
    _two(f"set_{_op}", f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 {_op.upper()} SELECT s_nationkey FROM supplier", "customer", "supplier", lambda c, s, f=_f: f(c.where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")), s.select("s_nationkey")))
_on("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2", "lineitem", lambda t: t.where("l_shipdate <= DATE '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count("*").alias("n")))


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return flagship(spark, sf_dir)
