"""Text search: scans, word index, trigram postings, regular expressions, hybrid ranking.

The index only narrows down; every hit is verified, so that results are those of the
scan whether an index is there or not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..functions.vector import score
from ..plans import regex as R


def search(df: DataFrame, query: str, column: str = "text", key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """Rows with the phrase of one term, or with all terms, whatever the case of A to Z; by key where there is a limit."""
    found = df.where(T.contains_all_terms(df[column], query))
    return found if limit is None else found.orderBy(key).limit(limit)


def word_index(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, key, line) of the words of two characters or more, once a line; lines count from 1."""
    numbered = df.select(F.col(key), F.posexplode(T.lines(F.col(column))).alias("n", "line_text"))
    each = numbered.select(key, (F.col("n") + 1).alias("line"), F.explode(F.array_distinct(T.words(F.col("line_text")))).alias("word"))
    return each.where(F.length("word") >= T.MIN_WORD).select("word", key, "line")


def word_hits(index: DataFrame, word: str, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """(key, line) of a word, as it is written; with ``most`` the first ones."""
    found = index.where(F.col("word") == word).select(key, "line").distinct()
    return found if most is None else found.orderBy(key, "line").limit(most)


def word_index_without(index: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The word index without some keys' rows."""
    return index.join(keys.select(key), key, "left_anti")


def _parts(df: DataFrame, parts: Callable[[str], Sequence[str]], name: str, column: str, key: str) -> DataFrame:
    own = df.select(F.col(column).alias("__text"), F.col(key))
    return own.mapInArrow(T.rows_of(parts, name), StructType([StructField(name, StringType()), own.schema[key]]))


def postings(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(tri, key) of all distinct trigrams."""
    return _parts(df, T.trigrams, "tri", column, key)


def candidates(index: DataFrame, query: str, key: str = "doc_id") -> DataFrame | None:
    """Keys that have all trigrams of the query; None where it is too short to have one."""
    wanted = T.trigrams_of(query)
    if not wanted:
        return None
    return index.where(F.col("tri").isin(wanted)).groupBy(key).agg(F.count_distinct("tri").alias("n")).where(F.col("n") == len(wanted)).select(key)


def indexed_search(df: DataFrame, index: DataFrame, query: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    own = [c for c in (candidates(index, t, key) for t in T.terms(query)) if c is not None]
    narrowed = reduce(lambda d, c: d.join(c, key, "left_semi"), own, df)
    return search(narrowed, query, column, key)


def regex_candidates(index: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame | None:
    """Keys that pass the pattern's trigram plan: all trigrams of an alternative of each requirement."""
    out = None
    for alternatives in R.trigram_plan(pattern):
        some = None
        for tris in alternatives:
            own = index.where(F.col("tri").isin(tris)).groupBy(key).agg(F.count_distinct("tri").alias("n")).where(F.col("n") == len(tris)).select(key)
            some = own if some is None else some.union(own)
        some = some.distinct()
        out = some if out is None else out.join(some, key, "left_semi")
    return out


def regex_search(df: DataFrame, pattern: str, column: str = "text", ignore_case: bool = True) -> DataFrame:
    return df.where(R.matches(df[column], pattern, ignore_case))


def ngram_index(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(gram, key) of the sparse n-grams."""
    return _parts(df, T.sparse_ngrams_of, "gram", column, key)


def ngram_candidates(index: DataFrame, query: str, key: str = "doc_id") -> DataFrame | None:
    """Keys that have all sparse n-grams of the query; its borders are decided inside it, so every text with it has them.

    None where the query has no whole n-gram.
    """
    wanted = [g for g in T.sparse_ngrams_of(query) if len(g) < T.LONGEST]
    if not wanted:
        return None
    return index.where(F.col("gram").isin(wanted)).groupBy(key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select(key)


def ngram_overlap(index: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """Keys that share any substring of 3 to 16 characters of the query as an n-gram."""
    return index.where(F.col("gram").isin(T.covering_ngrams_of(query))).select(key).distinct()


def vector_scores(vectors: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", id_col: str = "vec_id", metric: str = "cosine") -> DataFrame:
    """(id, score) of the k best; ties go by id."""
    scored = vectors.where(F.size(vector) == len(query)).select(id_col, score(F.col(vector), query, metric).alias("score"))
    return scored.orderBy(F.asc("score") if metric == "l2" else F.desc("score"), id_col).limit(k)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float], limit: int = 10, text_weight: float = 0.5, vector_weight: float = 0.5, key: str = "doc_id", id_col: str = "vec_id", column: str = "text") -> DataFrame:
    """Text hits and vector hits, 3 * limit of each, ranked by the weighted sum; exactly ``limit`` at most."""
    text_hits = search(docs, query, column, key, 3 * limit).select(F.col(key).alias("id"), F.lit(1.0).alias("t"))
    vector_hits = vector_scores(vectors, vector, 3 * limit, id_col=id_col).select(F.col(id_col).alias("id"), F.col("score").alias("v"))
    both = text_hits.join(vector_hits, "id", "full").fillna(0.0)  # at most 3 * limit rows a side
    ranked = both.select("id", (F.col("t") * text_weight + F.col("v") * vector_weight).alias("score"))
    return ranked.orderBy(F.desc("score"), "id").limit(limit).join(docs.select(F.col(key).alias("id")), "id", "left_semi")


def context(files: DataFrame, query: str, limit: int = 10, column: str = "text", key: str = "path", per_name: int = 5) -> DataFrame:
    """(key, role) of what belongs to a query: matches, callers of the functions they define, tests that mention it."""
    found = search(files, query, column, key, 2 * limit)
    names = found.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?:fn|def|func|function) ([A-Za-z0-9_]{3,})"), F.lit(1))).alias("name")).distinct()
    matches = found.select(key, F.lit("match").alias("role"))
    # what every file calls, joined with the names as equal words: no file is held against each name
    called = files.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r"([A-Za-z0-9_]{3,})\("), F.lit(1)))).alias("name"))
    calls = called.join(names, "name").join(matches, key, "left_anti")
    few = Window.partitionBy("name").orderBy(key)
    callers = calls.withColumn("n", F.row_number().over(few)).where(F.col("n") <= per_name).select(key, F.lit("caller").alias("role")).distinct()
    tests = search(files, query, column, key).where(F.contains(F.lower(F.col(key)), F.lit("test"))).select(key, F.lit("test").alias("role"))
    w = Window.partitionBy(key).orderBy(F.when(F.col("role") == "test", 0).when(F.col("role") == "match", 1).otherwise(2))
    return matches.unionByName(callers).unionByName(tests).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
