"""Document fingerprints by I-Match.

The lexicon is every term whose inverse document frequency, ln(documents / documents
with the term), lies in a band: neither the words of every text nor those of a
handful.  A document's distinct lexicon terms are sorted and hashed together; the
same is done with several random subsets of the lexicon, so that a document with a
few other words still shares a fingerprint with its copy.

A term is stood for by its 64-bit hash (see ``hash_tokens``).  Document frequencies
are counted over all documents, combined inside each task before the shuffle.  A
term of the band is in exp(-IDF_MAX) of the documents at least, so the lexicon has
at most exp(IDF_MAX) times the mean number of distinct terms of a document,
however many documents there are; that much is sent to the tasks.

Defined cases: a null or empty text, or one without a term of the band, has 0 terms
and null fingerprints; a null id is carried; rows that repeat each count as a
document and each get their row; an empty table gives an empty result; texts may be
of any length.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_tokens, keyed, token_hash_sql, tokens_sql
from .minhash import components

IDF_MIN, IDF_MAX = 3.0, 6.9
#: Multipliers that deal terms to subsets, all odd and under 2**62; the whole lexicon comes first.
SEEDS = (0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x369DEA0F31A53F85, 0x0FC94E3B9D1A6E27, 0x3C6EF372FE94F82B)
#: A subset has the terms whose product's upper 32 bits are under this.
PART = int(0.7 * (1 << 32))
_HOLD = 2_000_000


def _distinct(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct terms, sorted by both."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _count(batches):
    held, size = [], 0

    def combined():
        terms, counts = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        order = np.argsort(terms)
        terms, counts = terms[order], counts[order]
        first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        return terms[first], np.add.reduceat(counts, first)

    def batch_of(terms, counts):
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], ["term", "df"])

    for batch in batches:
        for _, _, h, offsets in hash_tokens(batch.column(1)):
            if len(h):
                held.append(np.unique(_distinct(h, offsets)[1], return_counts=True))
                size += len(held[-1][0])
                if size > _HOLD:
                    held = [combined()]
                    size = len(held[0][0])
                    if size > _HOLD // 2:
                        yield batch_of(*held[0])
                        held, size = [], 0
    if held:
        yield batch_of(*combined())


def lexicon(docs: DataFrame, idf_min: float = IDF_MIN, idf_max: float = IDF_MAX) -> np.ndarray:
    """The sorted hashes of the terms of the band."""
    n = docs.count()
    df = keyed(docs).mapInArrow(_count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    band = df.where(F.col("df").between(F.lit(n * math.exp(-idf_max)), F.lit(n * math.exp(-idf_min)))).select("term")
    return np.sort(band.toArrow().column(0).to_numpy().view(np.uint64))  # see the bound above


def digests(terms: np.ndarray, offsets: np.ndarray) -> list[str | None]:
    """For each run of sorted terms the MD5 of their hexadecimal digits; None for an empty one."""
    text = terms.astype(">u8").tobytes().hex().encode()
    return [hashlib.md5(text[16 * a : 16 * b]).hexdigest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _printer(shared):
    def run(batches):
        words = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(words >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for lo, hi, h, offsets in hash_tokens(batch.column(1)):
                row = np.repeat(np.arange(hi - lo), np.diff(offsets))
                keep = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
                if len(words):
                    at = np.searchsorted(words, h[keep])
                    at[at == len(words)] = 0
                    keep = keep[words[at] == h[keep]]
                h, row = h[keep], row[keep]
                row, h = _distinct(h, np.searchsorted(row, np.arange(hi - lo + 1)))
                starts = np.searchsorted(row, np.arange(hi - lo + 1))
                cols = [digests(h, starts)]
                for seed in SEEDS:
                    own = np.flatnonzero((h * np.uint64(seed)) >> np.uint64(32) < PART)
                    cols.append(digests(h[own], np.searchsorted(row[own], np.arange(hi - lo + 1))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(starts).astype(np.int32)), *(pa.array(c, pa.string()) for c in cols)], ["doc_id", "n_terms", *(f"f{k}" for k in range(len(cols)))])

    return run


def fingerprints(docs: DataFrame, idf_min: float = IDF_MIN, idf_max: float = IDF_MAX) -> DataFrame:
    """(doc_id, n_terms, f0, f1, ...): f0 is of the whole lexicon, the others of its subsets."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, idf_min, idf_max))
    schema = "doc_id long, n_terms int, " + ", ".join(f"f{k} string" for k in range(len(SEEDS) + 1))
    return keyed(docs).mapInArrow(_printer(shared), schema)


def copies(docs: DataFrame, least_terms: int = 4, **band) -> DataFrame:
    """(doc_id, kept_doc_id): documents that share a fingerprint, directly or through others, and the least of them.

    Documents of fewer than ``least_terms`` lexicon terms are left alone.
    """
    prints = fingerprints(docs, **band).where(F.col("n_terms") >= least_terms).where("doc_id is not null")
    keys = [F.concat(F.lit(f"{k}:"), f"f{k}") for k in range(len(SEEDS) + 1)]
    flat = prints.select("doc_id", F.explode(F.array(*keys)).alias("key")).where("key is not null")
    least = flat.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("key", "a")
    edges = flat.join(least, "key").where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    return components(edges)


_M = "18446744073709551616::HUGEINT"
_print = lambda where: f"md5(string_agg(lower(lpad(to_hex(h::UBIGINT), 16, '0')), '' ORDER BY h){where})"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
pairs AS MATERIALIZED (SELECT DISTINCT row, unnest({tokens_sql("text")}) AS tok FROM docs),
band AS MATERIALIZED (
  SELECT tok, {token_hash_sql("tok")} AS h FROM (
    SELECT tok FROM pairs GROUP BY tok HAVING count(*) >= (SELECT count(*) FROM docs) * exp(-{IDF_MAX}::DOUBLE) AND count(*) <= (SELECT count(*) FROM docs) * exp(-{IDF_MIN}::DOUBLE))
), prints AS (
  SELECT row, count(*) AS n_terms, {_print("")} AS f0, {", ".join(_print(f" FILTER (WHERE (h * {s}::HUGEINT % {_M}) // 4294967296::HUGEINT < {PART})") + f" AS f{k}" for k, s in enumerate(SEEDS, 1))}
  FROM pairs JOIN band USING (tok) GROUP BY row
)
SELECT doc_id, coalesce(n_terms, 0)::INT AS n_terms, {", ".join(f"f{k}" for k in range(len(SEEDS) + 1))} FROM docs LEFT JOIN prints USING (row)
"""
