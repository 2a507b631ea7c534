"""Near-duplicate documents by ProbMinHash.

A document is its weighted set of word bigrams (weight: occurrences; a document
of one word has that word).  Each element sends a Poisson process of arrivals,
of rate its weight, to random components of the signature, and a component is
won by the first to arrive; all first arrivals are taken, then all second ones,
and an element ends as soon as it is later than every component's winner.  Two
documents agree in a component with the probability of their probability Jaccard
similarity.  Bands of the signature give candidates; within a band's bucket the
similarity is verified over the whole signature, and documents connected by
verified pairs form a group, of which the least doc_id stays.

Inside a bucket a search goes out from each document over those not reached yet,
so a bucket of thousands of near copies costs about its size, not its square,
and no pair is passed over.

Defined cases: texts without words (null, empty, punctuation only) have no
signature and stay; rows with a null id stay; a row that repeats another, id and
text, with or without words, is dropped (the first by its other columns' JSON stays);
rows of one id are one document; a single long text is hashed
in pieces and is as long as it likes; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, hash_tokens, keyed

COMPONENTS, ROWS = 128, 4
THRESHOLD = 0.55
_DOC_BITS = 14
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def elements(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 50-bit hash, weight) of the distinct bigrams of at most 2**14 documents."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    pair = np.empty_like(h)
    pair[:-1] = _mix(h[:-1] * _A + _mix(h[1:]))
    last = np.zeros(len(h), bool)
    last[offsets[1:][n > 0] - 1] = True
    single = np.zeros(len(h), bool)
    single[offsets[:-1][n == 1]] = True
    pair[single] = _mix(h[single] + _A)
    use = ~last | single
    packed = np.sort((doc[use] << np.uint64(64 - _DOC_BITS)) | (pair[use] >> np.uint64(_DOC_BITS)))
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.empty(0, np.int64)
    weight = np.diff(np.r_[first, len(packed)]).astype(np.float64)
    return (packed[first] >> np.uint64(64 - _DOC_BITS)).astype(np.int64), packed[first] & np.uint64((1 << (64 - _DOC_BITS)) - 1), weight


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """The winners, (n, m) uint64; the rows of documents without elements are 0."""
    soonest, winner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    limit = np.full(n, np.inf)
    time, turn = np.zeros(len(doc)), 0
    while len(doc):
        turn += 1
        r = _mix(element + np.uint64(turn * int(_A) & (1 << 64) - 1))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        at = doc * m + (_mix(r + _B) % np.uint64(m)).astype(np.int64)
        early = time < limit[doc]
        if early.any():
            np.minimum.at(soonest, at[early], time[early])
            won = early & (time == soonest[at])
            winner[at[won]] = element[won]
            if turn <= 4 or turn % 4 == 0:
                touched = np.unique(doc) if len(doc) < n else slice(None)
                limit[touched] = soonest.reshape(n, m)[touched].max(1)
                early = time < limit[doc]
        if not early.all():
            doc, element, weight, time = doc[early], element[early], weight[early], time[early]
    return winner.reshape(n, m)


def _sign(batches):
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, h, offsets in hash_tokens(batch.column(1), unicode=True):
            for a in range(0, hi - lo, 1 << _DOC_BITS):
                o = offsets[a : a + (1 << _DOC_BITS) + 1]
                doc, element, weight = elements(h[o[0] : o[-1]], o - o[0])
                n = len(o) - 1
                has = np.flatnonzero(np.diff(o) > 0)
                short = (_mix(signatures(doc, element, weight, n)) >> np.uint64(48)).astype(np.uint16)[has]
                sigs = [x.tobytes() for x in short]
                digest = [hashlib.blake2b(x, digest_size=16).digest() for x in sigs]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + a + has)), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "digest", "sig"])


def _matrix(column: pa.Array, m: int = COMPONENTS) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint16, len(column) * m, at).reshape(-1, m)


def _bands(batches):
    for batch in batches:
        if not len(batch):
            continue
        sig, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
        keys = np.ascontiguousarray(sig).view(np.uint64)  # ROWS times 16 bits
        for band in range(COMPONENTS // ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(_mix(keys[:, band] + np.uint64(band * int(_A) & (1 << 64) - 1)).view(np.int64)), pa.array(ids)], ["key", "doc_id"])


def _groups(batches, columns: int):
    """Batches cut so that no group of equal keys, the first column, is split; the input is sorted by it."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if rest and (cut or key[0] != rest[-1].column(0)[-1].as_py()):
            own = batch.slice(0, int(np.searchsorted(key, rest[-1].column(0)[-1].as_py(), "right")))
            yield pa.Table.from_batches([*rest, own]).combine_chunks()
            start, rest = len(own), []
        else:
            start = 0
        if cut > start:
            yield pa.Table.from_batches([batch.slice(start, cut - start)]).combine_chunks()
            start = cut
        if start < len(batch):
            rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _crowded(batches):
    """The rows of buckets of two documents or more."""
    for t in _groups(batches, 2):
        key = t.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        if keep.any():
            yield from t.filter(pa.array(keep)).to_batches()


def reach(sig: np.ndarray, least: int) -> np.ndarray:
    """For each row the first row that it is connected to by pairs that agree in ``least`` components."""
    n = len(sig)
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        front, start = [left[0]], left[0]
        root[start] = start
        left = left[1:]
        while front and len(left):
            near = (sig[left] == sig[front.pop()]).sum(1) >= least
            found = left[near]
            root[found] = start
            front.extend(found.tolist())
            left = left[~near]
    return root


def _edges(threshold: float):
    least = int(np.ceil(threshold * COMPONENTS))

    def run(batches):
        for t in _groups(batches, 3):
            key, ids = t.column("key").to_numpy(), t.column("doc_id").to_numpy()
            sig = np.concatenate([_matrix(c) for c in t.column("sig").chunks if len(c)])
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            two = start[size == 2]
            ok = two[(sig[two] == sig[two + 1]).sum(1) >= least]
            a, b = [ids[ok]], [ids[ok + 1]]
            for s, c in zip(start[size > 2], size[size > 2]):
                order = s + np.argsort(ids[s : s + c], kind="stable")
                root = reach(sig[order], least)
                far = np.flatnonzero(root != np.arange(c))
                a.append(ids[order[root[far]]])
                b.append(ids[order[far]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(doc_id, kept_doc_id) of all but the least document of each connected group; ``edges`` has a < b.

    Alternating large and small stars: each round points every document to the
    least one it sees, until nothing changes; the rounds grow with the logarithm of
    the longest chain, so ``most`` of them are an error.
    """
    now = checkpoint(edges.select(F.col("b").alias("u"), F.col("a").alias("v")).where("u > v").distinct())
    by_u = Window.partitionBy("u")
    mark = None
    for _ in range(most):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("doc_id"), F.col("v").alias("kept_doc_id"))
        mark = seen
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("m", F.least("u", F.min("v").over(by_u)))
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small = large.withColumn("m", F.min("v").over(by_u))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = checkpoint(small.select("e.u", "e.v").where("u > v").distinct())
    raise RuntimeError(f"the groups still change after {most} rounds")


def _signed(docs: DataFrame) -> DataFrame:
    signed = keyed(docs).where("doc_id is not null").mapInArrow(_sign, "doc_id long, digest binary, sig binary")
    w = Window.partitionBy("digest").orderBy("doc_id")
    return checkpoint(signed.select("doc_id", F.min("doc_id").over(w).alias("rep"), F.when(F.row_number().over(w) == 1, F.col("sig")).alias("sig")))


def _duplicates(signed: DataFrame, threshold: float) -> DataFrame:
    reps = signed.where("sig is not null").select("doc_id", "sig")
    crowded = reps.mapInArrow(_bands, "key long, doc_id long").repartition("key").sortWithinPartitions("key").mapInArrow(_crowded, "key long, doc_id long")
    rows = crowded.join(reps, "doc_id").select("key", "doc_id", "sig").repartition("key").sortWithinPartitions("key")
    near = rows.mapInArrow(_edges(threshold), "a long, b long").where("a < b").distinct()
    copies = signed.where("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return components(near.unionAll(copies))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id): the documents that go, each with the one of its group that stays."""
    return _duplicates(_signed(docs), threshold)


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group; columns as they are."""
    signed = _signed(docs)
    gone = _duplicates(signed, threshold).select(F.col("doc_id").alias("__gone"))
    # rows that repeat an id and a text, found by the ids alone first: a hot id's rows meet only where some do repeat
    again = docs.groupBy(docs["doc_id"].alias("__id"), F.xxhash64(docs["text"].cast("string")).alias("__hash")).agg(F.count("*").alias("__rows")).where("__id is not null and __rows > 1")
    some = again.select("__id").distinct()
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = [F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)))] if names else [F.lit(0)]
    w = Window.partitionBy("doc_id", F.md5(docs["text"].cast("string")), docs["text"].isNull()).orderBy(*order)
    once = docs.join(some, docs["doc_id"] == some["__id"], "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    docs = docs.join(some, docs["doc_id"] == some["__id"], "left_anti").unionByName(once)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
