"""Line dedup by a deletion-neighbourhood join.

A line is its sequence of words (see ``hash_tokens`` with ``unicode``: case of A to Z
and punctuation don't count, a character of a script without spaces is a word).
Lines of fewer than ``min_words`` words are never judged.  Two lines match when their
edit distance in words is at most ``bound(n)``, n being the words of the shorter one:
0 under 8 words, then n // 8, at most 3.  A line goes if an earlier one, by (doc_id,
line number), matches it; it is said to be a copy of the earliest such line (for an
exact copy: of the first of its kind).

Equal lines meet by two 64-bit hashes: the first of each kind is found with a limit
inside every task before the shuffle, and the copies are joined with the firsts, a
join whose hot keys adaptive execution splits.  For the rest, of at most 3 edits at
most one falls into the first or into the last words of a line, so two lines that
match share, in one of these two blocks, a variant with one word deleted.  Every line
emits the hashed variants of both blocks with a band of its length; equal ones are
joined, pairs whose word counts differ too much are passed over, and the distance of
the rest is verified over the whole lines.

A variant that more than ``HOT`` lines share isn't paired off: its lines are cut into
blocks of ``CELL`` by their hash, every two blocks meet in a cell of their own, with
the lines' words, and a cell gives each line's earliest match, not all pairs.

Defined cases: null and empty texts have no lines that are judged; documents
with a null id are passed through and never compared; rows that repeat a doc_id
count as one document, so a line isn't a copy of itself in such a row; lines that tie
in every word are copies of the earliest; a text or line may be of any length; an
empty table gives an empty one.  Other columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import hash_tokens, keyed

MIN_WORDS, WORDS_PER_EDIT, MAX_EDITS, BAND = 4, 8, 3, 16
SLICE, HOT, CELL = 512, 256, 2048
#: The low bits of a variant's key: 24 of the line's sketch, then 2 of its bound.
LOW = 26
_C, _D, _E = np.uint64(0x16E8FEB86659FD93), np.uint64(0x20761D6478BD642F), np.uint64(0x2127599BF4325C37)
_F = np.uint64(0x9FB21C651E98DF25)
PLACES = "h long not null, h2 long not null, doc_id long, line_no int"
LINES = PLACES + ", words binary"


def bound(n: int) -> int:
    return min(MAX_EDITS, n // WORDS_PER_EDIT)


def _line_hashes(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each line that have no constant in common."""
    n = np.diff(offsets)
    place = np.arange(len(h)) - np.repeat(offsets[:-1], n)
    out = []
    for mix, base, end in ((_C, _D, _E), (_F, _E, _C)):
        power = np.full(int(n.max(initial=0)) + 1, base)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        mixed = h * mix
        mixed ^= mixed >> np.uint64(31)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mixed * power[place], out=total[1:])
        whole = (total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64)) * end
        out.append((whole ^ (whole >> np.uint64(29))).view(np.int64))
    return out[0], out[1]


def _short(h: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash."""
    return ((h * _C) >> np.uint64(32)).astype(np.uint32)


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each line, its number, word hashes, their offsets), a piece of the lines at a time."""
    lists = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
    lines = lists.flatten()
    ends = np.asarray(lists.offsets)
    ends = ends - ends[0]
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    number = np.arange(len(lines)) - ends[row]
    for lo, hi, h, offsets in hash_tokens(lines, unicode=True):
        yield row[lo:hi], number[lo:hi], h, offsets


def _slices(batches):
    """At most ``SLICE`` rows at a time, to bound memory."""
    for batch in batches:
        for lo in range(0, len(batch), SLICE):
            yield batch.slice(lo, SLICE)
        pa.default_memory_pool().release_unused()


def _lines(min_words: int, with_words: bool):
    def run(batches):
        for batch in _slices(batches):
            ids = batch.column(0)
            for row, number, h, offsets in _pieces(batch.column(1)):
                n = np.diff(offsets)
                at = np.flatnonzero(n >= min_words)
                whole, other = _line_hashes(h, offsets)
                cols = [pa.array(whole[at]), pa.array(other[at]), ids.take(pa.array(row[at])), pa.array(number[at].astype(np.int32))]
                if with_words:
                    n[n < WORDS_PER_EDIT] = 0  # shorter lines are matched by their hashes alone
                    long = np.repeat(n > 0, np.diff(offsets))
                    buffer = np.ascontiguousarray(_short(h)[long])
                    # under 2**31 bytes: a piece, or one line
                    starts = pa.py_buffer(np.r_[0, np.cumsum(4 * n)].astype(np.int32))
                    words = pa.Array.from_buffers(pa.binary(), len(n), [None, starts, pa.py_buffer(buffer)])
                    cols.append(pc.if_else(pa.array(n[at] > 0), words.take(pa.array(at)), None))
                yield pa.RecordBatch.from_arrays(cols, ["h", "h2", "doc_id", "line_no", "words"][: len(cols)])

    return run


def _sketch(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """24 bits: the words of a line counted, modulo 8, in 8 classes."""
    n = len(offsets) - 1
    cell = np.repeat(np.arange(n), np.diff(offsets)) * 8 + (words & 7)
    counts = np.bincount(cell, minlength=8 * n).reshape(n, 8) & 7
    return (counts << np.arange(0, 24, 3)).sum(1).astype(np.uint64)


def _variants(batches):
    """For each line (h, words): key, of which the low bits are the bound and the sketch, and h."""
    for batch in batches:
        batch = batch.filter(batch.column(1).is_valid())
        if not len(batch):
            continue
        whole, column = batch.column(0).to_numpy(), batch.column(1)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        words = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint32)
        offsets = (offsets - offsets[0]) // 4
        n = np.diff(offsets)
        low = _sketch(words, offsets) | np.minimum(MAX_EDITS, n // WORDS_PER_EDIT).astype(np.uint64) << np.uint64(24)
        for shift in (0, MAX_EDITS):
            band = (n + shift) // BAND
            fresh = np.ones(len(n), bool) if not shift else band != n // BAND
            for size, use in ((4, fresh & (band == 0)), (6, fresh & (band > 0))):
                at = np.flatnonzero(use)
                if not len(at):
                    continue
                for side, start in ((1, offsets[at]), (2, offsets[at + 1] - size)):
                    block = words[start[:, None] + np.arange(size)].astype(np.uint64)
                    salt = (band[at].astype(np.uint64) * np.uint64(4) + np.uint64(side)) * _D
                    for gone in range(size):
                        key = salt.copy()
                        for j in range(size):
                            if j != gone:
                                key = (key ^ block[:, j]) * _C
                                key ^= key >> np.uint64(32)
                        key = (key * _E) & ~np.uint64((1 << LOW) - 1) | low[at]
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole[at])], ["key", "h"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sketches in two keys allow as many edits as the lesser bound: an edit changes two counts at most."""
    total = np.zeros(len(a), np.uint64)
    for s in range(0, 24, 3):
        d = ((a >> np.uint64(s)) - (b >> np.uint64(s))) & np.uint64(7)
        total += np.minimum(d, np.uint64(8) - d)
    return total <= np.uint64(2) * (np.minimum(a & np.uint64((1 << LOW) - 1), b & np.uint64((1 << LOW) - 1)) >> np.uint64(24))


def _pairs(batches):
    """(h1, h2, null): pairs of lines under one key; (h, null, key): lines under a key that more than HOT have.  The input is sorted by key."""
    none = np.empty(0, np.int64)
    rest_k, rest_h, hot = none, none, None

    def rows(h1, h2, key):
        nothing = lambda x: pa.nulls(len(x), pa.int64())
        parts = [pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), nothing(h1)], ["h1", "h2", "key"])] if len(h1) else []
        return parts + ([pa.RecordBatch.from_arrays([pa.array(key[1]), nothing(key[0]), pa.array(key[0])], ["h1", "h2", "key"])] if len(key[0]) else [])

    def of(key, h):
        nonlocal hot
        group, found = key >> LOW, [np.empty((2, 0), np.int64)]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[start, len(key)])
        crowded = size > HOT
        crowded[0] |= group[0] == hot
        wide = np.repeat(crowded, size)
        if wide.any():
            hot = int(group[-1]) if crowded[-1] else None
        many = (group[wide], h[wide])
        key, h, group = key[~wide].view(np.uint64), h[~wide], group[~wide]
        at, step = np.arange(len(key)), 0
        while True:
            step += 1
            at = at[at + step < len(key)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            ok = at[_close(key[at], key[at + step]) & (h[at] != h[at + step])]
            found.append(np.stack([np.minimum(h[ok], h[ok + step]), np.maximum(h[ok], h[ok + step])]))
        both = np.concatenate(found, axis=1)
        if both.shape[1]:
            order = np.lexsort(both)
            both = both[:, order]
            both = both[:, np.r_[True, (both[:, 1:] != both[:, :-1]).any(0)]]
        return rows(both[0], both[1], many)

    for batch in batches:
        key = np.concatenate([rest_k, batch.column(0).to_numpy()])
        h = np.concatenate([rest_h, batch.column(1).to_numpy()])
        if not len(key):
            continue
        whole = int(np.searchsorted(key >> LOW, key[-1] >> LOW))  # the last group may go on
        if len(key) - whole > HOT:
            whole = len(key)  # it is hot in any case
        if whole:
            yield from of(key[:whole], h[:whole])
        rest_k, rest_h = key[whole:], h[whole:]
    if len(rest_k):
        yield from of(rest_k, rest_h)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance, or most + 1 if larger: the furthest row on each diagonal after each edit."""

    def slide(i: int, j: int) -> int:
        size = 16
        while True:
            x, y = a[i : i + size], b[j : j + size]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            if len(differ):
                return i + int(differ[0])
            if m < size:
                return i + m
            i, j, size = i + m, j + m, size * 4

    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    reach = {0: slide(0, 0)}
    for edits in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return edits
        new = {}
        for d in range(-edits - 1, edits + 2):  # j - i
            i = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -2))
            i = min(i, n, m - d)
            if i >= 0 and i + d >= 0:
                new[d] = slide(i, i + d)
        reach = new
    return most + 1


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all lines, and where each line's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.uint32)
    return data, (offsets - offsets[0]) // 4


def _agree(a: np.ndarray, from_a: np.ndarray, b: np.ndarray, from_b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words from these places on, forwards or backwards, are the same, up to ``most``."""
    pair = np.repeat(np.arange(len(most)), most)
    step = (np.arange(len(pair)) - np.repeat(np.cumsum(most) - most, most)) * way
    differ = np.flatnonzero(a[from_a[pair] + step] != b[from_b[pair] + step])
    first, at = np.unique(pair[differ], return_index=True)
    out = most.copy()
    out[first] = np.abs(step[differ[at]])
    return out


def distances(one: pa.Array, two: pa.Array) -> np.ndarray:
    """Edit distance of each pair of lines, or MAX_EDITS + 1 if over the pair's bound: equal ends are cut off for all at once."""
    a, at_a = _ragged(one)
    b, at_b = _ragged(two)
    n, m = np.diff(at_a), np.diff(at_b)
    most = np.minimum(MAX_EDITS, np.minimum(n, m) // WORDS_PER_EDIT)
    out = np.full(len(n), MAX_EDITS + 1)
    open_ = np.flatnonzero(np.abs(n - m) <= most)
    size = np.cumsum(np.minimum(n, m)[open_])
    for k in range(0, int(size[-1]) + 1 if len(size) else 0, 1 << 21):  # pieces, to bound memory
        own = open_[(size >= k) & (size < k + (1 << 21))]
        if not len(own):
            continue
        x, y, short = n[own], m[own], np.minimum(n, m)[own]
        head = _agree(a, at_a[own], b, at_b[own], short, 1)
        tail = _agree(a, at_a[own] + x - 1, b, at_b[own] + y - 1, short - head, -1)
        x, y = x - head - tail, y - head - tail
        easy = (np.minimum(x, y) == 0) | (np.maximum(x, y) == 1)
        out[own[easy]] = np.maximum(x, y)[easy]
        for i, p, q, r, t, limit in zip(*(v[~easy].tolist() for v in (own, at_a[own] + head, x, at_b[own] + head, y, most[own]))):
            out[i] = distance(a[p : p + q], b[r : r + t], limit)
    out[out > most] = MAX_EDITS + 1
    return out


def _verify(batches):
    for batch in batches:
        far = distances(batch.column("w1"), batch.column("w2"))
        keep = np.flatnonzero(far <= MAX_EDITS)
        out = batch.select(["d1", "l1", "d2", "l2"]).take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(far[keep].astype(np.int32))], ["d1", "l1", "d2", "l2", "distance"])


def _bags(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The words of each line counted, modulo 256, in 64 classes."""
    n = len(offsets) - 1
    cell = np.repeat(np.arange(n), np.diff(offsets)) * 64 + (words & 63)
    return np.bincount(cell, minlength=64 * n).reshape(n, 64).astype(np.uint8)


def earliest(block: np.ndarray, words: np.ndarray, offsets: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each line the first one before it that matches, or -1, and the distance; with ``across`` only lines of another block count."""
    n, bags = np.diff(offsets), _bags(words, offsets)
    first, far = np.full(len(n), -1), np.zeros(len(n), np.int32)
    open_ = np.arange(len(n))
    for p in range(len(n)):
        open_ = open_[open_ > p]
        if not len(open_):
            break
        near = open_[np.abs(n[open_] - n[p]) <= MAX_EDITS]
        if across:
            near = near[block[near] != block[p]]
        most = np.minimum(MAX_EDITS, np.minimum(n[near], n[p]) // WORDS_PER_EDIT)
        near = near[np.abs((bags[near] - bags[p]).view(np.int8)).sum(1, dtype=np.int64) <= 2 * most]
        own = words[offsets[p] : offsets[p + 1]]
        for q in near.tolist():
            limit = bound(int(min(n[p], n[q])))
            d = distance(own, words[offsets[q] : offsets[q + 1]], limit)
            if d <= limit:
                first[q], far[q] = p, d
        open_ = open_[first[open_] < 0]
    return first, far


def _cells(batches):
    """The input, (key, i, j, block, doc_id, line_no, words), is sorted by cell, then by place."""
    held: list[pa.RecordBatch] = []

    def of():
        t = pa.Table.from_batches(held).combine_chunks()
        block, doc, line = (t.column(k).to_numpy() for k in ("block", "doc_id", "line_no"))
        words, offsets = _ragged(t.column("words").chunk(0))
        first, far = earliest(block, words, offsets, t.column("i")[0] != t.column("j")[0])
        own = np.flatnonzero(first >= 0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first[own]], line[first[own]], doc[own], line[own], far[own])], ["d1", "l1", "d2", "l2", "distance"])

    for batch in batches:
        at = [batch.column(k).to_numpy() for k in range(3)]
        new = np.zeros(len(batch), bool)
        for x in at:
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if held and any(held[-1].column(k)[-1].as_py() != at[k][lo] for k in range(3)):
                yield of()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield of()


def _either(crowded: bool):
    def run(batches):
        """Of what ``_pairs`` gives the pairs alone, or the rest; done here, as a condition would move below the shuffle and double the work."""
        for batch in batches:
            yield batch.filter(batch.column(2).is_valid() if crowded else batch.column(1).is_valid())

    return run


_PAIRS = "h1 long not null, h2 long, key long"
_NEAR = "d1 long, l1 int, d2 long, l2 int, distance int"


def _crowds(hot: DataFrame, found: DataFrame) -> DataFrame:
    """The earliest matches among lines (key, h) under keys that many share, in cells of two blocks."""
    sizes = hot.groupBy("key").agg(F.count("*").alias("c"))
    blocks = F.ceil(F.col("c") / F.lit(CELL)).cast("int")
    dealt = hot.join(sizes, "key").select("key", "h", blocks.alias("blocks"), F.pmod(F.xxhash64("h"), blocks).cast("int").alias("block"))
    sent = dealt.select("key", "h", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    sent = sent.select("key", F.least("x", "block").alias("i"), F.greatest("x", "block").alias("j"), "block", "h")
    full = sent.join(found, "h").select("key", "i", "j", "block", "doc_id", "line_no", "words")
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id", "line_no").mapInArrow(_cells, _NEAR)


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no, distance) of every line that goes."""
    own = keyed(docs).where("doc_id is not null")
    # one row for each kind of line; the limit to one works inside each task before the shuffle too
    by_kind = Window.partitionBy("h").orderBy("h2", "doc_id", "line_no")
    firsts = own.mapInArrow(_lines(min_words, True), LINES).withColumn("n", F.row_number().over(by_kind)).where("n = 1").drop("n")
    # by the variant alone: lines under one variant meet whatever their sketches
    variants = firsts.select("h", "words").mapInArrow(_variants, "key long, h long").repartition(F.shiftright("key", LOW)).sortWithinPartitions("key")
    pairs = variants.mapInArrow(_pairs, _PAIRS).distinct()
    wanted = pairs.select(F.explode(F.array("h1", "h2")).alias("h")).where("h is not null").distinct()
    # the shuffle of the firsts by h is reused; only lines of some pair go on from here
    found = firsts.join(wanted, "h", "left_semi").select("h", "doc_id", "line_no", "words")
    one = found.select(F.col("h").alias("h1"), F.col("doc_id").alias("d1"), F.col("line_no").alias("l1"), F.col("words").alias("w1"))
    two = found.select(F.col("h").alias("h2"), F.col("doc_id").alias("d2"), F.col("line_no").alias("l2"), F.col("words").alias("w2"))
    near = pairs.mapInArrow(_either(False), _PAIRS).select("h1", "h2").join(one, "h1").join(two, "h2").select("d1", "l1", "w1", "d2", "l2", "w2").mapInArrow(_verify, _NEAR)
    near = near.unionByName(_crowds(pairs.mapInArrow(_either(True), _PAIRS).select("key", F.col("h1").alias("h")), found))
    first, second = F.struct(F.col("d1").alias("doc_id"), F.col("l1").alias("line_no")), F.struct(F.col("d2").alias("doc_id"), F.col("l2").alias("line_no"))
    near = near.select(F.greatest(first, second).alias("own"), F.least(first, second).alias("kept"), "distance").groupBy("own").agg(F.min(F.struct("kept", "distance")).alias("k"))
    near = near.select("own.doc_id", "own.line_no", F.col("k.kept.doc_id").alias("kept_doc_id"), F.col("k.kept.line_no").alias("kept_line_no"), F.col("k.distance").alias("distance"))
    # the words are of no use here, but without them this would be another shuffle of the firsts
    kept = firsts.where(F.coalesce(F.length("words"), F.lit(0)) >= 0).select("h", F.col("h2").alias("k2"), F.col("doc_id").alias("kept_doc_id"), F.col("line_no").alias("kept_line_no"))
    places = own.mapInArrow(_lines(min_words, False), PLACES)
    elsewhere = (F.col("doc_id") != F.col("kept_doc_id")) | (F.col("line_no") != F.col("kept_line_no"))  # at the same place: a row that repeats
    copies = places.join(kept, "h").where((F.col("h2") == F.col("k2")) & elsewhere).select("doc_id", "line_no", "kept_doc_id", "kept_line_no")
    return copies.withColumn("distance", F.lit(0)).unionByName(near)


def _cut(texts: pa.Array, gone: pa.Array, min_words: int) -> pa.Array:
    judged: dict[int, set] = {}
    for row, number, _, offsets in _pieces(texts):
        for r, k in zip(row[ok := np.diff(offsets) >= min_words].tolist(), number[ok].tolist()):
            judged.setdefault(r, set()).add(k)
    out = []
    for i, (text, lines) in enumerate(zip(texts.to_pylist(), gone.to_pylist())):
        own, drop = judged.get(i), set(lines or ())
        if not drop or text is None:
            out.append(None)
        elif not own:  # a row of this id that has none of the lines
            out.append(text)
        else:
            out.append("\n".join(x for j, x in enumerate(text.split("\n")) if j not in drop) if own - drop else None)
    return pa.array(out, pa.string())


def _without(min_words: int):
    @F.arrow_udf(StringType())
    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        """The texts without the lines of these numbers; null where no line goes, or of the lines that are judged none is left."""
        parts = [_cut(texts.slice(lo, SLICE), gone.slice(lo, SLICE), min_words) for lo in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return without


def drop_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines that go.  A document all of whose judged lines go, goes; ``n_chars``, if there, is the new length."""
    gone = duplicate_lines(docs, min_words).groupBy("doc_id").agg(F.collect_set("line_no").alias("lines"))
    gone = gone.select(F.col("doc_id").alias("__gone_id"), F.col("lines").alias("__gone_lines"))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone["__gone_id"], "left")
    same = F.col("__gone_lines").isNull() | docs["text"].isNull()
    cut = F.when(same, docs["text"]).otherwise(_without(min_words)(docs["text"].cast("string"), F.col("__gone_lines")))
    out = joined.withColumn("__cut", cut).where(same | F.col("__cut").isNotNull())
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__cut").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(same, docs["n_chars"]).otherwise(F.length("__cut")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(docs[c])
    return out.select(*columns)
