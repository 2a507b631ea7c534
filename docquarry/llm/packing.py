"""Best-fit packing of documents into windows of a fixed number of tokens.

A token here is a word between white space or, in scripts without spaces, a character.
What is longer than a window is cut into pieces of one window and a rest, and each
piece carries its text, so whole texts are packed.  Pieces are dealt to groups by a
hash of id, piece and the row's place among those of its id; each group, of about
``group_size`` pieces, is packed on its own: best fit decreasing, then a local search
over the bins that aren't full.  From the emptiest bin on, pieces move into a fuller
bin with room for them, or are exchanged one for one for a smaller piece, or two for
one, so that the sum of squared fills grows with every step; rounds go on until one
finds no step.  A bin that has lost its last piece is gone.

Defined cases: texts without words (null, empty, white space) have length 0 and
aren't packed; a null id is carried; rows that repeat are packed as often as they
come, a third of all rows under one id over as many groups as others; equal lengths
go by id and piece; an empty table gives an empty result; texts may be of any length.
Other columns aren't read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, unit_starts

CAPACITY, GROUP_SIZE = 2048, 8192
#: Partitions of the shuffle; groups beyond that share one, one after the other.
PARTITIONS = 20_000
#: Rows of a batch that goes back, as they carry text.
_ROWS = 512
PIECES = "deal long, doc_id long, piece int, size int, text string"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing; ``sizes`` are in the order to be packed in.  Bins of indexes."""
    bins: list[list[int]] = []
    open_: dict[int, list[int]] = {}  # by room left
    rooms: list[int] = []  # the keys of open_, sorted
    for i, s in enumerate(sizes):
        at = bisect.bisect_left(rooms, s)
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
        bins[b].append(i)
        room -= s
        if room:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append(b)
    return bins


class _Search:
    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = [sorted(b, key=lambda i: sizes[i]) for b in bins]
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.steps = 0

    def _add(self, b: int, i: int) -> None:
        bisect.insort(self.bins[b], i, key=lambda j: self.sizes[j])
        self.fill[b] += self.sizes[i]

    def _take(self, b: int, i: int) -> None:
        self.bins[b].remove(i)
        self.fill[b] -= self.sizes[i]

    def _improve(self, source: int, others: list[int]) -> bool:
        """One step that takes from ``source`` and adds to a fuller bin; whether there was one."""
        best = self._best(source, others, [(i,) for i in self.bins[source]], True)
        if best is None:
            mine = self.bins[source]
            best = self._best(source, others, [(mine[x], mine[y]) for x in range(len(mine)) for y in range(x)], False)
        if best is None:
            return False
        _, go, target, come = best
        for i in go:
            self._take(source, i)
        for i in come:
            self._take(target, i)
            self._add(source, i)
        for i in go:
            self._add(target, i)
        self.steps += 1
        return True

    def _best(self, source: int, others: list[int], offers: list[tuple], moves: bool):
        """(growth of the target's fill, what goes, target, what comes back) of the step that fills a bin most."""
        sizes, best = self.sizes, None
        total = [(sum(sizes[i] for i in go), go) for go in offers]
        for target in others:
            room = self.capacity - self.fill[target]
            if not room or self.fill[target] < self.fill[source]:
                continue
            theirs = None
            for s, go in total:
                if moves and s <= room:
                    if best is None or s > best[0]:
                        best = (s, go, target, ())
                elif best is None or min(s - 1, room) > best[0]:
                    theirs = theirs or [sizes[j] for j in self.bins[target]]
                    at = bisect.bisect_left(theirs, s - room)  # the smallest that makes enough room
                    if at < len(theirs) and theirs[at] < s and (best is None or s - theirs[at] > best[0]):
                        best = (s - theirs[at], go, target, (self.bins[target][at],))
            if best and best[0] == room:
                break
        return best

    def run(self) -> list[list[int]]:
        """Rounds over the bins that aren't full, from the emptiest on, until a round finds no step; bins that are emptied are gone."""
        while True:
            before = self.steps
            loose = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity), key=lambda b: (self.fill[b], b))
            for k, source in enumerate(loose):
                while self.bins[source] and self._improve(source, [b for b in loose[:k:-1] if self.fill[b]]):
                    pass
            if self.steps == before:
                return [b for b in self.bins if b]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into ``sizes``, which are sorted from large to small and at most ``capacity``."""
    return _Search(sizes, best_fit(sizes, capacity), capacity).run()


def _mixed(*parts: int) -> int:
    h = 0
    for x in parts:
        h = (h ^ x) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        h ^= h >> 29
    return h >> 1


def _cut(capacity: int):
    def run(batches):
        """The pieces of each text; a piece's text goes up to the next piece."""
        seen: dict[int | None, int] = {}
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                rows = []
                for i, text in zip(batch.column(0).slice(at, _ROWS).to_pylist(), batch.column(1).slice(at, _ROWS)):
                    data = text.as_buffer() if text.is_valid else b""
                    n, starts = unit_starts(np.frombuffer(data, np.uint8), capacity) if len(data) else (0, [])
                    if not n:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    turn = seen[i] = seen.get(i, -1) + 1
                    for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)])):
                        rows.append((_mixed(i or 0, i is None, p, turn), i, p, min(capacity, n - p * capacity), data[a:b].to_pybytes().decode()))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["deal", "doc_id", "piece", "size", "text"])

    return run


def _pack_groups(capacity: int):
    names = ["bin_group", "bin", "doc_id", "piece", "n_tokens", "text"]

    def emit(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        group, size = held[0].column(0)[0].as_py(), t.column(3).to_pylist()
        bins = pack(size, capacity)
        order = pa.array([i for b in bins for i in b], pa.int64())
        number = pa.array([k for k, b in enumerate(bins) for _ in b], pa.int32())
        for at in range(0, len(order), _ROWS):
            own = t.take(order.slice(at, _ROWS)).combine_chunks()
            part = number.slice(at, _ROWS)
            cols = [pa.array([group] * len(own), pa.int64()), part, *(own.column(k).combine_chunks() for k in (1, 2, 3, 4))]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names)

    def run(batches):
        """The input is sorted by group, then from large to small."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != g[a]:
                    yield from emit(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from emit(held)

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """(bin_group, bin, doc_id, piece, n_tokens, text): piece p of a document is its words from p * capacity on; a window is the pieces of one (bin_group, bin)."""
    pieces = keyed(docs).mapInArrow(_cut(capacity), PIECES)
    groups = max(1, -(-pieces.count() // group_size))
    dealt = pieces.select(F.pmod("deal", F.lit(groups)).alias("g"), "doc_id", "piece", "size", "text")
    # a partition for each group, by its number: a hash of few numbers deals several to one task, and adaptive execution mustn't join them
    ordered = dealt.repartitionById(min(groups, PARTITIONS), F.col("g").cast("int")).sortWithinPartitions("g", F.desc("size"), "doc_id", "piece")
    return ordered.mapInArrow(_pack_groups(capacity), "bin_group long, bin int, doc_id long, piece int, n_tokens int, text string")
