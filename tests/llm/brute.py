"""The operators of the pipeline once more, slowly and without Spark."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from docquarry.llm import linededup, minhash, packing
from docquarry.llm.common import hash_tokens

SPACE = " \t\n\v\f\r"


def words(text, punct=False):
    """Token by token, from the definition."""
    out, kind = [], None
    for c in text or "":
        k = 0 if c in SPACE else 1 if c.isascii() and (c.isalnum() or c == "_") or not c.isascii() else 2
        if k == 1 or k == 2 and punct:
            if k == kind:
                out[-1] += c
            else:
                out.append(c)
        kind = k
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in out]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def gone_lines(docs):
    """{(doc_id, line)}: of [(doc_id, text)] the lines that an earlier one matches."""
    lines = sorted({(d, n, tuple(words(x))) for d, t in docs if d is not None for n, x in enumerate((t or "").split("\n")) if len(words(x)) >= linededup.MIN_WORDS})
    bags, gone, firsts = {}, set(), {}
    for d, n, w in lines:
        if w in firsts:
            gone.add((d, n))
            continue
        bag = Counter(w)
        for size in range(len(w) - 3, len(w) + 4):
            for other, ob in bags.get(size, ()):
                most = linededup.bound(min(len(w), size))
                if most and sum((bag - ob).values()) <= most and sum((ob - bag).values()) <= most and edit_distance(w, other) <= most:
                    gone.add((d, n))
                    break
            if (d, n) in gone:
                break
        firsts[w] = (d, n)
        bags.setdefault(len(w), []).append((w, bag))
    return gone


def without_lines(docs):
    gone, out = gone_lines(docs), []
    for d, t in docs:
        if not any(g[0] == d for g in gone):
            out.append((d, t))
            continue
        parts = list(enumerate((t or "").split("\n")))
        left = [x for n, x in parts if (d, n) not in gone]
        if any(len(words(x)) >= linededup.MIN_WORDS for x in left):
            out.append((d, "\n".join(left)))
    return out


def signature(text):
    """ProbMinHash with every arrival looked at, no early end."""
    _, _, h, o = next(hash_tokens(pa.array([text])))
    _, element, weight = minhash.elements(h, o)
    m = minhash.COMPONENTS
    soonest, winner, time = np.full(m, math.inf), np.zeros(m, np.uint64), np.zeros(len(element))
    for turn in range(1, 100_000):
        r = minhash._mix(element + np.uint64(turn * int(minhash._A) & (1 << 64) - 1))
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / weight
        for e, t, at in zip(element, time, minhash._mix(r + minhash._B) % np.uint64(m)):
            if t < soonest[at]:
                soonest[at], winner[at] = t, e
        if time.min() >= soonest.max():
            break
    return (minhash._mix(winner) >> np.uint64(48)).astype(np.uint16)


def near_groups(docs):
    """{doc_id: least doc_id of its group}, from all pairs that share a band and agree enough."""
    texts = {}
    for d, t in docs:
        if d is not None and words(t):
            texts.setdefault(d, []).append(t)
    sigs = [(d, signature(t)) for d, ts in sorted(texts.items()) for t in set(ts)]
    root = {d: d for d, _ in sigs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    least = math.ceil(minhash.THRESHOLD * minhash.COMPONENTS)
    for i, (a, x) in enumerate(sigs):
        for b, y in sigs[:i]:
            same = x == y
            if same.sum() >= least and same.reshape(-1, minhash.ROWS).all(1).any():
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {d: find(d) for d in root}


def without_copies(docs):
    groups, seen, out = near_groups(docs), set(), []
    for d, t in docs:
        if d is None or (groups.get(d, d) == d and (d, t) not in seen):
            out.append((d, t))
        seen.add((d, t))
    return out


def packed(docs, capacity=packing.CAPACITY):
    """Rows of one group."""
    pieces = []
    for d, t in docs:
        n = len((t or "").split())
        pieces += [(min(capacity, n - p), d, k) for k, p in enumerate(range(0, n, capacity))]
    pieces.sort(key=lambda x: (-x[0], -math.inf if x[1] is None else x[1], x[2]))
    bins = packing.pack([s for s, _, _ in pieces], capacity)
    return sorted(((b, pieces[i][1], pieces[i][2], pieces[i][0]) for b, own in enumerate(bins) for i in own), key=lambda r: (r[0], r[1] is None, r[1:]))
