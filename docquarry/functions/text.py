"""Text functions: folding, terms, words, trigrams, sparse n-grams, hashes, signatures.

All but the n-gram, diff and keyed-digest functions are plain column expressions.
"""

from __future__ import annotations

import hashlib
import hmac
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_WORD = 2
SHORTEST, LONGEST = 3, 16
#: Rows of an Arrow batch that is made of parts of texts.
ROWS = 1 << 18
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def fold(text: Column, unicode: bool = False) -> Column:
    """Lower case, of A to Z only unless ``unicode``."""
    return F.lower(text) if unicode else F.translate(text, UPPER, LOWER)


def fold_str(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def contains_folded(text: Column, needle: str, unicode: bool = False) -> Column:
    """Substring test whatever the case; the empty needle is in every text that isn't null."""
    return F.coalesce(F.contains(fold(text, unicode), F.lit(needle.lower() if unicode else fold_str(needle))), F.lit(False))


def terms(query: str) -> list[str]:
    """The terms between spaces."""
    return [t for t in query.split(" ") if t]


def contains_all_terms(text: Column, query: str) -> Column:
    found = [contains_folded(text, t) for t in terms(query)]
    return reduce(lambda a, b: a & b, found) if found else F.lit(False)


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, in order."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1))


def lines(text: Column) -> Column:
    """The lines; a final line break is followed by an empty line."""
    return F.split(text, "\n", -1)


def trigrams_of(text: str) -> list[str]:
    """Distinct three-character substrings of the folded text, sorted."""
    t = fold_str(text)
    return sorted({t[i : i + 3] for i in range(len(t) - 2)})


def rows_of(parts: Callable[[str], Sequence[str]], name: str):
    """For ``mapInArrow`` over (text, key): a row (``name``, key) for each part of each text, none for null.

    A batch of texts has no bound on its parts, so they go on in batches of ``ROWS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(0), batch.column(1)
            at: list[int] = []
            found: list[pa.Array] = []
            n = 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.concat_arrays(found), keys.take(pa.array(np.repeat(at, [len(f) for f in found])))], [name, batch.schema.names[1]])

            for i in range(len(texts)):  # one string at a time, not the batch's
                if not texts[i].is_valid:
                    continue
                own = parts(texts[i].as_py())
                for k in range(0, len(own), ROWS):
                    at.append(i)
                    found.append(pa.array(own[k : k + ROWS], pa.string()))
                    n += len(found[-1])
                    if n >= ROWS:
                        yield made()
                        at, found, n = [], [], 0
            if found:
                yield made()

    return run


def trigrams(text: str) -> np.ndarray:
    """``trigrams_of`` with the three code points of each place in one number."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, "<U3")
    if not c.all():  # numpy's strings end at a NUL
        return np.array(trigrams_of(text), object)
    c = np.where((c >= 65) & (c <= 90), c + np.uint64(32), c)
    code = np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])
    low = np.uint64((1 << 21) - 1)
    return np.ascontiguousarray(np.stack([code >> np.uint64(42), code >> np.uint64(21) & low, code & low], 1).astype("<u4")).view("<U3").ravel()


def pair_weight(a: str, b: str) -> int:
    """A fixed pseudo-random weight of two neighbouring characters."""
    return zlib.crc32(f"{a}{b}".encode())


def _weights(text: str) -> np.ndarray:
    """``pair_weight`` of all neighbouring characters; those of ASCII come from a table."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    a, b = c[:-1], c[1:]
    plain = (a | b) < 128
    out = _ascii_weights()[np.where(plain, a << 7 | b, 0)]
    pairs, at = np.unique((a << 21 | b)[~plain], return_inverse=True)
    out[~plain] = np.array([pair_weight(chr(p >> 21), chr(p & (1 << 21) - 1)) for p in pairs.tolist()], np.uint32)[at]
    return out


@cache
def _ascii_weights() -> np.ndarray:
    return np.array([pair_weight(chr(p >> 7), chr(p & 127)) for p in range(1 << 14)], np.uint32)


def _borders(text: str) -> list[int]:
    """Places that are strict local maxima of the pair weights; a place's two neighbours decide, so it is the same wherever the text stands."""
    if len(text) < 4:
        return []
    w = _weights(text)
    return (np.flatnonzero((w[:-2] < w[1:-1]) & (w[1:-1] > w[2:])) + 1).tolist()


def sparse_ngrams_of(text: str) -> list[str]:
    """Substrings between neighbouring borders, overlapping by the border's pair; longer ones are cut into pieces of 16."""
    t = fold_str(text)
    at, out = _borders(t), set()
    for a, b in zip(at, at[1:]):
        span = t[a : b + 2]
        if len(span) <= LONGEST:
            out.add(span)
            continue
        out.update(span[i : i + LONGEST] for i in range(0, max(1, len(span) - SHORTEST + 1), LONGEST))
    return sorted(s for s in out if len(s) >= SHORTEST)


def covering_ngrams_of(query: str) -> list[str]:
    """All substrings of 3 to 16 characters of the folded query."""
    t = fold_str(query)
    return sorted({t[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(t) - n + 1)})


def _symbol(code: int) -> str:
    c = chr(code)
    if c.isdigit() or c in LOWER:
        return c
    return LOWER[code - 65] if c in UPPER else "_" if c == "_" else "."


#: The reduced alphabet: letters whatever their case, digits, underscore, all other ASCII as one symbol.
ASCII = "".join(map(chr, range(128)))
REDUCED = "".join(map(_symbol, range(128)))


def reduced(text: Column) -> Column:
    """The text in the reduced alphabet; equal texts stay equal, so candidates found in it are a superset."""
    return F.translate(F.regexp_replace(text, r"[^\x00-\x7f]", "."), ASCII, REDUCED)


def _fnv_halves(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes as struct (hi, lo) of 32 bits each.

    The prime is 2**40 + 435, so a product modulo 2**64 is made of sums and shifts of
    halves that never leave 63 bits: plain bigint arithmetic, no decimals.
    """
    digits = F.hex(F.encode(text, "utf-8"))
    n = (F.length(digits) / 2).cast("int")
    codes = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    codes = F.when(n > 0, codes).otherwise(F.array().cast("array<bigint>"))
    low32 = F.lit((1 << 32) - 1)

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        product = lo * (FNV_PRIME & 0xFFFF)
        hi = (h["hi"] * (FNV_PRIME & 0xFFFF) + F.shiftleft(lo, FNV_PRIME.bit_length() - 33) + F.shiftright(product, 32)).bitwiseAND(low32)
        return F.struct(hi.alias("hi"), product.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("bigint").alias("hi"), F.lit(FNV_OFFSET & 0xFFFFFFFF).cast("bigint").alias("lo"))
    return F.aggregate(codes, start, step)


def fnv1a64(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as an unsigned decimal."""
    return F.aggregate(F.array(_fnv_halves(text)), F.lit(0).cast("decimal(38,0)"), lambda _, h: (h["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + h["lo"].cast("decimal(10,0)")).cast("decimal(38,0)")).cast("decimal(20,0)")


def fnv1a64_mod(text: Column, n: int) -> Column:
    """FNV-1a modulo ``n``, which is under 2**30."""
    if not 0 < n < 1 << 30:
        raise ValueError("1 to 2**30 - 1 partitions")
    return F.aggregate(F.array(_fnv_halves(text)), F.lit(0).cast("bigint"), lambda _, h: (h["hi"] % n * ((1 << 32) % n) + h["lo"]) % n).cast("int")


def fnv1a64_int(text: str) -> int:
    h = FNV_OFFSET
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def sha512_hex(text: Column) -> Column:
    return F.sha2(text, 512)


def crc32_of(text: Column) -> Column:
    return F.crc32(text)


def hex_of(data: Column) -> Column:
    return F.lower(F.hex(data))


def hmac_sha256_hex(secret: str):
    """A column function: the keyed digest in hexadecimal digits."""

    @F.arrow_udf(StringType())
    def signed(texts: pa.Array) -> pa.Array:
        key = secret.encode()
        return pa.array([None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts.to_pylist()], pa.string())

    return signed


def hmac_sha256_native(text: Column, secret: str) -> Column:
    """The same from nested digests, without Python."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(text, "utf-8")), 256))), 256)


def url_decode(text: Column) -> Column:
    return F.url_decode(text)


def count_byte_pairs(batches):
    """Counts of neighbouring bytes within a text, for a task: 65,536 rows at most, however many texts."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        texts = batch.column(0).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        for at in range(int(ends[0]), int(ends[-1]), 1 << 22):
            part = data[at : min(at + (1 << 22) + 1, int(ends[-1]))].astype(np.int64)
            codes = part[:-1] << 8 | part[1:]
            keep = np.ones(len(codes), bool)
            cut = ends[1:-1] - 1 - at  # pairs across two texts
            keep[cut[(cut >= 0) & (cut < len(codes))]] = False
            total += np.bincount(codes[keep], minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])
