"""Shared pieces of the training-data operators.

``hash_tokens`` turns UTF-8 text into 64-bit token hashes without making one
Python object per token: byte classes come from a table, run boundaries from
one comparison, and every hash from a prefix sum of ``byte * BASE**position``
brought back to the start of its token with the inverse power.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, table  # noqa: F401  (the operators take them from here)

#: Base of the token hash; odd, so that it has an inverse modulo 2**64, and under 2**62, so that DuckDB's HUGEINT holds the products.
BASE = 0x1E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Text is worked on in pieces of about so many bytes, to bound memory.
PIECE = 1 << 18

SPACE, WORD, PUNCT, SINGLE = 0, 1, 2, 3
_CLASS = np.full(256, PUNCT, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[0x80:] = WORD
for _a, _b in ((48, 58), (65, 91), (97, 123), (95, 96)):
    _CLASS[_a:_b] = WORD
_WORDS = np.where(_CLASS == WORD, WORD, SPACE).astype(np.uint8)
_UNITS = np.where(_CLASS == SPACE, SPACE, WORD).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables:
        for name, base in (("pow", BASE), ("inv", pow(BASE, -1, 1 << 64))):
            out = np.ones(2 * PIECE + 1, np.uint64)
            out[1:] = base
            np.multiply.accumulate(out, out=out)
            _tables[name] = out
    return _tables["pow"], _tables["inv"]


def token_hash(token: str) -> int:
    """The hash of one token, the slow way: sum of lower-cased byte i times BASE**i, modulo 2**64."""
    h = 0
    for b in reversed(token.encode()):
        h = (h * BASE + (b + 32 if 65 <= b <= 90 else b)) & MASK
    return h


#: Scripts written without spaces between words; each of their characters is a token.
_UNSPACED = ("HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR", "BOPOMOFO", "YI SYLLABLE", "TIBETAN", "HENTAIGANA", "NUSHU", "TANGUT")


def _code_points() -> np.ndarray:
    """The class of every code point: letters, digits and marks, white space, the rest, characters of scripts without spaces."""
    if "class" not in _tables:
        out = np.full(0x110000, PUNCT, np.uint8)
        out[0xE0100:0xE01F0] = WORD  # variation marks
        for a, b, to in ((0x3400, 0x4DC0, SINGLE), (0x4E00, 0xA000, SINGLE), (0xF900, 0xFB00, SINGLE), (0x17000, 0x18D00, SINGLE), (0x20000, 0x33480, SINGLE), (0xAC00, 0xD7A4, WORD), (0xE000, 0xF900, WORD)):
            out[a:b] = to
        for c in (c for a, b in ((0x80, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xFB00, 0x17000), (0x18D00, 0x20000)) for c in range(a, b)):
            kind = unicodedata.category(ch := chr(c))
            if kind[0] in "LNM" or kind in ("Pc", "Cf", "Sk"):  # joiners stay within words
                out[c] = SINGLE if kind in ("Lo", "Lm") and c >= 0xE00 and unicodedata.name(ch, "").startswith(_UNSPACED) else WORD
            elif ch.isspace():
                out[c] = SPACE
        out[0x80:0xA0] = WORD
        out[[0x85, 0xA0, 0x200B, 0xFEFF]] = SPACE
        _tables["class"] = out
    return _tables["class"]


def _edges(buf: np.ndarray, starts: np.ndarray, punct: bool | None, unicode: bool) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte and the borders of the runs, first and last included; no run crosses one of ``starts``.

    ``punct`` None: whatever isn't white space is of one class.
    """
    n = len(buf)
    kind = (_UNITS if punct is None else _CLASS if punct else _WORDS)[buf]
    alone = None
    if unicode and n and buf.max() >= 0xC2:
        lead = np.flatnonzero(buf >= 0xC2)
        b = buf[lead].astype(np.int32)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        last = n - 1
        point = np.where(b < 0xE0, b & 0x1F, np.where(b < 0xF0, b & 0x0F, b & 0x07))
        for k in (1, 2, 3):
            point = np.where(size > k, point << 6 | buf[np.minimum(lead + k, last)] & 0x3F, point)
        cls = _code_points()[np.minimum(point, 0x10FFFF)]
        other = cls != WORD
        if other.any():
            lead, size, cls = lead[other], size[other], cls[other]
            alone = np.concatenate([lead[cls == SINGLE], (lead + size)[cls == SINGLE]])
            byte = np.where((cls == SINGLE) | (cls == PUNCT) & (punct is None), WORD, cls if punct else SPACE)
            for k in range(4):
                kind[(lead + k)[size > k]] = byte[size > k]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[starts] = True
    if alone is not None:
        change[alone] = True
    return kind, np.flatnonzero(change)


def _hash_runs(buf: np.ndarray, starts: np.ndarray, punct: bool, unicode: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the tokens of ``buf``; a token never crosses one of ``starts``."""
    kind, at = _edges(buf, starts, punct, unicode)
    first, last = at[:-1], at[1:]
    keep = kind[first] != SPACE
    first, last = first[keep], last[keep]
    return _spans(buf, first, last), first


def _spans(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    power, inverse = _powers()
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LOWER[buf] * power[: len(buf)], out=total[1:])
    return (total[last] - total[first]) * inverse[first]


def _long(buf: np.ndarray, punct: bool, unicode: bool) -> np.ndarray:
    """Hashes of one text of any length, cut between tokens."""
    out, at, n, none = [], 0, len(buf), np.zeros(1, np.int64)
    while at < n:
        size = PIECE
        while True:
            end = min(at + size, n)
            while end < n and buf[end] & 0xC0 == 0x80:  # within a character
                end -= 1
            kind, edges = _edges(buf[at:end], none, punct, unicode)
            if end == n or len(edges) > 2:
                break
            size *= 4
        if size > PIECE:  # a run of more than PIECE bytes comes first
            stop = int(edges[1])
            if kind[0] != SPACE:
                out.append(np.array([token_hash_bytes(buf[at : at + stop])], np.uint64))
        else:
            if end < n:  # the last run may go on
                edges = edges[:-1]
            stop = int(edges[-1])
            keep = kind[edges[:-1]] != SPACE
            out.append(_spans(buf[at : at + stop], edges[:-1][keep], edges[1:][keep]))
        at += stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def token_hash_bytes(buf: np.ndarray) -> int:
    """Hash of one token of any length, in pieces."""
    power, _ = _powers()
    h, shift = 0, 1
    for at in range(0, len(buf), PIECE):
        piece = _LOWER[buf[at : at + PIECE]]
        h = (h + shift * int(np.sum(piece * power[: len(piece)], dtype=np.uint64))) & MASK
        shift = shift * pow(BASE, len(piece), 1 << 64) & MASK
    return h


def hash_tokens(texts: pa.Array, punct: bool = False, unicode: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes, offsets into the hashes by row) over pieces of a string array.

    A null text has no tokens.  Word bytes are ASCII letters, digits, ``_`` and
    everything from 0x80; ASCII letters are lower-cased.  With ``punct`` a run of
    other bytes that aren't white space is a token too.  With ``unicode`` what isn't
    ASCII is told apart as well: white space and punctuation end a word, and a
    character of a script without spaces is a token of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        lo, hi = offsets[row], offsets[end]
        if hi - lo > 2 * PIECE:
            h = _long(data[lo:hi], punct, unicode)
            yield row, end, h, np.array([0, len(h)])
        elif hi == lo:
            yield row, end, np.empty(0, np.uint64), np.zeros(end - row + 1, np.int64)
        else:
            starts = offsets[row : end + 1] - lo
            h, first = _hash_runs(data[lo:hi], starts, punct, unicode)
            yield row, end, h, np.searchsorted(first, starts)
        row = end


def unit_starts(buf: np.ndarray, every: int) -> tuple[int, list[int]]:
    """How many units a text has, runs between white space or single characters of scripts without spaces, and the first bytes of units 0, every, 2 * every, ..."""
    n, at, count, out, size = len(buf), 0, 0, [], PIECE
    while at < n:
        end = min(at + size, n)
        while end < n and buf[end] & 0xC0 == 0x80:  # within a character
            end -= 1
        kind, edges = _edges(buf[at:end], np.zeros(1, np.int64), None, True)
        if end < n:
            if len(edges) == 2:  # one run so far
                size *= 4
                continue
            edges = edges[:-1]  # the last run may go on
        first = edges[:-1][kind[edges[:-1]] != SPACE] + at
        out += first[-count % every :: every].tolist()
        count += len(first)
        at, size = at + int(edges[-1]), PIECE
    return count, out


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ids_and_texts(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    return batch.column(0), batch.column(1)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id, as a long, and the text, under names of our own, whatever else the table has."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def unit_hash(*cols, seed: str = "") -> "F.Column":
    """A number in (0, 1) made from the columns' text; the same in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def token_hash_sql(token: str) -> str:
    """DuckDB: the hash of a lower-cased token as a HUGEINT."""
    return (
        f"list_reduce(list_prepend(0::HUGEINT, list_reverse([('0x' || substr(hex(encode({token})), 2 * i + 1, 2))::HUGEINT "
        f"for i in range((length(hex(encode({token}))) // 2)::BIGINT)])), "
        f"lambda h, b: (h * {BASE}::HUGEINT % 18446744073709551616::HUGEINT + b) % 18446744073709551616::HUGEINT)"
    )


def tokens_sql(text: str, punct: bool = False) -> str:
    """DuckDB: the list of lower-cased tokens of a text, nulls as empty."""
    word = r"0-9a-z_\x{80}-\x{10FFFF}"
    other = rf"|[^{word}\t\n\v\f\r ]+" if punct else ""
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{word}]+{other}')"
