"""Byte-pair encoding by backtracking, and decoding by an offset table.

A piece of text (the pattern's pre-token) is encoded from left to right with the
longest token that begins there, found with an Aho-Corasick automaton's trie; a
token is taken if the table of compatible pairs says that merging by rank would
leave it beside the one before, else the next shorter prefix is tried, and when
none is left the last token is given back.  Every position is given up at most
once, so the work is linear in the piece, and the result is exactly that of the
merges in rank order.  Decoding looks up each token's bytes in one buffer by an
array of offsets, for a whole batch at once.

The vocabulary's path is a parameter; the driver reads it and sends it along.

Defined cases: a null text has null tokens, an empty one none; a null id is
carried; rows that repeat are encoded each; texts may be of any length; strings
that look like special tokens are ordinary text; an empty table gives an empty
result.  Other columns aren't read.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import keyed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 750_000
_LONG = 64
#: Rows, and about so many bytes of text, that are encoded at once.
ROWS, BYTES = 2048, 1 << 22
#: A space that doesn't just go before a word: the text isn't cut at its spaces then.
_ODD = r"^$|[ ][\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ ]\z"


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        ranks = [line.split() for line in f if line.strip()]
    out = [b""] * len(ranks)
    for token, rank in ranks:
        out[int(rank)] = base64.b64decode(token)
    return out


class Encoder:
    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.longest = max(self.length)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in tokens]  # longest proper prefix that is a token, or -1
        self.split: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        self.good: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(tokens):
            a = self.shorter[i]
            while a >= 0:
                b = self.ids.get(t[self.length[a] :], i)
                if a < i and b < i and self._compatible(a, b):
                    self.merged[a, b] = i
                    self.split.append((a, b))
                    break
                a = self.shorter[a]
            else:
                self.split.append((i, i))
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ids.get(token[:n])) is not None:
                return i
        return -1

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves a and b side by side: undo the later merge of the two until they meet or can't be split."""
        limit = len(self.tokens)
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            left, right = self.split[a][1], self.split[b][0]
            if a > b and left != a or right == b:
                if left == a:
                    return True
                limit, a = a, left
            else:
                limit, b = b + 1, right

    def _longest_everywhere(self, piece: str) -> list[int]:
        best = [-1] * len(piece)
        length = self.length
        for end, token in self.automaton.iter(piece):
            start = end - length[token] + 1
            if best[start] < 0 or length[token] > length[best[start]]:
                best[start] = token
        return best

    def _fit(self, a: int, b: int) -> bool:
        fits = self.good.get((a, b))
        if fits is None:
            if len(self.good) > CACHE:
                self.good.clear()
            fits = self.good[a, b] = self._compatible(a, b)
        return fits

    def _greedy(self, text: str) -> list[int] | None:
        """The longest matches one after the other, if all neighbours are compatible: there is one such list, the one of the merges."""
        out = [token for _, token in self.automaton.iter_long(text)]
        good, last, length = self.good, -1, 0
        for token in out:
            length += self.length[token]
            if last >= 0:
                fits = good.get((last, token))
                if not (self._fit(last, token) if fits is None else fits):
                    return None
            last = token
        return out if length == len(text) else None

    def encode_piece(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ids, length, shorter, good, n = self.ids, self.length, self.shorter, self.good, len(data)
        if data in ids:
            return [ids[data]]
        text = data.decode("latin-1")
        if (quick := self._greedy(text)) is not None:
            return quick
        everywhere = self._longest_everywhere(text) if n > _LONG else None
        longest_prefix = self.automaton.longest_prefix

        def match(at: int) -> int:
            if everywhere is not None:
                return everywhere[at]
            size = longest_prefix(text[at : at + self.longest])
            while data[at : at + size] not in ids:
                size -= 1
            return ids[data[at : at + size]]

        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, match(0)
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if open_[end]:
                    if last < 0:
                        break
                    fits = good.get((last, token))
                    if self._fit(last, token) if fits is None else fits:
                        break
                token = shorter[token]
                if token < 0:
                    break
            if token >= 0:
                out.append(token)
                at = end
                if at < n:
                    token = match(at)
            else:  # give the last one back and shorten it
                open_[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            found = array("i", self.encode_piece(piece.encode())).tobytes()
            if len(piece) <= _LONG:
                self.pieces[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Token ids as the bytes of 32-bit integers."""
        pieces = self.pattern.findall(text)
        if len(pieces) == 1:  # kept by the caller, if at all
            return array("i", self.encode_piece(text.encode())).tobytes()
        return b"".join(map(self._piece, pieces))

    def _spaced(self, word: str) -> bytes:
        ids = self.chunks.get(word)
        if ids is None:
            ids = self.encode(" " + word)
            if len(word) <= _LONG:
                if len(self.chunks) > CACHE:
                    self.chunks.clear()
                self.chunks[word] = ids
        return ids

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, their number for each text) of texts without nulls.

        A pre-token begins at every single space before something that isn't white
        space.  Where all spaces of a text are such it is cut at them; each distinct
        word of all these texts is encoded once, and the ids are put together by an
        index, without a step of Python for each word.
        """
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        sizes = np.zeros(len(texts), np.int64)
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        ends = np.asarray(lists.offsets).astype(np.int64)
        ends -= ends[0]
        words = lists.flatten().dictionary_encode()
        code, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        head = code[ends[:-1]]  # the first word of a text has no space before it
        heads, code_of_head = np.unique(head, return_inverse=True)
        code[ends[:-1]] = len(distinct) + code_of_head
        used = np.zeros(len(distinct) + len(heads), bool)
        used[code] = True
        parts = [self._spaced(w) if u else b"" for w, u in zip(distinct, used.tolist())] + [self.encode(distinct[h]) for h in heads.tolist()]
        known, size = np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts], np.int64)
        start = np.cumsum(size) - size
        own = size[code]
        last = np.cumsum(own)
        flat = known[np.repeat(start[code] - (last - own), own) + np.arange(last[-1] if len(last) else 0)]
        total = np.r_[0, last][ends]
        sizes[plain] = np.diff(total)
        if not len(rest):
            return flat, sizes
        others = [np.frombuffer(self.encode(t), np.int32) for t in texts.take(pa.array(rest)).to_pylist()]
        sizes[rest] = [len(x) for x in others]
        stop = np.cumsum(sizes)
        out = np.empty(stop[-1], np.int32)
        out[np.repeat((stop - sizes)[plain] - total[:-1], sizes[plain]) + np.arange(len(flat))] = flat
        for r, ids in zip(rest.tolist(), others):
            out[stop[r] - len(ids) : stop[r]] = ids
        return out, sizes


class Decoder:
    def __init__(self, tokens: list[bytes]):
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.cumsum([0, *map(len, tokens)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all lists of ids, and where each list's begin; the lists lie between neighbouring offsets."""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.buffer[at], np.r_[0, ends][offsets]


_ready: dict[int, tuple[Encoder, Decoder]] = {}


def _tools(tokens: list[bytes]) -> tuple[Encoder, Decoder]:
    key = hash(tuple(tokens))
    if key not in _ready:
        _ready.clear()
        _ready[key] = Encoder(tokens), Decoder(tokens)
    return _ready[key]


def _parts(batch: pa.RecordBatch):
    """At most ROWS rows and, but for a single longer text, BYTES of text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
        stop = min(max(stop, at + 1), at + ROWS)
        yield batch.slice(at, stop - at)
        at = stop


def _coder(shared, check: bool):
    def run(batches):
        encoder, decoder = _tools(shared.value)
        for whole in batches:
            for batch in _parts(whole):
                valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
                texts = batch.column(1).fill_null("")
                flat, sizes = encoder.encode_all(texts)
                offsets = np.r_[0, np.cumsum(sizes)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.r_[~valid, False]), pa.array(flat))
                cols = [batch.column(0), pa.array(sizes.astype(np.int32), mask=~valid), lists]
                if check:
                    data, starts = decoder.decode(flat, offsets)
                    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
                    given = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
                    same = np.ones(len(texts), bool)
                    if not (np.array_equal(starts, at - at[0]) and np.array_equal(data, given)):
                        same = np.array([data[a:b].tobytes() == given[c:d].tobytes() for a, b, c, d in zip(starts[:-1], starts[1:], at[:-1] - at[0], at[1:] - at[0])])
                    cols.append(pa.array(same, mask=~valid))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "tokens", "round_trip"][: len(cols)])

    return run


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip); round_trip, with ``check``: decoding the tokens gives the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # of a fixed size
    return keyed(docs).mapInArrow(_coder(shared, check), "doc_id long, n_tokens int, tokens array<int>" + ", round_trip boolean" * check)


def _decoder(shared):
    def run(batches):
        decoder = _tools(shared.value)[1]
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()])
            data, starts = decoder.decode(flat, np.r_[0, np.cumsum(sizes)])
            valid = lists.is_valid().to_pylist()
            texts = [data[a:b].tobytes().decode("utf-8", "replace") if v else None for v, a, b in zip(valid, starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_documents(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens)."""
    shared = coded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    return coded.select("doc_id", coded["tokens"].cast("array<int>").alias("tokens")).mapInArrow(_decoder(shared), "doc_id long, text string")
