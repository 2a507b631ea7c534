"""Secret scans: keywords by Aho-Corasick, anchored patterns at the hits, checksums.

One automaton over all rules' keywords runs through the texts' bytes (ASCII letters
in lower case); a rule's pattern is tried only where one of its keywords begins, and
must match from there.  Where a kind of secret carries its own check it is computed:
the CRC-32 at the end of GitHub and npm tokens, the JSON header of a web token.  A
match that fails its check isn't reported.  The other kinds carry none (their letters
and lengths are all there is to test).  A secret may be of any length; a private key
is reported up to its END line, or its BEGIN line alone where there is no other.

Defined cases: null and empty texts have no secrets; a null id is carried; rows that
repeat report theirs as often as they come; matches of one rule don't overlap, the
leftmost counts; two rules may report the same place; texts may be of any length; an
empty table gives an empty result.  Other columns aren't read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PIECE, keyed

_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    """The six base-62 digits of the CRC-32."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _62[d] + out
    return out.encode()


def _crc(match: bytes) -> bool:
    body = match.split(b"_", 1)[1]
    return base62_crc(body[:-6]) == body[-6:]


def _header(match: bytes) -> bool:
    head = match.split(b".", 1)[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(found, dict) and "alg" in found


_L, _R = rb"(?<![A-Za-z0-9])", rb"(?![A-Za-z0-9])"
#: Name, keywords in lower case, pattern that begins at a keyword, check of the whole match or None.
RULES = (
    ("aws_access_key", ("akia", "asia"), _L + rb"A(?:KI|SI)A[A-Z2-7]{16}" + _R, None),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _L + rb"gh[pousr]_[A-Za-z0-9]{36}" + _R, _crc),
    ("npm_token", ("npm_",), _L + rb"npm_[A-Za-z0-9]{36}" + _R, _crc),
    ("slack_token", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), _L + rb"xox[abprs]-[0-9A-Za-z-]{10,}" + _R, None),
    ("stripe_key", ("sk_live_", "rk_live_"), _L + rb"[sr]k_live_[0-9A-Za-z]{24,}" + _R, None),
    ("google_api_key", ("aiza",), _L + rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])", None),
    ("web_token", ("eyj",), _L + rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", _header),
    ("private_key", ("-----begin",), rb"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,.-]*?-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)?", None),
    ("assignment", ("api_key", "apikey", "access_key", "token", "secret", "password", "passwd"), _L + rb"""(?i:api_?key|access_key|token|secret|password|passwd)["']?[ \t]{0,4}[:=][ \t]{0,4}(?:"[^"\s]{8,}"|'[^'\s]{8,}'|[A-Za-z0-9+/_=.-]{16,})""", None),
)


@lru_cache(maxsize=1)
def _tools():
    automaton = ahocorasick.Automaton()
    words: dict[str, list[int]] = {}
    for r, (_, keywords, _, _) in enumerate(RULES):
        for w in keywords:
            words.setdefault(w, []).append(r)
    for w, rules in words.items():
        automaton.add_word(w, (len(w), rules))
    automaton.make_automaton()
    return automaton, [re.compile(p) for _, _, p, _ in RULES]


def find(data: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(rule, start, stop) of the secrets at these (place, rule) hits, in bytes."""
    patterns, end, out = _tools()[1], [0] * len(RULES), []
    for at, r in sorted(hits):
        if at < end[r]:
            continue
        m = patterns[r].match(data, at)
        if m:
            end[r] = m.end()
            check = RULES[r][3]
            if check is None or check(m.group()):
                out.append((r, at, m.end()))
    return out


def scan(texts: pa.Array):
    """(row, rule, start, stop) in characters."""
    automaton = _tools()[0]
    texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        base = int(offsets[row])
        piece = data[base : int(offsets[stop])].to_pybytes() if offsets[stop] > base else b""
        by_row: dict[int, list[tuple[int, int]]] = {}
        for last, (size, rules) in automaton.iter(piece.lower().decode("latin-1")) if piece else ():
            start = base + last - size + 1
            r = int(np.searchsorted(offsets, start, "right")) - 1
            if start + size <= offsets[r + 1]:  # not across two texts
                by_row.setdefault(r, []).extend((start - int(offsets[r]), rule) for rule in rules)
        for r in sorted(by_row):
            own = piece[int(offsets[r]) - base : int(offsets[r + 1]) - base]
            found = find(own, by_row[r])
            if found and not own.isascii():  # bytes to characters
                at = np.r_[0, np.cumsum(np.frombuffer(own, np.uint8) & 0xC0 != 0x80)]
                found = [(rule, int(at[a]), int(at[b])) for rule, a, b in found]
            for rule, a, b in found:
                yield r, rule, a, b
        row = stop


def _scanner(batches):
    for batch in batches:
        rows = list(scan(batch.column(1)))
        at, rule, start, stop = zip(*rows) if rows else ((), (), (), ())
        names, checked = [RULES[r][0] for r in rule], [RULES[r][3] is not None for r in rule]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(checked, pa.bool_())], ["doc_id", "rule", "start", "stop", "checked"])


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, start, stop, checked): every secret; start and stop count characters, checked: it passed a check of its own."""
    return keyed(docs).mapInArrow(_scanner, "doc_id long, rule string, start int, stop int, checked boolean")
