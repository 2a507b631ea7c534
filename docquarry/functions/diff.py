"""Line differences, greedy with a short look-ahead, as an Arrow function of two texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

AHEAD = 5
_KIND = ArrayType(StructType([StructField("tag", StringType()), StructField("line", IntegerType()), StructField("text", StringType())]))
_ARROW = pa.list_(pa.struct([("tag", pa.string()), ("line", pa.int32()), ("text", pa.string())]))


def diff_lines(old: str, new: str) -> list[tuple[str, int, str]]:
    """(tag, line number from 1, text): same and added lines by their place in the new text, removed ones in the old."""
    a, b = old.split("\n"), new.split("\n")
    i = j = 0
    out: list[tuple[str, int, str]] = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(("same", j + 1, b[j]))
            i, j = i + 1, j + 1
            continue
        down = next((k for k in range(1, AHEAD + 1) if j + k < len(b) and b[j + k] == a[i]), None)
        right = next((k for k in range(1, AHEAD + 1) if i + k < len(a) and a[i + k] == b[j]), None)
        if down is not None and (right is None or down <= right):
            out += [("added", j + k + 1, b[j + k]) for k in range(down)]
            j += down
        elif right is not None:
            out += [("removed", i + k + 1, a[i + k]) for k in range(right)]
            i += right
        else:
            out += [("removed", i + 1, a[i]), ("added", j + 1, b[j])]
            i, j = i + 1, j + 1
    out += [("removed", k + 1, a[k]) for k in range(i, len(a))]
    out += [("added", k + 1, b[k]) for k in range(j, len(b))]
    return out


@F.arrow_udf(_KIND)
def line_diff(old: pa.Array, new: pa.Array) -> pa.Array:
    pairs = zip(old.to_pylist(), new.to_pylist())
    return pa.array([[dict(zip(("tag", "line", "text"), r)) for r in diff_lines(x or "", y or "")] for x, y in pairs], _ARROW)
