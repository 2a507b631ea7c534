"""Semantic versions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION = r"^(\d+)\.(\d+)(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?$"


def parse(version: Column) -> Column:
    """Struct (major, minor, patch, pre), null if it isn't a version; the patch may be left out."""
    part = lambda i: F.regexp_extract(version, _VERSION, i)
    number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    return F.when(version.rlike(_VERSION), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), part(4).alias("pre")))


def order_key(version: Column) -> Column:
    """A struct that sorts as versions do: a release comes after its pre-releases, those go by their text."""
    v = parse(version)
    return F.when(v.isNotNull(), F.struct(v["major"], v["minor"], v["patch"], (v["pre"] == "").alias("release"), v["pre"]))


def _simple(version: Column, constraint: str) -> Column:
    m = re.fullmatch(r"\s*(=|>=|<=|>|<|\^|~)?\s*(\d+)\.(\d+)(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?\s*", constraint)
    if not m:
        raise ValueError(f"not a version constraint: {constraint!r}")
    op, (major, minor, patch), pre = m[1] or "^", (int(m[i] or 0) for i in (2, 3, 4)), m[5] or ""
    bound = lambda a, b, c, p="": F.struct(F.lit(a), F.lit(b), F.lit(c), F.lit(p == ""), F.lit(p))
    own, base = order_key(version), bound(major, minor, patch, pre)
    if op == "^":
        v = parse(version)
        same = v["major"] == major
        if not major:
            same = same & (v["minor"] == minor)
            if not minor:
                same = same & (v["patch"] == patch)
        return same & (own >= base)
    if op == "~":
        v = parse(version)
        return (v["major"] == major) & (v["minor"] == minor) & (own >= base)
    return {"=": own == base, ">": own > base, ">=": own >= base, "<": own < base, "<=": own <= base}[op]


def satisfies(version: Column, constraint: str) -> Column:
    """Whether a version meets all comma-separated constraints; a bare one is a caret."""
    out = F.lit(True)
    for c in constraint.split(","):
        out = out & _simple(version, c)
    return F.coalesce(out, F.lit(False))
