"""What a regular expression's matches must contain.

The parsed pattern is walked for literal runs that every match has; a choice gives a
set of alternatives if each branch has one.  Trigrams of the runs make a prefilter
that never loses a match; the pattern itself is tried on what remains.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_folded, fold_str

#: A requirement: at least one of these literals is in the text.
Requirement = frozenset[str]


def _walk(nodes) -> list[Requirement]:
    out: list[Requirement] = []
    run = ""

    def end() -> None:
        nonlocal run
        if len(run) >= 3:
            out.append(frozenset([run]))
        run = ""

    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg)
            continue
        if name == "SUBPATTERN":
            inner = arg[3]
            if all(str(o) == "LITERAL" and a < 128 for o, a in inner):
                run += "".join(chr(a) for _, a in inner)
                continue
            end()
            out += _walk(inner)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            end()
            if arg[0] >= 1:
                out += _walk(arg[2])
        elif name == "BRANCH":
            end()
            branches = [_walk(b) for b in arg[1]]
            if all(branches):
                # of each branch its longest requirement; one of the branches matches
                out.append(frozenset().union(*(max(b, key=lambda r: min(map(len, r))) for b in branches)))
        else:
            end()
    end()
    return out


def requirements(pattern: str) -> list[Requirement]:
    """Requirements that all hold for every text with a match; an empty list: no filter possible."""
    return _walk(_parser.parse(pattern))


def prefilter(text: Column, pattern: str) -> Column:
    """A condition that every text with a match passes, whatever the case of ASCII letters."""
    needed = [reduce(lambda a, b: a | b, [contains_folded(text, literal) for literal in sorted(r)]) for r in requirements(pattern)]
    return reduce(lambda a, b: a & b, needed, F.lit(True))


def trigram_plan(pattern: str) -> list[list[list[str]]]:
    """For each requirement its alternatives, each as the trigrams that it has."""
    split = lambda s: sorted({s[i : i + 3] for i in range(len(s) - 2)})
    return [[split(fold_str(x)) for x in sorted(r)] for r in requirements(pattern)]


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    re.compile(pattern)  # complains here rather than in a task
    return F.coalesce(prefilter(text, pattern) & text.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))
