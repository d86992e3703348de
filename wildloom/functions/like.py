"""LIKE with constant patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wildloom.plans.patterns import spark_like


def like(text: Column, pattern: str, escape: str | None = None, ignore_case: bool = False) -> Column:
    """``text [I]LIKE pattern [ESCAPE escape]``; null text gives null.

    Catalyst turns prefix, suffix, infix and exact patterns into string
    searches. Others are run as a regular expression per row, so their longest
    literal is looked for first where it has at least two characters.
    """
    p = spark_like(pattern, escape)
    runs = _literal_runs(p)
    anchor = max(runs, key=len, default="")
    if ignore_case:
        # ILIKE compares in lower case; letters beyond ASCII are left to it alone
        if len(anchor) > 1 and anchor.isascii() and "_" in p:
            return F.contains(F.lower(text), F.lit(anchor.lower())) & text.ilike(p)
        return text.ilike(p)
    if len(runs) > 1 and len(anchor) > 1:
        return F.contains(text, F.lit(anchor)) & text.like(p)
    return text.like(p)


def _literal_runs(p: str) -> list[str]:
    runs, run, i = [], [], 0
    while i < len(p):
        if p[i] == "\\":
            run.append(p[i + 1])
            i += 2
            continue
        if p[i] in "%_":
            runs.append("".join(run))
            run = []
        else:
            run.append(p[i])
        i += 1
    runs.append("".join(run))
    return [r for r in runs if r]


def any_like(text: Column, patterns: list[str], escape: str | None = None, ignore_case: bool = False) -> Column:
    """Whether any of the patterns matches; no pattern matches nothing."""
    return reduce(lambda a, b: a | b, [like(text, p, escape, ignore_case) for p in patterns], F.lit(False))


def first_case(text: Column, arms: list[tuple[str | list[str], str]], default: str | None = None, ignore_case: bool = False) -> Column:
    """Label of the first arm of which a pattern matches."""
    out = None
    for pats, label in arms:
        hit = any_like(text, [pats] if isinstance(pats, str) else pats, None, ignore_case)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def literal_positions(text: Column, literal: str) -> Column:
    """All 1-based code point positions at which ``literal`` begins in ``text``, overlaps included."""
    if not literal:
        raise ValueError("the literal is empty")
    n = F.char_length(text) - len(literal) + 1
    spots = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    at = F.filter(spots, lambda i: text.substr(i, F.lit(len(literal))) == literal)
    return F.when(F.contains(text, F.lit(literal)), at).when(text.isNotNull(), F.array().cast("array<int>"))
