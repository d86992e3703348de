"""LIKE patterns as data: dialect, classification and routing facts.

The input dialect has no escape sign unless one is named. Spark's own LIKE
always has the backslash, so every pattern is rewritten once into that
dialect; Spark's LIKE then decides every match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wildloom.session import c, columns_or_fail

#: Private-use signs for the work on a pattern; where it has them itself they are set aside first.
PRIVATE = "\ue000\ue001\ue002\ue003\ue004"
EXACT, LENGTH, LITERAL = "exact", "length", "literal"


def spark_like(pattern: str, escape: str | None = None) -> str:
    """``pattern`` in Spark's dialect; raises ValueError where the escape sign ends it."""
    if escape is not None and len(escape) != 1:
        raise ValueError("escape must be one character")
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == escape:
            if i + 1 == len(pattern):
                raise ValueError(f"pattern ends with its escape sign: {pattern!r}")
            i += 1
            ch = pattern[i]
            out.append("\\" + ch if ch in "%_\\" else ch)
        else:
            out.append("\\\\" if ch == "\\" else ch)
        i += 1
    return "".join(out)


def spark_like_column(pattern: Column, escape: str | None = None) -> Column:
    """The same as a column expression; a malformed pattern raises when it is evaluated.

    Literal signs (escaped ones and bare backslashes) are first marked, then
    quoted where they would be special.
    """
    if escape is None:
        return F.replace(pattern, F.lit("\\"), F.lit("\\\\"))
    if len(escape) != 1:
        raise ValueError("escape must be one character")
    mark, aside, one, two = [x for x in PRIVATE if x != escape][:4]
    e = re.escape(escape)
    pair = f"(?s){e}(.)"
    bad = F.contains(F.regexp_replace(pattern, pair, ""), F.lit(escape))
    safe = F.replace(F.replace(pattern, F.lit(aside), F.lit(aside + two)), F.lit(mark), F.lit(aside + one))
    if escape == "\\":
        marked = F.regexp_replace(safe, pair, mark + "$1")
    else:
        marked = F.regexp_replace(safe, f"(?s){e}(.)|(\\\\)", mark + "$1$2")
    quoted = F.regexp_replace(marked, mark + r"([%_\\])", r"\\$1")
    clean = F.replace(quoted, F.lit(mark), F.lit(""))
    back = F.replace(F.replace(clean, F.lit(aside + one), F.lit(mark)), F.lit(aside + two), F.lit(aside))
    return F.when(bad, F.raise_error(F.concat(F.lit("pattern ends with its escape sign: "), pattern))).otherwise(back)


def literals(like: Column) -> Column:
    """The literal runs of a pattern in Spark's dialect, escapes removed, in order."""
    runs = F.regexp_extract_all(like, F.lit(r"([^%_\\]*+(?:\\.[^%_\\]*+)*+)"), 1)
    return F.transform(F.filter(runs, lambda r: F.length(r) > 0), lambda r: F.regexp_replace(r, r"(?s)\\(.)", "$1"))


def wildcards(like: Column) -> Column:
    """Only the wildcard signs of a pattern in Spark's dialect."""
    return F.regexp_replace(F.regexp_replace(like, r"(?s)\\.", ""), "[^%_]", "")


def segments(like: Column) -> Column:
    """The parts of a pattern between its runs of ``%``, escapes kept; the first and last are empty where it begins or ends with one."""
    parts = F.regexp_extract_all(F.concat(like, F.lit("%")), F.lit(r"((?:[^%\\]*+(?:\\.)?)*+)%+"), 1)
    open_end = F.regexp_replace(like, r"(?s)\\\\.", "").endswith("%")
    return F.when(open_end, F.concat(parts, F.array(F.lit("")))).otherwise(parts)


def skeleton(like: Column) -> Column:
    """Per segment: ``literals`` (in order, escapes removed) and ``gaps`` (how many ``_`` stand before each and at the end)."""

    def compile_(seg: Column) -> Column:
        masked = F.regexp_replace(seg, r"(?s)\\.", "x")
        counts = F.transform(F.split(masked, "[^_]+", -1), lambda g: F.length(g))
        return F.struct(literals(seg).alias("literals"), counts.alias("gaps"))

    return F.transform(segments(like), compile_)


def fold_wildcards(like: Column) -> Column:
    """An equal pattern in which every run of wildcards is first its ``_`` and then at most one ``%``."""
    pieces = F.regexp_extract_all(like, F.lit(r"([%_]+|(?:[^%_\\]|\\.)[^%_\\]*)"), 1)

    def fold(x: Column) -> Column:
        n = F.length(F.replace(x, F.lit("%"), F.lit("")))
        return F.when(x.rlike("^[%_]"), F.concat(F.repeat(F.lit("_"), n), F.when(F.contains(x, F.lit("%")), "%").otherwise(""))).otherwise(x)

    return F.when(like.isNotNull(), F.array_join(F.transform(pieces, fold), ""))


def prepare_patterns(patterns: DataFrame, column: str, escape: str | None = None, fold: bool = False) -> DataFrame:
    """``patterns`` with routing facts in added columns.

    like_pattern (Spark's dialect, lower case when ``fold``), like_kind
    (exact: no wildcard; length: no literal; literal), like_anchor (longest
    literal run, the first of equals), like_literals (how many runs),
    like_underscores and like_min_len (code points a match has at least).
    A null pattern has nulls in all of them and matches nothing.
    """
    columns_or_fail(patterns, column)
    like = spark_like_column(c(column), escape)
    df = patterns.withColumn("like_pattern", F.lower(like) if fold else like)
    df = df.withColumn("__runs", literals(F.col("like_pattern"))).withColumn("__wild", wildcards(F.col("like_pattern")))
    unders = F.length(F.replace("__wild", F.lit("%"), F.lit("")))
    longest = F.aggregate("__runs", F.lit(""), lambda a, r: F.when(F.length(r) > F.length(a), r).otherwise(a))
    total = F.aggregate("__runs", F.lit(0), lambda a, r: a + F.length(r))
    kind = F.when(F.col("like_pattern").isNull(), None).when(F.col("__wild") == "", EXACT).when(F.size("__runs") == 0, LENGTH).otherwise(LITERAL)
    return df.select(
        "*",
        kind.alias("like_kind"),
        longest.alias("like_anchor"),
        F.when(F.col("like_pattern").isNotNull(), F.size("__runs")).alias("like_literals"),
        unders.alias("like_underscores"),
        (total + unders).alias("like_min_len"),
    ).drop("__runs", "__wild")
