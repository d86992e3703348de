"""Wildcard joins: which texts match which LIKE patterns.

All strategies narrow the pairs; what the search does not settle by itself is
left to Spark's LIKE:

exact      a pattern without wildcards is an equality: hash join
length     a pattern without literals is a bound on the number of code points
nested     broadcast patterns, look for the anchor literal, then LIKE
ngram      hash join of the texts' distinct q-grams with the first q-gram of
           the anchor, then LIKE; the pattern side is not broadcast
automaton  one pass over each text finds all anchors at once (Arrow batches)
           and settles lengths, whole texts and bare literals; LIKE decides
           the rest in the JVM; the distinct patterns go to the tasks

``auto`` measures the pattern side (one small job) and takes nested for few
patterns, automaton for many, and ngram where the pattern side is larger than
``MAX_BROADCAST`` bytes or there is no automaton library. The distinct patterns
are broadcast once, and a worker builds one automaton of them for all its
tasks; it keeps nothing from one text to the next. Null texts and null patterns
match nothing.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wildloom.plans.patterns import EXACT, LENGTH, LITERAL, prepare_patterns
from wildloom.session import c, columns_or_fail

try:
    import ahocorasick
except ImportError:  # the automaton strategy is then not offered
    ahocorasick = None

#: Pattern sides up to this many bytes are sent to every task.
MAX_BROADCAST = 64 * 1024 * 1024
#: From so many patterns on one pass over the text beats one search per pattern.
AUTOMATON_FROM = 48
GRAM = 4
FACTS = ("like_pattern", "like_kind", "like_anchor", "like_literals", "like_underscores", "like_min_len")


@dataclass(frozen=True)
class PatternSide:
    rows: int
    size: int


def measure(prepared: DataFrame) -> PatternSide:
    r = prepared.agg(F.count("like_pattern").alias("n"), F.coalesce(F.sum(F.octet_length("like_pattern") + 64), F.lit(0)).alias("b")).first()
    return PatternSide(r["n"], r["b"])


def choose(side: PatternSide) -> str:
    if side.size > MAX_BROADCAST:
        return "ngram"
    if side.rows < AUTOMATON_FROM:
        return "nested"
    return "automaton" if ahocorasick is not None else "ngram"


def _length_hit(text: Column) -> Column:
    n = F.char_length(text)
    return (n == F.col("like_min_len")) | ((n > F.col("like_min_len")) & F.contains("like_pattern", F.lit("%")))


def _pair_hit(text: Column) -> Column:
    """The decision for one pair, cheapest test first."""
    return (
        F.when(F.col("like_kind") == LENGTH, _length_hit(text))
        .when(F.col("like_kind") == EXACT, text == F.regexp_replace("like_pattern", r"(?s)\\(.)", "$1"))
        .otherwise(F.contains(text, F.col("like_anchor")) & F.expr("__text LIKE like_pattern"))
    )


class Search:
    """All patterns that a text may match, found in one pass over it.

    ``facts`` are tuples of FACTS; a pattern's index is its place. A pattern is
    settled by the search itself if it asks for a length, for the whole text,
    or only for its literal anywhere; of others the anchor is found.
    """

    def __init__(self, facts: list[tuple]):
        anchors: dict[str, tuple[list[int], list[int]]] = {}
        self.exact: dict[str, list[int]] = {}
        self.fixed: dict[int, list[int]] = {}
        least: list[tuple[int, int]] = []
        for i, f in enumerate(facts):
            p, kind, anchor, literals, underscores, min_len = f
            if kind == EXACT:
                self.exact.setdefault(re.sub(r"(?s)\\(.)", r"\1", p), []).append(i)
            elif kind == LENGTH and "%" in p:
                least.append((min_len, i))
            elif kind == LENGTH:
                self.fixed.setdefault(min_len, []).append(i)
            else:
                alone = literals == 1 and underscores == 0 and p[0] == "%" and re.sub(r"(?s)\\.", "", p).endswith("%")
                anchors.setdefault(anchor, ([], []))[0 if alone else 1].append(i)
        least.sort()
        self.starts, self.open_ids = [n for n, _ in least], [i for _, i in least]
        self.hits = list(anchors.values())
        self.patterns = [f[0] for f in facts]
        self.found = ahocorasick.Automaton() if anchors else None
        for k, a in enumerate(anchors):
            self.found.add_word(a, k)
        if anchors:
            self.found.make_automaton()

    def __call__(self, texts: pa.Array, names: bool) -> pa.Array:
        sure, maybe, s_ends, m_ends = [], [], [0], [0]
        exact, fixed, hits, found = self.exact, self.fixed, self.hits, self.found
        for t in texts.to_pylist():
            if t is not None:
                sure += exact.get(t, ())
                n = len(t)
                sure += fixed.get(n, ())
                sure += self.open_ids[: bisect_right(self.starts, n)]
                if found is not None:
                    for k in {k for _, k in found.iter(t)}:
                        sure += hits[k][0]
                        maybe += hits[k][1]
            s_ends.append(len(sure))
            m_ends.append(len(maybe))
        m_off = pa.array(m_ends, pa.int32())
        cols = [pa.ListArray.from_arrays(pa.array(s_ends, pa.int32()), pa.array(sure, pa.int32())), pa.ListArray.from_arrays(m_off, pa.array(maybe, pa.int32()))]
        if not names:
            return pa.StructArray.from_arrays(cols, names=["sure", "maybe_i"])
        cols.append(pa.ListArray.from_arrays(m_off, pa.array([self.patterns[i] for i in maybe], pa.string())))
        return pa.StructArray.from_arrays(cols, names=["sure", "maybe_i", "maybe_p"])


#: Searches that this worker has built, the last used ones; what they hold never changes.
_built: OrderedDict[str, Search] = OrderedDict()
KEEP_SEARCHES = 2


def search_for(name: str, facts: list[tuple]) -> Search:
    if name not in _built:
        while len(_built) >= KEEP_SEARCHES:
            _built.popitem(last=False)
        _built[name] = Search(facts)
    _built.move_to_end(name)
    return _built[name]


def searcher(spark: SparkSession, facts: list, names: bool):
    """Arrow-batched column function: indexes of the patterns a text matches.

    ``sure`` are settled, ``maybe_i`` have their anchor in the text and are
    left to LIKE; with ``names`` the patterns of the latter come too, as
    ``maybe_p``.
    """
    name = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast([tuple(f[x] for x in FACTS) for f in facts])
    kind = "struct<sure:array<int>,maybe_i:array<int>" + (",maybe_p:array<string>>" if names else ">")

    @F.arrow_udf(kind)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = search_for(name, sent.value)
        for texts in batches:
            yield search(texts, names)

    return find


def fact_rows(prepared: DataFrame) -> list:
    """The distinct live patterns, in a fixed order; their total size was measured before."""
    return prepared.where("like_pattern is not null").select(*FACTS).distinct().orderBy("like_pattern").collect()


def matched_indexes(texts: DataFrame, text: Column, search, out: str) -> DataFrame:
    """``texts`` with ``out``: indexes of the patterns that match, by a :func:`searcher` with names. Only the text goes to Python; LIKE verifies in the JVM."""
    found = texts.withColumn("__probe", text).withColumn("__f", search(F.col("__probe")))
    verified = "transform(filter(arrays_zip(__f.maybe_i, __f.maybe_p), m -> __probe LIKE m.maybe_p), m -> m.maybe_i)"
    return found.withColumn(out, F.expr(f"concat(__f.sure, {verified})")).drop("__f", "__probe")


def _indexed(prepared: DataFrame, facts: list) -> DataFrame:
    """``prepared`` with like_index, each pattern's place in ``facts``."""
    spark = prepared.sparkSession
    places = spark.createDataFrame([(f["like_pattern"], i) for i, f in enumerate(facts)], "like_pattern string, like_index int")
    return prepared.join(F.broadcast(places), "like_pattern")


def _matches(texts: DataFrame, text: str, prepared: DataFrame, strategy: str, fold: bool) -> DataFrame:
    """All (text row, pattern row) pairs; pattern columns as in ``prepared``."""
    base = texts.withColumn("__text", F.lower(c(text)) if fold else c(text)).where("__text is not null")
    live = prepared.where("like_pattern is not null")
    if strategy == "nested":
        return base.join(F.broadcast(live), _pair_hit(F.col("__text"))).drop("__text")
    if strategy == "automaton":
        # only indexes come back from the search; each finds its pattern in the JVM, where LIKE decides
        facts = fact_rows(live)
        found = base.withColumn("__f", searcher(base.sparkSession, facts, False)(F.col("__text")))
        tagged = F.concat(F.transform("__f.sure", lambda i: F.struct(i.alias("i"), F.lit(True).alias("sure"))), F.transform("__f.maybe_i", lambda i: F.struct(i.alias("i"), F.lit(False).alias("sure"))))
        pairs = found.withColumn("__hit", F.explode(tagged)).drop("__f")
        joined = pairs.join(F.broadcast(_indexed(live, facts)), F.col("__hit.i") == F.col("like_index"))
        return joined.where(F.col("__hit.sure") | F.expr("__text LIKE like_pattern")).drop("__hit", "like_index", "__text")
    if strategy != "ngram":
        raise ValueError(f"unknown strategy {strategy}")
    exact = live.where(F.col("like_kind") == EXACT).withColumn("__plain", F.regexp_replace("like_pattern", r"(?s)\\(.)", "$1"))
    by_equal = base.join(exact, F.col("__text") == F.col("__plain")).drop("__plain")
    lengths = live.where(F.col("like_kind") == LENGTH).withColumn("__open", F.contains("like_pattern", F.lit("%")))
    # distinct bounds are at most as many as the longest pattern is long
    spans = lengths.select(F.col("like_min_len").alias("__least"), "__open").distinct()
    n = F.char_length("__text")
    spanned = base.join(F.broadcast(spans), (n == F.col("__least")) | ((n > F.col("__least")) & F.col("__open")))
    by_length = spanned.join(lengths, (F.col("__least") == F.col("like_min_len")) & (spanned["__open"] == lengths["__open"]))
    lit = live.where(F.col("like_kind") == LITERAL).withColumn("__gram", F.left("like_anchor", F.lit(GRAM)))

    def grams(q: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.col("__text").substr(i, F.lit(q)))
        return F.when(n >= q, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    # anchors shorter than a gram are grams of their own length
    probe = base.withColumn("__gram", F.explode(F.flatten(F.array(*[grams(q) for q in range(1, GRAM + 1)]))))
    verify = F.contains("__text", F.col("like_anchor")) & F.expr("__text LIKE like_pattern")
    by_gram = probe.join(lit, "__gram").where(verify).drop("__gram")
    cols = by_equal.columns
    return by_equal.unionByName(by_length.select(cols)).unionByName(by_gram.select(cols)).drop("__text")


def wildcard_join(
    texts: DataFrame,
    patterns: DataFrame,
    text: str,
    pattern: str,
    how: str = "inner",
    escape: str | None = None,
    ignore_case: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """Join on ``text [I]LIKE pattern [ESCAPE escape]``.

    how: inner (all columns of both; a pattern column whose name the texts
    have too gets the prefix ``pattern_``), semi or anti (rows of ``texts``
    with or without a match; null texts have none). Repeated rows on either
    side each make their own pairs. A pattern that ends with its escape sign
    raises. Case is folded for all of Unicode.
    """
    columns_or_fail(texts, text)
    columns_or_fail(patterns, pattern)
    if how not in ("inner", "semi", "anti"):
        raise ValueError(f"how must be inner, semi or anti, not {how}")
    renamed = {x: ("pattern_" + x if x in texts.columns else x) for x in patterns.columns}
    right = patterns.select(*[c(x).alias(renamed[x]) for x in patterns.columns])
    prepared = prepare_patterns(right, renamed[pattern], escape, ignore_case)
    if strategy == "auto":
        strategy = choose(measure(prepared))
    if how == "inner":
        pairs = _matches(texts, text, prepared, strategy, ignore_case)
        return pairs.select(*[c(x) for x in texts.columns], *[c(x) for x in right.columns])
    facts = prepared.select(*FACTS).where("like_pattern is not null").distinct()
    kind = "left_semi" if how == "semi" else "left_anti"
    if strategy == "ngram":
        # large pattern sides: the distinct texts with a match, then an equality of texts
        hit = _matches(texts.select(c(text).alias("__hit_text")).distinct(), "__hit_text", facts, strategy, ignore_case).select("__hit_text").distinct()
        return texts.join(hit, c(text) == F.col("__hit_text"), kind)
    if strategy == "nested":
        # a semi join stops at the first match, so all routes are tried in one condition
        base = texts.withColumn("__text", F.lower(c(text)) if ignore_case else c(text))
        return base.join(F.broadcast(facts), _pair_hit(F.col("__text")), kind).drop("__text")
    if strategy != "automaton":
        raise ValueError(f"unknown strategy {strategy}")
    t = F.lower(c(text)) if ignore_case else c(text)
    marked = matched_indexes(texts, t, searcher(texts.sparkSession, fact_rows(prepared), True), "__m")
    any_hit = F.coalesce(F.size("__m") > 0, F.lit(False))
    return marked.where(any_hit if how == "semi" else ~any_hit).drop("__m")


def conjunctive_join(rows: DataFrame, texts: tuple[str, str], patterns: DataFrame, pattern: str, escape: str | None = None) -> DataFrame:
    """Join on ``first LIKE pattern AND second LIKE pattern`` for two text columns of one row.

    Each text is matched once against all patterns and the lists are
    intersected, so the pairs of one text never meet those of the other. Large
    pattern sides go through :func:`wildcard_join` with the second LIKE as a
    filter.
    """
    columns_or_fail(rows, *texts)
    columns_or_fail(patterns, pattern)
    renamed = {x: ("pattern_" + x if x in rows.columns else x) for x in patterns.columns}
    right = patterns.select(*[c(x).alias(renamed[x]) for x in patterns.columns])
    prepared = prepare_patterns(right, renamed[pattern], escape)
    out = [*[c(x) for x in rows.columns], *[c(x) for x in right.columns]]
    side = measure(prepared)
    base = rows.where(c(texts[0]).isNotNull() & c(texts[1]).isNotNull())
    if choose(side) != "automaton":
        first = _matches(base, texts[0], prepared, choose(side), False)
        return first.withColumn("__text", c(texts[1])).where(_pair_hit(F.col("__text"))).select(*out)
    facts = fact_rows(prepared)
    search = searcher(rows.sparkSession, facts, True)
    both = matched_indexes(matched_indexes(base, c(texts[0]), search, "__a"), c(texts[1]), search, "__b")
    hits = both.withColumn("__hit", F.explode(F.array_intersect("__a", "__b")))
    return hits.join(F.broadcast(_indexed(prepared, facts)), F.col("__hit") == F.col("like_index")).select(*out)


def first_match(
    texts: DataFrame,
    patterns: DataFrame,
    text: str,
    pattern: str,
    priority: str,
    label: str,
    out: str = "first_label",
    escape: str | None = None,
    ignore_case: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """``texts`` with the label of the matching pattern of least priority; null without a match.

    Equal priorities are resolved by the smaller label. The pattern side is
    folded to one (priority, label) per pattern text and measured: few patterns
    become one expression, many are searched for in one pass, and sides too
    large for that meet the distinct texts in a hash join. Each text row is
    kept as often as it comes; a null text has a null label.
    """
    columns_or_fail(texts, text)
    columns_or_fail(patterns, pattern, priority, label)
    side = patterns.select(c(pattern).alias("__p"), c(priority).alias("__prio"), c(label).alias("__label"))
    prepared = prepare_patterns(side, "__p", escape, ignore_case)
    if strategy == "auto":
        strategy = choose(measure(prepared))
    ranked = prepared.where("like_pattern is not null").groupBy(*FACTS).agg(F.min(F.struct("__prio", "__label")).alias("__best"))
    t = F.lower(c(text)) if ignore_case else c(text)
    keep = [c(x) for x in texts.columns if x.lower() != out.lower()]
    if strategy == "ngram":
        some = texts.select(t.alias("__key")).where("__key is not null").distinct()
        best = _matches(some, "__key", ranked, strategy, False).groupBy("__key").agg(F.min("__best").alias("__best"))
        return texts.withColumn("__t", t).join(best, F.col("__t") == F.col("__key"), "left").select(*keep, F.col("__best.__label").alias(out))
    rows = ranked.orderBy("__best", "like_pattern").collect()
    labels = [r["__best"]["__label"] for r in rows]
    if not rows:
        return texts.select(*keep, F.lit(None).cast("string").alias(out))
    if strategy == "automaton":
        # indexes are in order of priority, so the least one names the label
        found = matched_indexes(texts, t, searcher(texts.sparkSession, rows, True), "__m").withColumn("__least", F.array_min("__m"))
        places = texts.sparkSession.createDataFrame(list(enumerate(labels)), "__least int, __label string")
        return found.join(F.broadcast(places), "__least", "left").select(*keep, F.col("__label").alias(out))
    if strategy != "nested":
        raise ValueError(f"unknown strategy {strategy}")
    base = texts.withColumn("__text", t)
    expr = None
    for r, label in zip(rows, labels, strict=True):
        if r["like_kind"] == LENGTH:
            n = F.char_length("__text")
            hit = n >= r["like_min_len"] if "%" in r["like_pattern"] else n == r["like_min_len"]
        else:
            hit = F.contains("__text", F.lit(r["like_anchor"])) & F.col("__text").like(r["like_pattern"])
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return base.select(*keep, expr.alias(out))
