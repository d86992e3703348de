"""All places of many literals in each text, found in one pass."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildloom.functions.like import literal_positions
from wildloom.operators.wildcard import GRAM, MAX_BROADCAST, ahocorasick
from wildloom.session import c, columns_or_fail

#: Automata that this worker has built, the last one used.
_built: dict[str, object] = {}


def _automaton(name: str, words: list[str]):
    if name not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for k, w in enumerate(words):
            found.add_word(w, k)
        found.make_automaton()
        _built[name] = found
    return _built[name]


def literal_hits(texts: DataFrame, text: str, literals: DataFrame, literal: str, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``texts`` times its hits: ``literal`` and ``position`` (1-based, in code points), overlaps included.

    Repeated literals count once, null and empty ones are none; null texts
    have no hits. Columns of ``texts`` with these two names are replaced. The
    literals are measured: a few become expressions, up to ``max_broadcast``
    bytes go to the tasks as one automaton per worker, more are joined with the
    grams of the texts by their first signs.
    """
    columns_or_fail(texts, text)
    columns_or_fail(literals, literal)
    wanted = literals.where(F.length(c(literal)) > 0).select(c(literal).alias("l")).distinct()
    side = wanted.agg(F.coalesce(F.sum(F.octet_length("l") + 64), F.lit(0)).alias("b"), F.count("l").alias("n")).first()
    keep = [c(x) for x in texts.columns if x.lower() not in ("literal", "position")]
    if side["b"] > max_broadcast or (ahocorasick is None and side["n"] > 50):
        return _joined(texts, text, wanted, keep)
    words = sorted(r["l"] for r in wanted.collect())
    if ahocorasick is None or len(words) < 3:

        def places(w: str):
            found = F.coalesce(literal_positions(c(text), w), F.array().cast("array<int>"))
            return F.transform(found, lambda p: F.struct(F.lit(w).alias("literal"), p.alias("position")))

        each = [places(w) for w in words]
        none = F.array().cast("array<struct<literal:string,position:int>>")
        return texts.select(*keep, F.inline(F.concat(none, *each)))
    name, sent = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("array<struct<literal:string,position:int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = sent.value
        found = _automaton(name, words)
        for column in batches:
            which, at, ends = [], [], [0]
            for t in column.to_pylist():
                if t:
                    for last, k in found.iter(t):
                        which.append(k)
                        at.append(last - len(words[k]) + 2)
                ends.append(len(which))
            rows = pa.StructArray.from_arrays([pa.array([words[k] for k in which], pa.string()), pa.array(at, pa.int32())], names=["literal", "position"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return texts.withColumn("__hits", find(c(text))).select(*keep, F.inline("__hits"))


def _joined(texts: DataFrame, text: str, wanted: DataFrame, keep: list) -> DataFrame:
    """Hash join of every place of a text, by the next GRAM signs or fewer at its end and for short literals, with the literals that begin so."""
    n = F.char_length("__text")

    def at(q: int):
        return F.transform(F.when(n >= q, F.sequence(F.lit(1), n - (q - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("position"), F.col("__text").substr(i, F.lit(q)).alias("__gram")))

    base = texts.withColumn("__text", c(text)).where("__text is not null")
    spots = base.select("*", F.inline(F.flatten(F.array(*[at(q) for q in range(1, GRAM + 1)]))).alias("__position", "__gram"))
    side = wanted.select(F.col("l").alias("__literal"), F.left("l", F.lit(GRAM)).alias("__gram"))
    hits = spots.join(side, "__gram").where(F.col("__text").substr(F.col("__position"), F.char_length("__literal")) == F.col("__literal"))
    return hits.select(*keep, F.col("__literal").alias("literal"), F.col("__position").alias("position"))
