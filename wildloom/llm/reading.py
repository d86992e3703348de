"""Reading level of documents by harmonic propagation on a document-word graph.

Documents and words form a bipartite graph; an edge weighs the word's count in
the document times the word's rarity, log(documents / documents with it). The
graded examples are boundary nodes whose grades are clamped. Each iteration
gives every document the weighted mean of its words' values and every word the
weighted mean of the documents and examples that hold it, until no value moves
by more than a tolerance. A value has one share per grade, each of which is
harmonic by itself; a document's grade is that of its largest share, and its
difficulty, the mean grade, is the harmonic function with the grades
themselves on the boundary. So grades reach words, and through them
documents, that share no word with any example.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildloom.operators.skew import lookup_join
from wildloom.session import c, columns_or_fail, stored, stored_counting

GRADES = (1, 2, 3, 4)
_SHARES = tuple(f"s{g}" for g in GRADES)
#: Share of all weight that the clamped examples have, however many documents there are; each grade has a quarter of it.
CLAMP = 0.6
#: Iterations end when no word's share moves by more than this, at the latest after so many.
TOLERANCE, MOST_ITERATIONS = 2e-3, 60
#: Up to so many bytes of words the values go to the tasks; beyond that words and documents are joined. Both ways give the same values.
MAX_BROADCAST = 32 * 1024 * 1024
WORD_BYTES = 56
MIN_WORDS = 60
#: At most so many graded rows are read, by grade and text.
MAX_EXAMPLES = 10_000

# Frequent short words of the languages that are told apart.
_STOP = {
    "en": "the of and to in is that it for was on are with as his they be at this have from or had by but not what all were when we there can an your which their said if do will how she he i you my has no so would about more its been who into them than her him only other some could our did me any".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wir ich unsere wer jede bevor lief".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux été fait cette mais nous ou ont leur elle si sa même on ces très quand doit rester tout après avons depuis devenu surtout reste".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos ha tiene ahora otra demasiado alguien según".split(),
}
_BIT = {k: 1 << i for i, k in enumerate(_STOP)}
_TONGUE: dict[str, int] = {}
for _k, _ws in _STOP.items():
    for _w in _ws:
        _TONGUE[_w] = _TONGUE.get(_w, 0) | _BIT[_k]
#: Signs that end a word; apostrophes within one are kept.
_ENDS = {i: " " for i in [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0xC0), 0xD7, 0xF7, *range(0x2000, 0x2BFF), *range(0x3000, 0x3040)] if chr(i) not in "'’"} | {0x2019: "'"}


def words_of(text: str) -> list[str]:
    return text.lower().translate(_ENDS).split()


def is_english(words: list[str]) -> bool:
    """Whether English has the most frequent words among them, and at least one in twenty."""
    marks = bytes(map(_TONGUE.get, words, repeat(0)))
    n = {k: sum(marks.count(v) for v in range(1, 16) if v & b) for k, b in _BIT.items()}
    return n["en"] * 20 >= len(words) and n["en"] > 0 and n["en"] >= max(n.values())


class _Numbers(dict):
    """Words to 64-bit numbers, remembered; among a billion words two share one with a chance of 3 %."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        x = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        return x


def encode_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, row (unique), n_words (split at white space), english, words and counts (of English texts), kept in the shared folder."""
    src = df.select(c(key).alias("key"), c(text).alias("text"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for b in batches:
            n, english, ends, ids, counts = [], [], [0], [], []
            for t in b.column(1).to_pylist():
                words = words_of(t or "")
                ok = bool(words) and is_english(words)
                n.append(len((t or "").split()))
                english.append(ok)
                if ok:
                    held = Counter(words)
                    ids += map(numbers.__getitem__, held)
                    counts += held.values()
                ends.append(len(ids))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int32()), pa.array(english, pa.bool_()), *lists], names=["key", "row", "n_words", "english", "words", "counts"])

    kind = src.schema["key"].dataType.simpleString()
    return stored(src.mapInArrow(run, f"key {kind}, row long, n_words int, english boolean, words array<long>, counts array<int>"), "words")


def boundary(examples: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of the graded examples and how often each grade has them."""
    numbers = _Numbers()
    held: dict[int, np.ndarray] = {}
    for text, grade in examples:
        if grade in GRADES:
            for w, n in Counter(words_of(text)).items():
                held.setdefault(numbers[w], np.zeros(len(GRADES)))[GRADES.index(grade)] += n
    ids = np.array(sorted(held), "int64")
    return ids, np.array([held[i] for i in ids.tolist()]).reshape(-1, len(GRADES))


def clamped(counts: np.ndarray, rarity: np.ndarray, mass: float) -> np.ndarray:
    """Weights of the boundary per word and grade: CLAMP of all weight, ``mass`` being that of the documents, in equal parts for all grades."""
    raw = counts * rarity[:, None]
    of_grade = raw.sum(0)
    have = of_grade > 0
    want = CLAMP / (1 - CLAMP) * mass / max(1, have.sum())
    return raw * np.where(have, want / np.where(have, of_grade, 1.0), 0.0)


def _flat(ids: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and the document of each."""
    offsets = ids.offsets.to_numpy()
    part = slice(offsets[0], offsets[-1])
    return ids.values.to_numpy(zero_copy_only=False)[part], counts.values.to_numpy(zero_copy_only=False)[part].astype("f8"), np.repeat(np.arange(len(ids)), np.diff(offsets))


def document_values(at: np.ndarray, counts: np.ndarray, doc: np.ndarray, n: int, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(documents, grades): weighted means of the words' values; zero where no word has one."""
    w = counts * weight[at]
    total = np.bincount(doc, weights=w, minlength=n)
    sums = np.stack([np.bincount(doc, weights=w * values[at, g], minlength=n) for g in range(values.shape[1])], 1)
    return sums / np.where(total > 0, total, 1.0)[:, None]


def _measure(coded: DataFrame) -> tuple[DataFrame, int, int]:
    """(word, documents with it, occurrences), how many words there are and how many documents."""
    docs = coded.where("english")
    per = docs.select(F.explode(F.arrays_zip("words", "counts")).alias("e")).groupBy(F.col("e.words").alias("word")).agg(F.count(F.lit(1)).alias("held"), F.sum("e.counts").alias("n"))
    words, n_words = stored_counting(per, "vocabulary", F.lit(True))
    return words, n_words, docs.count()


def _rarity(held, n_docs: int):
    return F.log(F.lit(float(n_docs + 1)) / held)


class Values:
    """The words' values after the iterations, and how to give documents theirs.

    ``rounds`` is the number of iterations, ``residual`` the largest change in
    the last one.
    """

    def __init__(self, coded: DataFrame, examples: list[tuple[str, int]], tolerance: float = TOLERANCE, iterations: int = MOST_ITERATIONS, max_broadcast: int = MAX_BROADCAST):
        self.coded = coded
        self.rounds, self.residual = 0, 0.0
        words, n, n_docs = _measure(coded)
        self.small = n * WORD_BYTES <= max_broadcast
        (self._sent if self.small else self._joined)(words, n_docs, examples, tolerance, iterations)

    # --- words known to all tasks

    def _sent(self, words: DataFrame, n_docs: int, examples: list, tolerance: float, iterations: int) -> None:
        got = words.toPandas().sort_values("word")
        self.ids = got["word"].to_numpy("int64")
        self.rarity = np.log((n_docs + 1.0) / got["held"].to_numpy("f8"))
        ex_ids, counts = boundary(examples)
        place = np.searchsorted(self.ids, ex_ids)
        inside = place < len(self.ids)
        inside[inside] = self.ids[place[inside]] == ex_ids[inside]
        held = np.zeros((len(self.ids), len(GRADES)))
        held[place[inside]] = counts[inside]
        base = clamped(held, self.rarity, float((got["n"].to_numpy("f8") * self.rarity).sum()))
        fixed = base.sum(1)
        self.values = base / np.where(fixed > 0, fixed, 1.0)[:, None]
        self.weight = np.where(fixed > 0, self.rarity, 0.0)
        for _ in range(iterations):
            sums, mass = self._gathered()
            total = fixed + mass
            new = (base + sums) / np.where(total > 0, total, 1.0)[:, None]
            self.residual = float(np.abs(new - self.values).max(initial=0.0))
            self.values, self.weight = new, np.where(total > 0, self.rarity, 0.0)
            self.rounds += 1
            if self.residual <= tolerance:
                break

    def _gathered(self) -> tuple[np.ndarray, np.ndarray]:
        """Per word the weighted sums of its documents' values, and the weights; a task sends a row per word at most."""
        sent = self.coded.sparkSession.sparkContext.broadcast((self.ids, self.rarity, self.weight, self.values))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, rarity, weight, values = sent.value
            sums, mass = np.zeros_like(values), np.zeros(len(ids))
            for b in batches:
                words, counts, doc = _flat(b.column(0), b.column(1))
                at = np.searchsorted(ids, words)
                docs = document_values(at, counts, doc, b.num_rows, weight, values)
                w = counts * rarity[at] * (docs.sum(1) > 0)[doc]
                mass += np.bincount(at, weights=w, minlength=len(ids))
                for g in range(values.shape[1]):
                    sums[:, g] += np.bincount(at, weights=w * docs[doc, g], minlength=len(ids))
            used = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(sums[used, g]) for g in range(len(GRADES))], pa.array(mass[used])], names=["at", *_SHARES, "mass"])

        parts = self.coded.where("english").select("words", "counts").mapInArrow(run, "at long, " + ", ".join(f"{x} double" for x in _SHARES) + ", mass double")
        got = parts.groupBy("at").agg(*[F.sum(x).alias(x) for x in (*_SHARES, "mass")]).toPandas()
        sent.unpersist()
        sums, mass = np.zeros_like(self.values), np.zeros(len(self.ids))
        sums[got["at"].to_numpy()] = got[list(_SHARES)].to_numpy()
        mass[got["at"].to_numpy()] = got["mass"].to_numpy()
        return sums, mass

    # --- words and documents joined

    def _joined(self, words: DataFrame, n_docs: int, examples: list, tolerance: float, iterations: int) -> None:
        spark = self.coded.sparkSession
        ids, counts = boundary(examples)
        known = words.withColumn("rarity", _rarity(F.col("held"), n_docs))
        mass = known.agg(F.coalesce(F.sum(F.col("n") * F.col("rarity")), F.lit(0.0)).alias("m")).first()["m"]
        # the examples are of bounded number, so their words may be brought together
        ex = spark.createDataFrame([(i, *row) for i, row in zip(ids.tolist(), counts.tolist(), strict=True)], "word long, " + ", ".join(f"{x} double" for x in _SHARES))
        held = known.join(ex, "word").select("word", "rarity", *_SHARES).toPandas()
        base = clamped(held[list(_SHARES)].to_numpy("f8"), held["rarity"].to_numpy("f8"), mass)
        fixed = spark.createDataFrame([(int(i), *row) for i, row in zip(held["word"], base.tolist(), strict=True)], "word long, " + ", ".join(f"b{x} double" for x in _SHARES))
        none = F.lit(0.0)
        total = sum((F.col(f"b{x}") for x in _SHARES), none)
        state = known.join(fixed, "word", "left").fillna(0.0, [f"b{x}" for x in _SHARES]).select("word", "rarity", *[f"b{x}" for x in _SHARES], *[F.when(total > 0, F.col(f"b{x}") / total).otherwise(0.0).alias(x) for x in _SHARES])
        self.state = stored(state, "values")
        for _ in range(iterations):
            docs = self._document_rows().where(sum((F.col(x) for x in _SHARES), none) > 0)
            back = self._edges().join(docs, "row").groupBy("word").agg(*[F.sum(F.col("count") * F.col(x)).alias(f"d{x}") for x in _SHARES], F.sum("count").alias("seen"))
            j = self.state.join(back, "word", "left").fillna(0.0, [f"d{x}" for x in _SHARES]).withColumn("seen", F.coalesce("seen", F.lit(0)))
            whole = total + F.col("seen") * F.col("rarity")
            new = [F.when(whole > 0, (F.col(f"b{x}") + F.col(f"d{x}") * F.col("rarity")) / whole).otherwise(0.0).alias(f"n{x}") for x in _SHARES]
            step = j.select("word", "rarity", *[f"b{x}" for x in _SHARES], *new, F.greatest(*[F.abs(a - F.col(x)) for a, x in zip(new, _SHARES, strict=True)]).alias("moved"))
            step = stored(step, "values")
            self.residual = step.agg(F.coalesce(F.max("moved"), none).alias("m")).first()["m"]
            self.state = step.select("word", "rarity", *[f"b{x}" for x in _SHARES], *[F.col(f"n{x}").alias(x) for x in _SHARES])
            self.rounds += 1
            if self.residual <= tolerance:
                break

    def _edges(self) -> DataFrame:
        return self.coded.where("english").select("row", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("row", F.col("e.words").alias("word"), F.col("e.counts").alias("count"))

    def _document_rows(self) -> DataFrame:
        """row and shares of the documents with a word that has a value; frequent words do not meet in one task."""
        live = self.state.where(sum((F.col(x) for x in _SHARES), F.lit(0.0)) > 0).select("word", "rarity", *_SHARES)
        w = F.col("count") * F.col("rarity")
        sums = lookup_join(self._edges(), live, "word").groupBy("row").agg(*[F.sum(w * F.col(x)).alias(x) for x in _SHARES], F.sum(w).alias("w"))
        return sums.select("row", *[F.when(F.col("w") > 0, F.col(x) / F.col("w")).otherwise(0.0).alias(x) for x in _SHARES])

    # --- documents

    def documents(self) -> DataFrame:
        """key, n_words, english and the shares of each document, all zero where no word has a value."""
        if not self.small:
            out = self.coded.join(self._document_rows(), "row", "left").fillna(0.0, list(_SHARES))
            return out.select("key", "n_words", "english", *_SHARES)
        sent = self.coded.sparkSession.sparkContext.broadcast((self.ids, self.weight, self.values))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, weight, values = sent.value
            for b in batches:
                words, counts, doc = _flat(b.column(3), b.column(4))
                docs = document_values(np.searchsorted(ids, words), counts, doc, b.num_rows, weight, values) if len(ids) else np.zeros((b.num_rows, len(GRADES)))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(docs[:, g]) for g in range(len(GRADES))]], names=["key", "n_words", "english", *_SHARES])

        kind = self.coded.schema["key"].dataType.simpleString()
        return self.coded.select("key", "n_words", "english", "words", "counts").mapInArrow(run, f"key {kind}, n_words int, english boolean, " + ", ".join(f"{x} double" for x in _SHARES))


def reading_levels(df: DataFrame, key: str, text: str, examples: DataFrame, example_text: str, grade: str, tolerance: float = TOLERANCE, iterations: int = MOST_ITERATIONS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """key, n_words, english, grade and difficulty of every document.

    Texts that are not English, and those that no grade reaches, have null
    grade and difficulty; null and empty texts have 0 words. Of equal shares
    the easier grade wins. Repeated keys each have their row.
    """
    columns_or_fail(df, key, text)
    columns_or_fail(examples, example_text, grade)
    rows = examples.where(c(example_text).isNotNull() & c(grade).isNotNull()).select(c(grade), c(example_text)).orderBy(*[c(x) for x in (grade, example_text)]).limit(MAX_EXAMPLES).collect()
    values = Values(encode_words(df, key, text), [(t, g) for g, t in rows], tolerance, iterations, max_broadcast)
    most = F.greatest(*[F.col(x) for x in _SHARES])
    which = F.coalesce(*[F.when(F.col(x) == most, F.lit(g)) for x, g in zip(_SHARES, GRADES, strict=True)])
    mean = sum((F.col(x) * F.lit(float(g)) for x, g in zip(_SHARES, GRADES, strict=True)), F.lit(0.0))
    out = values.documents().withColumnRenamed("key", key)
    return out.select(c(key), "n_words", "english", F.when(most > 0, which).alias("grade"), F.when(most > 0, mean).alias("difficulty"))


__all__ = ["Values", "encode_words", "reading_levels"]
