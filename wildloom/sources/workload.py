"""Synthetic LIKE workloads with fixed seeds, and digests of them and of results."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SEED = 0xC0FFEE
# The patterns without literals that a workload may add.
WILD = ("%", "%%", "_", "__")


@dataclass(frozen=True)
class Spec:
    texts: int
    patterns: int
    wild: int
    words: int
    hit: float


# Name, texts, patterns, patterns without literals, words in a text, chance of a hit.
SPECS = {
    "sweep_M=10": Spec(10000, 10, 0, 50, 0.05),
    "sweep_M=100": Spec(10000, 100, 0, 50, 0.05),
    "sweep_M=1k": Spec(10000, 1000, 0, 50, 0.05),
    "sweep_M=10k": Spec(2000, 10000, 0, 50, 0.05),
    "short_text_M=1k": Spec(50000, 1000, 0, 10, 0.10),
    "long_text_M=1k": Spec(1000, 1000, 0, 500, 0.05),
    "wildcards_M=100": Spec(2000, 100, 4, 50, 0.05),
}


def generate(spec: Spec, seed: int = SEED) -> tuple[list[str], list[str]]:
    """(texts, patterns); a text holds at most one of the pattern words on purpose."""
    bits = np.random.MT19937()
    bits._legacy_seeding(seed)
    draw = bits.random_raw
    limit = int(spec.hit * 2**32)

    def word(a: int, b: int) -> str:
        n = a + draw() % (b - a + 1)
        return "".join(chr(97 + draw() % 26) for _ in range(n))

    tokens = [word(4, 8) for _ in range(spec.patterns)]
    texts = []
    for _ in range(spec.texts):
        parts, planted = [], False
        for _ in range(spec.words):
            if not planted and draw() < limit:
                parts.append(tokens[draw() % spec.patterns])
                planted = True
            else:
                parts.append(word(3, 9))
        texts.append(" ".join(parts))
    return texts, [f"%{t}%" for t in tokens] + [WILD[i % 4] for i in range(spec.wild)]


def frames(spark: SparkSession, spec: Spec) -> tuple[DataFrame, DataFrame]:
    texts, patterns = generate(spec)
    return (
        spark.createDataFrame(list(enumerate(texts)), "text_id long, text string"),
        spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string"),
    )


def fnv1a(data: bytes, state: int = 0xCBF29CE484222325) -> int:
    for b in data:
        state = ((state ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return state


def corpus_digest(texts: list[str], patterns: list[str]) -> str:
    state = fnv1a(b"")
    for s in [*patterns, *texts]:
        state = fnv1a(s.encode() + b"\n", state)
    return f"{state:016x}"


def pairs_digest(pairs: list[tuple[int, int]]) -> str:
    state = fnv1a(b"")
    for pair in sorted(pairs):
        for x in pair:
            state = fnv1a(int(x).to_bytes(8, "little"), state)
    return f"{state:016x}"
