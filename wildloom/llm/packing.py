"""Filling containers of fixed capacity with documents.

Documents are spread over groups of about ``GROUP_TOKENS`` tokens each by a
hash of their key, so the number of groups follows the data while a group
stays small enough for one task; a group leaves about one container unfilled.
Within a group each document goes into the tightest container that suits it:
containers are ordered by residual, and each carries one bitmap of the sources
and one of the duplicate clusters it holds. The successor search goes on to
looser containers until one without a conflict is found; where there is none a
new container is begun. Large documents go first, and those of frequent
sources before others of their size, as every one of them needs a container of
its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wildloom.llm.tokens import VOCABULARY, count_tokens
from wildloom.session import c, columns_or_fail, stored

CAPACITY = 2048
GROUP_TOKENS = 2_000_000
#: How many tokens, in capacities, a document goes before its size if its source has one document for each container the group needs.
PRESSURE = 0.3


class Shelf:
    """Containers of one group by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: dict[int, list[int]] = {}
        self.mask = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _find(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """(residual, place in its list) of the tightest container that holds neither bit; residuals in rising order."""
        rest = self.mask >> size
        r = size
        sources, clusters = self.sources, self.clusters
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            for k, b in enumerate(self.at[r]):
                if not clusters[b] & cluster and not sources[b] & source:
                    return r, k
            rest >>= step + 1
            r += 1
        return None

    def place(self, size: int, source: int, cluster: int) -> int:
        """Container for one item, which shares it neither with an item of its source nor with one of its cluster."""
        spot = self._find(size, source, cluster)
        if spot is None:
            b, left = len(self.sources), self.capacity - size
            self.sources.append(0)
            self.clusters.append(0)
        else:
            r, k = spot
            row = self.at[r]
            b, left = row[k], r - size
            row[k] = row[-1]
            row.pop()
            if not row:
                del self.at[r]
                self.mask &= ~(1 << r)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.at.setdefault(left, []).append(b)
        self.mask |= 1 << left
        return b


def pack_group(sizes: np.ndarray, sources: list, clusters: list, capacity: int) -> np.ndarray:
    """Container number of each item; items are at most ``capacity`` long."""
    source_bit: dict = {}
    names = pd.Series(sources, dtype=object)
    rows = names.map(names.value_counts()).fillna(0).to_numpy("f8")
    needed = max(1.0, float(sizes.sum()) / capacity)
    order = np.argsort(-(sizes / capacity + PRESSURE * rows / needed), kind="stable")
    counts = pd.Series(clusters).value_counts()
    cluster_bit = {x: 1 << i for i, x in enumerate(counts.index[counts > 1])}
    shelf = Shelf(capacity)
    out = np.zeros(len(sizes), "int64")
    for i in order:
        n = int(sizes[i])
        s = 0 if sources[i] is None or n == 0 else 1 << source_bit.setdefault(sources[i], len(source_bit))
        # an empty document is no copy of another one
        out[i] = shelf.place(n, s, cluster_bit.get(clusters[i], 0) if n else 0)
    return out


def same_text(text: Column) -> Column:
    """A number that texts share which differ at most in case, blanks, line breaks and punctuation."""
    bare = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    return F.xxhash64(F.when(bare != "", bare).otherwise(text))


def _given(cluster: Column, key: Column) -> Column:
    return F.when(cluster.isNull(), F.xxhash64(F.lit("alone"), key)).otherwise(F.xxhash64(F.lit("cluster"), cluster))


def pack(df: DataFrame, key: str, text: str, source: str, capacity: int = CAPACITY, path: str = VOCABULARY, group_tokens: int = GROUP_TOKENS, cluster: str | None = None) -> DataFrame:
    """Containers of ``capacity`` tokens: key, piece, first_token, n_tokens, bin_id.

    A document longer than the capacity is cut into full pieces, each with a
    container of its own, and a rest; no other is cut. Null and empty texts
    have 0 tokens, still get a place, and conflict with none; nor does a null
    source. No container has two documents of one source or of one duplicate
    cluster: ``cluster`` names a column that holds the clusters of another
    operator (null: no copy of any other), and without it :func:`same_text`
    tells copies. Repeated keys are packed as separate documents.
    """
    columns_or_fail(df, key, text, source, *([cluster] if cluster else []))
    if capacity < 1:
        raise ValueError("capacity must be positive")
    narrow = df.select(c(key).alias("key"), c(text).alias("text"), c(source).cast("string").alias("source"), (_given(c(cluster), c(key)) if cluster else same_text(c(text))).alias("cluster"))
    sized = stored(count_tokens(narrow, "text", "n", path).select("key", "source", "n", "cluster"), "sizes")
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    groups = max(1, -(-total // group_tokens))
    full = F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / capacity).cast("int")
    rest = sized.select("key", "source", "cluster", full.alias("piece"), (full.cast("long") * capacity).alias("first_token"), (F.col("n") - full.cast("long") * capacity).alias("n_tokens"))
    kind = df.schema[key].dataType.simpleString()

    def run(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "key", "cluster"], ascending=[False, True, True], kind="stable")
        src = [None if pd.isna(s) else s for s in g["source"]]
        bins = pack_group(g["n_tokens"].to_numpy(), src, g["cluster"].tolist(), capacity)
        return g[["key", "piece", "first_token", "n_tokens"]].assign(bin_id=[f"{keys[0]}-{b}" for b in bins])

    grouped = rest.withColumn("g", F.pmod(F.xxhash64("key", "cluster"), F.lit(groups)).cast("int"))
    packed = grouped.groupBy("g").applyInPandas(run, f"key {kind}, piece int, first_token long, n_tokens long, bin_id string")
    cut = sized.where(F.col("n") > capacity).select("key", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.col("cluster"))
    own = F.concat(F.lit("full-"), F.col("key").cast("string"), F.lit("-"), F.hex("cluster"), F.lit("-"), F.col("piece").cast("string"))
    alone = cut.select("key", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"), own.alias("bin_id"))
    return packed.unionByName(alone).withColumnRenamed("key", key)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per container: bin_id, pieces, used and unused tokens."""
    per = packed.groupBy("bin_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("used"))
    return per.withColumn("unused", F.lit(capacity) - F.col("used"))


def conflicts(packed: DataFrame, df: DataFrame, key: str, text: str, source: str, capacity: int = CAPACITY) -> DataFrame:
    """bin_id and fault of every container with too many tokens, two documents of a source or two copies of a text; keys must be unique."""
    facts = df.select(c(key).alias("__key"), c(source).cast("string").alias("source"), same_text(c(text)).alias("copy"))
    held = packed.where("n_tokens > 0").join(facts, c(key) == F.col("__key")).groupBy("bin_id")
    n = held.agg(F.sum("n_tokens").alias("used"), (F.count("source") - F.countDistinct("source")).alias("same"), (F.count("copy") - F.countDistinct("copy")).alias("copies"))
    faults = F.array_compact(F.array(F.when(F.col("used") > capacity, F.lit("capacity")), F.when(F.col("same") > 0, F.lit("source")), F.when(F.col("copies") > 0, F.lit("copy"))))
    return n.select("bin_id", F.explode(faults).alias("fault"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_bins, n_pieces, n_tokens and the share of all capacity that is used."""
    per = containers(packed, capacity)
    return per.agg(F.count(F.lit(1)).alias("n_bins"), F.sum("pieces").alias("n_pieces"), F.sum("used").alias("n_tokens"), (F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"), F.max("used").alias("most"))
