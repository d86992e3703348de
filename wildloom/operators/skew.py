"""Joins and keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildloom.session import c, parallelism

#: Where the rows are known to be fewer, no key can hold up a task, and none is set apart.
SPLIT_FROM = 200_000


def heavy_keys(rows: DataFrame, key: str, slices: int | None = None, total: int | None = None) -> DataFrame:
    """Keys of ``rows`` that hold more than one slice of all rows.

    With ``slices`` slices there are fewer than ``slices`` such keys, whatever
    the data, so the result may be broadcast. Counts are combined before the
    shuffle. Nulls are no keys. ``total`` spares the count of all rows where
    it is known. Columns: ``key``, ``n``.
    """
    slices = slices or 4 * parallelism(rows.sparkSession)
    counts = rows.where(c(key).isNotNull()).groupBy(c(key).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    if total is not None:
        return counts.where(F.col("n") * slices > total)
    all_rows = rows.agg(F.count(F.lit(1)).alias("all_n"))
    return counts.join(F.broadcast(all_rows), F.col("n") * slices > F.col("all_n")).select(key, "n")


def lookup_join(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", slices: int | None = None, total: int | None = None) -> DataFrame:
    """Join ``rows`` with ``unique`` (one row per ``key``) without a hot task.

    Rows of heavy keys meet their few partners in a broadcast join (fewer than
    ``slices`` partner rows); all others are shuffled by key, where none holds
    more than one slice. ``how`` is inner or left. A null key has no partner.
    ``total`` is the number of rows where it is known; under ``SPLIT_FROM``
    one plain join does.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    if total is not None and total < SPLIT_FROM:
        return rows.join(unique, key, how)
    heavy = heavy_keys(rows, key, slices, total).select(c(key).alias("__heavy_key"))
    marked = rows.join(F.broadcast(heavy), c(key) == F.col("__heavy_key"), "left")
    partner = unique.join(F.broadcast(heavy), c(key) == F.col("__heavy_key"), "left_semi")
    light = marked.where(F.col("__heavy_key").isNull()).drop("__heavy_key").join(unique, key, how)
    hot = marked.where(F.col("__heavy_key").isNotNull()).drop("__heavy_key").join(F.broadcast(partner), key, how)
    return light.unionByName(hot)
