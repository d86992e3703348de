"""Per-key results where a few keys hold most rows: exact offset chunking.

The rows are put in one global order (key, order columns) by range
partitions, which cut a hot key wherever it is longer than a partition. Then

1. each partition counts its first and last key,
2. prefix sums over the partitions give the exact offset at which a
   partition continues a key begun in an earlier one,
3. rows are numbered within their key (offset + position) and chunked by that
   number into pieces of at most ``chunk_rows`` rows,
4. each piece is folded into one small state, and
5. the states of a key, in chunk order, are merged; values that need a
   neighbour (gaps) are completed at the piece boundaries.

No step gives a task more than one partition of rows or one state per piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wildloom.session import c, columns_or_fail, materialize, parallelism

CHUNK_ROWS = 250_000
STATE = "key string, chunk long, start_no long, n long, first_us long, last_us long, known long, max_gap_us long, bursts long, value_sum long"
#: A pause longer than this begins a new burst of activity of a key.
BURST_US = 86_400_000_000


def _edges(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per partition: its number, first and last key, and how many rows the last key has in it."""
    pid = first = last = None
    n_last = 0
    for b in it:
        if not len(b):
            continue
        keys = b["key"].to_numpy(dtype=object)
        if pid is None:
            pid, first = int(b["pid"].iloc[0]), keys[0]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        tail = len(keys) - (int(cuts[-1]) if len(cuts) else 0)
        n_last = n_last + tail if not len(cuts) and keys[0] == last else tail
        last = keys[-1]
    if pid is not None:
        yield pd.DataFrame({"pid": [pid], "first": [first], "last": [last], "n_last": [n_last]})


def _offsets(ordered: DataFrame) -> list[tuple[int, int]]:
    """(partition, rows its first key already has in earlier partitions); one pair per partition."""
    edges = ordered.mapInPandas(_edges, "pid int, first string, last string, n_last long").orderBy("pid").collect()
    out, key, run = [], None, 0
    for r in edges:
        before = run if r["first"] == key else 0
        out.append((r["pid"], before))
        run = r["n_last"] + (before if r["first"] == r["last"] else 0)
        key = r["last"]
    return out


class KeyedOrder:
    """Rows in (key, order) order with exact row numbers within each key.

    ``key`` is cast to string; rows with a null key belong to none and are left
    out. ``time`` (timestamp or null) and ``value`` (integral or null) are what
    the states fold. Ties in the order are resolved by ``tie``; rows equal in
    all columns are interchangeable. An empty table has no keys.
    """

    def __init__(self, df: DataFrame, key: str, time: str, value: str, tie: str, partitions: int | None = None):
        columns_or_fail(df, key, time, value, tie)
        n = partitions or parallelism(df.sparkSession)
        narrow = df.where(c(key).isNotNull()).select(
            c(key).cast("string").alias("key"),
            c(time).cast("timestamp_ntz").alias("t"),
            c(tie).cast("long").alias("tie"),
            c(value).cast("long").alias("value"),
        )
        ranged = narrow.repartitionByRange(n, "key", F.col("t").asc_nulls_last(), "tie", "value")
        ordered = ranged.sortWithinPartitions("key", F.col("t").asc_nulls_last(), "tie", "value").withColumn("pid", F.spark_partition_id())
        self.rows = materialize(ordered)
        self.offsets = dict(_offsets(self.rows))

    def states(self, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        """One state per key and chunk of at most ``chunk_rows`` of its rows."""
        offsets = self.offsets

        def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, ordinal, begun = None, 0, False
            for b in it:
                if not len(b):
                    continue
                keys = b["key"].to_numpy(dtype=object)
                if not begun:
                    ordinal, key, begun = offsets[int(b["pid"].iloc[0])], keys[0], True
                new = np.empty(len(keys), bool)
                new[0] = keys[0] != key
                new[1:] = keys[1:] != keys[:-1]
                at = np.arange(len(keys))
                start = np.maximum.accumulate(np.where(new, at, -1))
                num = np.where(start < 0, ordinal + at, at - start)
                chunk = num // chunk_rows
                cut = new.copy()
                cut[0] = True
                cut[1:] |= chunk[1:] != chunk[:-1]
                heads = np.flatnonzero(cut)
                t = b["t"].to_numpy(dtype="datetime64[us]")
                known = ~np.isnat(t)
                us = np.where(known, t.astype("int64"), 0)
                # nulls come last within a key, so known times are neighbours
                gap = np.zeros(len(keys), "int64")
                gap[1:] = np.where(known[1:] & known[:-1] & ~cut[1:], us[1:] - us[:-1], 0)
                n_known = np.add.reduceat(known.astype("int64"), heads)
                value = b["value"].fillna(0).to_numpy(dtype="int64")
                ends = np.append(heads[1:], len(keys))
                last_at = np.maximum(heads, heads + n_known - 1)
                yield pd.DataFrame(
                    {
                        "key": keys[heads],
                        "chunk": chunk[heads],
                        "start_no": num[heads],
                        "n": ends - heads,
                        "first_us": pd.array(np.where(n_known > 0, us[heads], 0), dtype="Int64"),
                        "last_us": pd.array(np.where(n_known > 0, us[last_at], 0), dtype="Int64"),
                        "known": n_known,
                        "max_gap_us": np.maximum.reduceat(gap, heads),
                        "bursts": np.add.reduceat((gap > BURST_US).astype("int64"), heads),
                        "value_sum": np.add.reduceat(value, heads),
                    }
                )
                ordinal, key = int(num[-1]) + 1, keys[-1]

        return self.rows.mapInPandas(fold, STATE)

    def numbered(self) -> DataFrame:
        """Every row with ``row_no``, its exact 1-based place within its key."""
        offsets = self.offsets

        def number(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, ordinal, begun = None, 0, False
            for b in it:
                if not len(b):
                    continue
                keys = b["key"].to_numpy(dtype=object)
                if not begun:
                    ordinal, key, begun = offsets[int(b["pid"].iloc[0])], keys[0], True
                at = np.arange(len(keys))
                new = np.append(keys[0] != key, keys[1:] != keys[:-1])
                start = np.maximum.accumulate(np.where(new, at, -1))
                num = np.where(start < 0, ordinal + at, at - start)
                yield b[["key", "t", "tie", "value"]].assign(row_no=num + 1)
                ordinal, key = int(num[-1]) + 1, keys[-1]

        return self.rows.mapInPandas(number, "key string, t timestamp_ntz, tie long, value long, row_no long")

    def results(self, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        """Per key: n_rows, first_time, last_time, max_gap_s, n_bursts, value_sum.

        Unknown times are counted in n_rows only. A key without known times has
        null times, no gap (null) and 0 bursts; with one, the gap is null too.
        """
        w = Window.partitionBy("key").orderBy("start_no")
        s = self.states(chunk_rows).withColumn("before", F.when(F.lag("known").over(w) > 0, F.lag("last_us").over(w)))
        joint = F.when((F.col("known") > 0) & F.col("before").isNotNull(), F.col("first_us") - F.col("before"))
        s = s.withColumn("joint", joint)
        seen = F.col("known") > 0

        def moment(us):
            seconds = us.cast("decimal(20,0)") / F.lit(1_000_000)
            return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))

        return s.groupBy("key").agg(
            F.sum("n").alias("n_rows"),
            moment(F.min(F.when(seen, F.col("first_us")))).alias("first_time"),
            moment(F.max(F.when(seen, F.col("last_us")))).alias("last_time"),
            F.when(F.sum("known") > 1, F.greatest(F.max("max_gap_us"), F.coalesce(F.max("joint"), F.lit(0))) / F.lit(1_000_000)).cast("long").alias("max_gap_s"),
            (F.sum("bursts") + F.sum(F.when(F.col("joint") > BURST_US, 1).otherwise(0)) + F.when(F.sum("known") > 0, 1).otherwise(0)).cast("long").alias("n_bursts"),
            F.sum("value_sum").alias("value_sum"),
        )


def hot_keys(df: DataFrame, key: str, time: str, value: str, tie: str, share: float = 0.02) -> DataFrame:
    """Keys held by at least ``share`` of all rows of ``df`` (null keys count as rows, not as keys).

    Columns ``hot_key`` and ``n_rows``. An empty table has none.
    """
    total = df.agg(F.count(F.lit(1)).alias("all_n"))
    counts = KeyedOrder(df, key, time, value, tie).states().groupBy("key").agg(F.sum("n").alias("n_rows"))
    return counts.join(F.broadcast(total), F.col("n_rows") >= F.col("all_n") * F.lit(share)).select(F.col("key").alias("hot_key"), "n_rows")


__all__ = ["KeyedOrder", "hot_keys"]
