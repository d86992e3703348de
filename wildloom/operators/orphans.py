"""References to rows that are absent, flagged or newer than the reference.

Parent rows and references are brought into one tagged long form and grouped
by key. A group without a parent row, with a flagged one, or with one newer
than its first reference is kept; each carries its references as counts per
period, which the report sums. References are counted per key and period before
they meet their key, so a key with most of the references is as many rows as
there are periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildloom.operators.skew import lookup_join
from wildloom.session import columns_or_fail

ABSENT = "none"
#: A period of the report.
PERIOD = "yyyy-MM"


def references(children: DataFrame) -> DataFrame:
    """Distinct references of ``children`` (id, key, child_time) with their period; a null or zero key is none."""
    columns_or_fail(children, "id", "key", "child_time")
    refs = children.where("key is not null and key <> 0").select("id", F.col("key").cast("long").alias("key"), "child_time").dropDuplicates()
    return refs.withColumn("period", F.date_format("child_time", PERIOD))


def tagged_keys(tables: dict[str, DataFrame], refs: DataFrame) -> DataFrame:
    """Parent rows of all tables and references in one long form, grouped by key.

    ``tables`` maps a name to rows (id, flag, time); ``refs`` is the result of
    :func:`references`. A key found in two tables belongs to the first by
    name. Columns: key, ref_table, has_parent, flagged, parent_time, first
    (time of the first reference) and periods: period, n, first and last of the
    references, one entry for each period in which there are any.
    """
    long = None
    nothing = F.lit(None)
    span = "struct<period:string,n:bigint,first:timestamp_ntz,last:timestamp_ntz>"
    for name, rows in sorted(tables.items()):
        columns_or_fail(rows, "id", "flag", "time")
        part = rows.where("id is not null").select(F.col("id").cast("long").alias("key"), F.lit(name).alias("ref_table"), F.lit(1).alias("is_parent"), "flag", F.col("time").cast("timestamp_ntz").alias("parent_time"), nothing.cast(span).alias("span"))
        long = part if long is None else long.unionByName(part)
    time = F.col("child_time").cast("timestamp_ntz")
    counts = refs.groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    counts = counts.select("key", nothing.cast("string").alias("ref_table"), F.lit(0).alias("is_parent"), F.lit(False).alias("flag"), nothing.cast("timestamp_ntz").alias("parent_time"), F.struct("period", "n", "first", "last").alias("span"))
    return (
        long.unionByName(counts)
        .groupBy("key")
        .agg(
            F.coalesce(F.min("ref_table"), F.lit(ABSENT)).alias("ref_table"),
            (F.max("is_parent") > 0).alias("has_parent"),
            F.coalesce(F.bool_or("flag"), F.lit(False)).alias("flagged"),
            F.min("parent_time").alias("parent_time"),
            F.min("span.first").alias("first"),
            F.collect_list("span").alias("periods"),
        )
        .where(F.size("periods") > 0)
    )


def faulty_keys(tables: dict[str, DataFrame], refs: DataFrame) -> DataFrame:
    """The groups of :func:`tagged_keys` that have a defect for at least one of their references."""
    return tagged_keys(tables, refs).where("not has_parent or flagged or parent_time > first")


def find_orphans(tables: dict[str, DataFrame], children: DataFrame) -> DataFrame:
    """References with a defect: id, key, ref_table, child_time, reason.

    ``children`` has id, key (the reference; null and 0 are none) and
    child_time. Reasons: missing (no table has the key), deleted (its row is
    flagged) and late (both times are known and the row's is later); two
    reasons give two rows. Repeated children rows count once. Empty tables
    make every reference missing; without children there is no row.
    """
    refs = references(children)
    keys = faulty_keys(tables, refs).select("key", "ref_table", "has_parent", "flagged", "parent_time")
    late = F.col("parent_time") > F.col("child_time")
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("has_parent"), F.lit("missing")),
            F.when(F.col("has_parent") & F.col("flagged"), F.lit("deleted")),
            F.when(F.col("has_parent") & F.coalesce(late, F.lit(False)), F.lit("late")),
        )
    )
    return lookup_join(refs.drop("period"), keys, "key").withColumn("reason", F.explode(reasons)).select("id", "key", "ref_table", "child_time", "reason")


def orphan_report(tables: dict[str, DataFrame], children: DataFrame) -> DataFrame:
    """Counts per referred table, month of the reference and reason: ref_table, month (null where unknown), reason, n_refs, n_keys.

    The counts are summed from the groups. Only for the one period of a key in
    which its row itself was made are references looked at one by one, to
    tell those before it from those after it.
    """
    refs = references(children)
    keys = faulty_keys(tables, refs)
    spans = keys.select("key", "ref_table", "has_parent", "flagged", "parent_time", F.inline("periods"))
    whole = F.col("has_parent") & (F.col("parent_time") > F.col("last"))
    split = F.col("has_parent") & (F.col("parent_time") > F.col("first")) & (F.col("parent_time") <= F.col("last"))
    reasons = F.array_compact(F.array(F.when(~F.col("has_parent"), F.lit("missing")), F.when(F.col("has_parent") & F.col("flagged"), F.lit("deleted")), F.when(whole, F.lit("late"))))
    summed = spans.select("key", "ref_table", "period", "n", F.explode(reasons).alias("reason"))
    borders = spans.where(split).select("key", "ref_table", "parent_time", F.col("period").alias("border"))
    before = lookup_join(refs.select("key", "period", "child_time"), borders, "key").where((F.col("period") == F.col("border")) & (F.col("child_time") < F.col("parent_time")))
    parted = before.groupBy("key", "ref_table", "period").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("late"))
    return summed.unionByName(parted).groupBy("ref_table", F.col("period").alias("month"), "reason").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))
