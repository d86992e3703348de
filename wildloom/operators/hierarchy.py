"""Parent-child rows to full hierarchies by frontier joins over bands of levels.

A row that waits knows the steps from itself up to some ancestor, and waits
for the row above that one. In each round all waiting rows are joined with the
rows they wait for: if that one is placed (the frontier grown from the roots),
depth and path are extended and the row is placed too; if it waits itself, its
steps are added. So round k places the levels 2^(k-1) to 2^k - 1 together, and
a forest of depth d takes about log2(d) joins. Rows that a round without any
newly placed row leaves behind lead onto a cycle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildloom.operators.skew import heavy_keys, lookup_join
from wildloom.session import c, columns_or_fail, parallelism, stored, stored_counting


@dataclass
class Forest:
    """Result of :func:`build_forest`.

    placed: id, root, depth, rooted and, where asked for, path (root first, the
    node last). cyclic: the nodes that no round reaches, with id, parent, inner
    (whether the node has children), and for inner ones wait (the node some
    power of two steps above) and low (the smallest id on the way to it).
    """

    placed: DataFrame
    cyclic: DataFrame
    spark: SparkSession

    def cycles(self) -> DataFrame:
        """id, cycle_id: for every node that leads onto a cycle the smallest id on it.

        The rounds of the forest go on with these nodes alone. Round k knows for
        a node the smallest id among 2^k steps that start 2^k steps ahead; once
        two rounds agree for all nodes, that window lay on the cycle and covered
        it all (two windows over disjoint steps can only share their smallest
        node if it is visited twice). Leaves take part only at the end.
        """
        state = self.cyclic.where("inner").select("id", F.col("wait").alias("jump"), "low", F.lit(None).cast("long").alias("ahead"))
        state, total = stored_counting(state, "cycles", F.lit(True))
        while total:
            b = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
            # after a few rounds all nodes below a cycle have the same pointer
            step = lookup_join(state, b, "jump", total=total).select(
                "id",
                F.col("jump2").alias("jump"),
                F.least("low", "low2").alias("low"),
                F.col("low2").alias("ahead"),
                (~F.col("ahead").eqNullSafe(F.col("low2"))).alias("moved"),
            )
            step, moved = stored_counting(step, "cycles", F.col("moved"))
            state = step.drop("moved")
            if not moved:
                break
        known = state.select("id", F.col("ahead").alias("cycle_id"))
        leaves = self.cyclic.where("not inner").select("id", "parent")
        below = lookup_join(leaves, known.withColumnRenamed("id", "parent"), "parent").select("id", "cycle_id")
        return known.unionByName(below)

    def descendants(self) -> DataFrame:
        """ancestor, descendant, distance: one row per pair of a node and any node above it."""
        up = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("level", "ancestor")
        return self.placed.where("depth > 0").select(F.col("id").alias("descendant"), "depth", up).select("ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))

    def all_descendants(self) -> DataFrame:
        """:meth:`descendants`, and the same for nodes on and below cycles.

        Every node of a cycle is above all others of it and all below them; the
        distance is that of the first visit. A node is not its own descendant.
        """
        if self.cyclic.isEmpty():
            return self.descendants()
        edges = self.cyclic.select("id", "parent")
        top = F.col("id") == F.col("cycle_id")
        # without the edge above its smallest node each cycle is a chain, whose end is that node's parent
        tops = stored(edges.join(self.cycles(), "id").where(top).select("id", F.col("parent").alias("end")), "tops")
        opened = edges.join(tops.select("id"), "id", "left_anti").unionByName(tops.select("id", F.lit(None).cast("long").alias("parent")))
        chains = build_forest(opened)
        ends = tops.select(F.col("end").alias("id"))
        ring = chains.placed.join(ends, "id", "left_semi").select(F.col("root").alias("cycle_id"), F.size("path").alias("size"), F.posexplode("path").alias("place", "id"))
        ring = stored(ring, "ring")
        # without all edges of the cycles the rest are trees below their nodes
        cut = edges.join(ring.select("id"), "id", "left_anti").unionByName(ring.select("id", F.lit(None).cast("long").alias("parent")))
        below = build_forest(cut)
        if not (chains.cyclic.isEmpty() and below.cyclic.isEmpty()):
            raise AssertionError("a cycle was not cut")
        low = ring.select(F.col("id").alias("root"), "cycle_id", "size", F.col("place").alias("low"))
        high = ring.select(F.col("id").alias("ancestor"), "cycle_id", F.col("place").alias("high"))
        hung = stored(lookup_join(below.placed.select("id", "root", "depth"), low, "root"), "hung")
        # a cycle that most rows hang from meets them in as many tasks as there are salts
        hot = heavy_keys(hung, "cycle_id").select("cycle_id", F.lit(parallelism(self.spark)).alias("salts"))
        spread = hung.join(F.broadcast(hot), "cycle_id", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        high = high.join(F.broadcast(hot), "cycle_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        around = spread.join(high, ["cycle_id", "salt"]).where(F.col("ancestor") != F.col("root"))
        around = around.select("ancestor", F.col("id").alias("descendant"), (F.col("depth") + F.pmod(F.col("low") - F.col("high"), F.col("size"))).alias("distance"))
        return self.descendants().unionByName(below.descendants()).unionByName(around)

    def all_descendant_counts(self) -> DataFrame:
        """id, n_descendants, height: of every node, 0 and 0 for leaves."""
        counts = self.all_descendants().groupBy(F.col("ancestor").alias("id")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))
        none = self.placed.select("id").unionByName(self.cyclic.select("id")).select("id", F.lit(0).cast("long").alias("n_descendants"), F.lit(0).alias("height"))
        return counts.unionByName(none).groupBy("id").agg(F.max("n_descendants").alias("n_descendants"), F.max("height").alias("height"))

    def descendant_counts(self) -> DataFrame:
        """ancestor, n_descendants, height; pairs are combined before the shuffle."""
        return self.descendants().groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))


def _raised(rows: DataFrame, above: DataFrame, total: int, paths: bool) -> DataFrame:
    """``rows`` after the join with the rows they wait for: moved up by the steps of those."""
    b = above.select(F.col("id").alias("wait"), F.col("wait").alias("wait2"), F.col("top").alias("top2"), F.col("steps").alias("steps2"), F.col("rooted").alias("rooted2"), F.col("low").alias("low2"), *([F.col("path").alias("path2")] if paths else []))
    j = lookup_join(rows, b, "wait", "left", total=total)
    found = F.col("top2").isNotNull()
    out = [
        "id",
        "parent",
        # a parent that is no node ends the way: its child is the top of an orphaned tree
        F.when(found, F.col("wait2")).alias("wait"),
        F.coalesce("top2", "top").alias("top"),
        F.when(found, F.col("steps") + F.col("steps2") + 1).otherwise(F.col("steps")).alias("steps"),
        F.coalesce("rooted2", F.lit(False)).alias("rooted"),
        F.least("low", "low2").alias("low"),
    ]
    if paths:
        out.append(F.when(found, F.concat("path2", "path")).otherwise(F.col("path")).alias("path"))
    return j.select(*out)


def build_forest(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", paths: bool = True) -> Forest:
    """Place every node under its root, band of levels by band.

    A null or zero parent makes a root; a parent that is no node makes its
    child the top of an orphaned tree (``rooted`` false). Rows with a null id
    are no nodes. Of several rows with one id the largest parent counts. Only
    nodes that have children take part in the rounds; the others are joined
    with their parents once at the end. No join has a hot task, whatever
    number of rows waits for one row. ``paths`` false leaves the paths out. An
    empty table has no trees.
    """
    columns_or_fail(nodes, id_col, parent_col)
    spark = nodes.sparkSession
    edges = (
        nodes.where(c(id_col).isNotNull())
        .groupBy(c(id_col).cast("long").alias("id"))
        .agg(F.max(c(parent_col)).cast("long").alias("parent"))
        .withColumn("parent", F.nullif("parent", F.lit(0).cast("long")))
    )
    edges = stored(edges, "edges")
    parents = edges.where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    start = edges.join(parents, "id", "left").select(
        "id",
        "parent",
        F.col("parent").alias("wait"),
        F.col("id").alias("top"),
        F.lit(0).alias("steps"),
        F.col("parent").isNull().alias("rooted"),
        F.col("id").alias("low"),
        F.coalesce("inner", F.lit(False)).alias("inner"),
        *([F.array("id").alias("path")] if paths else []),
    )
    start, n_waiting = stored_counting(start, "forest", F.col("inner") & F.col("wait").isNotNull())
    leaves = start.where("not inner").drop("inner")
    state = start.where("inner").drop("inner")
    placed = [state.where("wait is null")]
    state = state.where("wait is not null")
    while n_waiting:
        reached = reduce(DataFrame.unionByName, placed, state)
        step, left = stored_counting(_raised(state, reached, n_waiting, paths), "forest", F.col("wait").isNotNull())
        placed.append(step.where("wait is null"))
        state = step.where("wait is not null")
        if left == n_waiting:
            break
        n_waiting = left
    inner = reduce(DataFrame.unionByName, placed)
    rest = leaves.where("wait is not null")
    n_leaves = rest.count()
    ended = stored(_raised(rest, inner.unionByName(state), n_leaves, paths), "forest")
    shape = ["id", F.col("top").alias("root"), F.col("steps").alias("depth"), "rooted", *(["path"] if paths else [])]
    done = inner.unionByName(leaves.where("wait is null")).unionByName(ended.where("wait is null")).select(*shape)
    nothing = F.lit(None).cast("long")
    below = ended.where("wait is not null").select("id", "parent", F.lit(False).alias("inner"), nothing.alias("wait"), nothing.alias("low"))
    cyclic = state.select("id", "parent", F.lit(True).alias("inner"), "wait", "low").unionByName(below)
    return Forest(done, cyclic, spark)


__all__ = ["Forest", "build_forest"]
