"""Pools of rows and their vector sums: trees, pages, reordered layouts, per-dimension trees, best partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reorder(dense: DataFrame, shards: int = 64) -> DataFrame:
    """(id, am, pos): rows in the order of their largest component, then id, so that neighbours resemble each other.

    Ranks come from counts: rows are numbered within (largest component, slice of ids), and each such cell starts after
    all before it, so no task orders the whole table.
    """
    from vecgrove.functions.vectors import argmax

    rows = dense.select("id", argmax(F.col("v")).cast("long").alias("am"))
    width = F.greatest(F.ceil((F.max("id") + 1) / shards), F.lit(1)).cast("long")
    rows = rows.join(F.broadcast(rows.agg(width.alias("width")))).withColumn("cell", F.floor(F.col("id") / F.col("width")).cast("long"))
    sizes = rows.groupBy("am", "cell").agg(F.count("*").alias("n"))  # components times slices
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("am", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("am", "cell").orderBy("id")) - 1
    return rows.withColumn("k", inside).join(before.select("am", "cell", "before"), ["am", "cell"]).select("id", "am", (F.col("before") + F.col("k")).alias("pos"))


def leaf_sums(x: DataFrame, size: int) -> DataFrame:
    """(pool, dim, val): sums over pools of ``size`` neighbouring positions; x is (id, dim, val[, pos])."""
    pos = F.col("pos") if "pos" in x.columns else F.col("id")
    return x.groupBy(F.floor(pos / size).cast("long").alias("pool"), "dim").agg(F.sum("val").alias("val"))


def tree_sums(x: DataFrame, levels: int) -> DataFrame:
    """(tree, level, node, dim, val): sums of every node of binary trees over 2^levels positions; the root is node 1.

    One shuffle builds all levels; sums combine before it, so a level costs what its distinct (node, dim) pairs cost.
    """
    size = 1 << levels
    pos = F.col("pos") if "pos" in x.columns else F.col("id")
    at = x.select(F.floor(pos / size).cast("long").alias("tree"), F.pmod(pos, F.lit(size)).cast("long").alias("leaf"), "dim", "val")
    each = at.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    node = F.expr(f"shiftleft(1L, level) + shiftright(leaf, {levels} - level)")
    return each.groupBy("tree", F.col("level").cast("long").alias("level"), node.alias("node"), "dim").agg(F.sum("val").alias("val"))


def dim_trees(x: DataFrame, least: int, levels: int, leaf: int) -> DataFrame:
    """(of, tree, level, node, dim, val): for each dimension ``of``, the tree of the rows that reach ``least`` in it.

    Trees have 2^levels leaves of ``leaf`` neighbouring ids. A row enters as many trees as it has large components.
    """
    lists = x.where(F.col("val") >= least).select("id", F.col("dim").alias("of"))
    size = leaf << levels
    met = lists.join(x, "id").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    node = F.expr(f"shiftleft(1L, level) + shiftright(pmod(id, {size}) div {leaf}, {levels} - level)")
    return met.groupBy(F.col("of").cast("long").alias("of"), F.floor(F.col("id") / size).cast("long").alias("tree"), F.col("level").cast("long").alias("level"), node.alias("node"), "dim").agg(F.sum("val").alias("val"))


def page_sums(x: DataFrame, outer: int = 16, inner: int = 8) -> DataFrame:
    """(page, grp, dim, val): pages of outer x inner rows, one sum for each group of ``inner``."""
    page, grp = F.floor(F.col("id") / (outer * inner)).cast("long"), F.pmod(F.floor(F.col("id") / inner), F.lit(outer)).cast("long")
    return x.groupBy(page.alias("page"), grp.alias("grp"), "dim").agg(F.sum("val").alias("val"))


def merge_sums(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Sums are a commutative monoid: an index with appended rows is the merge of the two indexes."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum("val").alias("val"))


def check_parents(tree: DataFrame) -> DataFrame:
    """Nodes whose sum differs from the sum of their children; empty for a sound tree."""
    child = tree.where("level > 0").groupBy("tree", (F.col("level") - 1).alias("level"), F.shiftright("node", 1).alias("node"), "dim").agg(F.sum("val").alias("below"))
    levels = tree.agg(F.max("level").alias("most"))
    inner = tree.join(F.broadcast(levels)).where("level < most").drop("most")
    return inner.join(child, ["tree", "level", "node", "dim"], "full").where(~F.col("val").eqNullSafe(F.col("below")))


def best_partition(x: DataFrame, rows: int, groups: int, trials: int, seed: int = 1) -> DataFrame:
    """(block, trial, score): for each block of rows x groups neighbours, the trial shuffle with the largest sum of squared group sums."""
    from vecgrove.functions.vectors import mix

    size = rows * groups
    ids = x.select("id").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))))
    ids = ids.withColumn("block", F.floor(F.col("id") / size).cast("long"))
    order = Window.partitionBy("block", "trial").orderBy(mix(F.col("id") * trials + F.col("trial") + seed), "id")
    dealt = ids.withColumn("grp", F.floor((F.row_number().over(order) - 1) / rows).cast("long"))
    sums = dealt.join(x, "id").groupBy("block", "trial", "grp", "dim").agg(F.sum("val").alias("s"))
    scored = sums.groupBy("block", "trial").agg(F.sum(F.col("s") * F.col("s")).alias("score"))
    best = Window.partitionBy("block").orderBy(F.desc("score"), "trial")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("block", "trial", "score")
