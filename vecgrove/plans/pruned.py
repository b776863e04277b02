"""Similarity joins pruned by pool sums: a pool's sum bounds the score of each of its rows, if no value is negative.

All inputs are long forms: x (id, dim, val), q (qid, dim, qval); values non-negative. Results equal those of the
unpruned joins in ``operators.exact``, but for rows with score 0, which share no dimension with the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgrove.materialise import cut
from vecgrove.operators import pools
from vecgrove.operators.exact import topk


def pool_bounds(x: DataFrame, q: DataFrame, size: int) -> DataFrame:
    """(qid, pool, bound): an upper bound on the score of each row of the pool."""
    return q.join(pools.leaf_sums(x, size), "dim").groupBy("qid", "pool").agg(F.sum(F.col("qval") * F.col("val")).alias("bound"))


def box_bounds(x: DataFrame, q: DataFrame, size: int) -> DataFrame:
    """(qid, pool, bound) from each pool's smallest and largest value by dimension: sound for values of any sign, if x is
    dense (each dimension of a row present)."""
    pool = F.floor(F.col("id") / size).cast("long").alias("pool")
    box = x.groupBy(pool, "dim").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    part = F.greatest(F.col("qval") * F.col("lo"), F.col("qval") * F.col("hi"))
    return q.join(box, "dim").groupBy("qid", "pool").agg(F.sum(part).alias("bound"))


def candidates(x: DataFrame, q: DataFrame, least: int, sizes: tuple[int, ...] = (128, 32), by_pool: bool = False) -> DataFrame:
    """(qid, pool) of the finest pools that may hold a row at or over the threshold; coarser pools are tested first."""
    kept = None
    for size in sizes:
        sums = pools.leaf_sums(x, size)
        if kept is None:
            met = q.join(sums, "dim")
        else:
            up = kept.select("qid", F.col("pool").alias("up"))
            children = sums.withColumn("up", F.floor(F.col("pool") * size / last).cast("long"))
            met = q.join(up, "qid").join(children, ["up", "dim"]) if by_pool else q.join(children, "dim").join(up, ["qid", "up"], "left_semi")
        kept = met.groupBy("qid", "pool").agg(F.sum(F.col("qval") * F.col("val")).alias("bound")).where(F.col("bound") >= least).select("qid", "pool")
        last = size
    return kept


def score_pools(x: DataFrame, q: DataFrame, kept: DataFrame, size: int, least: int = 1, by_pool: bool = False) -> DataFrame:
    """Exact scores of the rows of the kept (qid, pool) pairs, at or over the threshold.

    Postings meet queries by dimension, and those outside the kept pools go before anything is summed. Where all rows
    share most dimensions, ``by_pool`` opens the pools first.
    """
    rows = x.withColumn("pool", F.floor(F.col("id") / size).cast("long"))
    if by_pool:
        met = q.join(kept, "qid").join(rows, ["pool", "dim"])
    else:
        met = q.join(rows, "dim").join(kept, ["qid", "pool"], "left_semi")
    return met.groupBy("qid", "id").agg(F.sum(F.col("qval") * F.col("val")).alias("score")).where(F.col("score") >= least)


def threshold(x: DataFrame, q: DataFrame, least: int, sizes: tuple[int, ...] = (128, 32), by_pool: bool = False) -> DataFrame:
    """(qid, id, score) of all pairs at or over the threshold, single-sided pruning."""
    return score_pools(x, q, candidates(x, q, least, sizes, by_pool), sizes[-1], least, by_pool)


def double_threshold(x: DataFrame, q: DataFrame, least: int, size: int = 32, qsize: int = 32, by_pool: bool = False) -> DataFrame:
    """The same with both sides pooled: pairs of pools are tested before any query is."""
    grouped = q.withColumn("qpool", F.floor(F.col("qid") / qsize).cast("long"))
    sums = grouped.groupBy("qpool", "dim").agg(F.sum("qval").alias("qval"))
    pairs = sums.join(pools.leaf_sums(x, size), "dim").groupBy("qpool", "pool").agg(F.sum(F.col("qval") * F.col("val")).alias("bound")).where(F.col("bound") >= least)
    opened = grouped.select("qid", "qpool").distinct().join(pairs.select("qpool", "pool"), "qpool").select("qid", "pool")
    sums = pools.leaf_sums(x, size)
    met = q.join(opened, "qid").join(sums, ["pool", "dim"]) if by_pool else q.join(sums, "dim").join(opened, ["qid", "pool"], "left_semi")
    bounds = met.groupBy("qid", "pool").agg(F.sum(F.col("qval") * F.col("val")).alias("bound"))
    return score_pools(x, q, bounds.where(F.col("bound") >= least).select("qid", "pool"), size, least, by_pool)


def page_threshold(x: DataFrame, q: DataFrame, least: int, outer: int = 16, inner: int = 8) -> DataFrame:
    """The same by pages: a page is tested as a whole, then its groups."""
    return threshold(x, q, least, (outer * inner, inner))


def dim_threshold(x: DataFrame, q: DataFrame, least: int, floor_: int) -> DataFrame:
    """Pairs at or over the threshold among those that share a dimension in which both reach ``floor_``."""
    pairs = q.where(F.col("qval") >= floor_).join(x.where(F.col("val") >= floor_), "dim").select("qid", "id").distinct()
    return pairs.join(q, "qid").join(x, ["id", "dim"]).groupBy("qid", "id").agg(F.sum(F.col("qval") * F.col("val")).alias("score")).where(F.col("score") >= least)


def _seeds(x: DataFrame, q: DataFrame, k: int, size: int, pools_each: int, bounds: DataFrame) -> DataFrame:
    """(qid, least): the k-th score in each query's most promising pools, a lower bound on its k-th score of all."""
    w = Window.partitionBy("qid").orderBy(F.desc("bound"), "pool")
    first = bounds.withColumn("r", F.row_number().over(w)).where(F.col("r") <= pools_each).select("qid", "pool")
    kth = topk(score_pools(x, q, first, size), k).groupBy("qid").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    return kth.select("qid", F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(1)).alias("least"))


def knn(x: DataFrame, q: DataFrame, k: int, size: int = 32, pools_each: int = 2) -> DataFrame:
    """(qid, id, score, rank): the k best rows with a positive score; pools under a query's own lower bound are skipped."""
    bounds = pool_bounds(x, q, size)
    seeds = _seeds(x, q, k, size, pools_each, bounds)
    kept = bounds.join(seeds, "qid").where(F.col("bound") >= F.col("least")).select("qid", "pool")
    return topk(score_pools(x, q, kept, size), k)


def double_knn(x: DataFrame, q: DataFrame, k: int, size: int = 32, qsize: int = 32, pools_each: int = 2) -> DataFrame:
    """The same with query pools: a pair of pools opens if its bound reaches the smallest lower bound in the query pool."""
    bounds = pool_bounds(x, q, size)
    seeds = _seeds(x, q, k, size, pools_each, bounds)
    qpool = F.floor(F.col("qid") / qsize).cast("long").alias("qpool")
    least = q.select("qid").distinct().join(seeds, "qid", "left").groupBy(qpool).agg(F.min(F.coalesce("least", F.lit(1))).alias("least"))
    sums = q.groupBy(qpool, "dim").agg(F.sum("qval").alias("qval"))
    pairs = sums.join(pools.leaf_sums(x, size), "dim").groupBy("qpool", "pool").agg(F.sum(F.col("qval") * F.col("val")).alias("bound"))
    opened = pairs.join(least, "qpool").where(F.col("bound") >= F.col("least")).select("qpool", "pool")
    kept = q.select("qid", qpool).distinct().join(opened, "qpool").select("qid", "pool")
    return topk(score_pools(x, q, kept, size), k)


def reordered_knn(x: DataFrame, q: DataFrame, k: int, order: DataFrame, size: int = 32, pools_each: int = 2) -> DataFrame:
    """:func:`knn` on rows laid out by ``order`` (id, pos); the result is the same."""
    moved = x.join(order.select("id", "pos"), "id").select(F.col("pos").alias("id"), "dim", "val")
    bounds = pool_bounds(moved, q, size)
    seeds = _seeds(moved, q, k, size, pools_each, bounds)
    kept = bounds.join(seeds, "qid").where(F.col("bound") >= F.col("least")).select("qid", "pool")
    scored = score_pools(moved, q, kept, size).withColumnRenamed("id", "pos").join(order.select("id", "pos"), "pos").drop("pos")
    return topk(scored, k)


def cascade_knn(x: DataFrame, q: DataFrame, k: int, thresholds: tuple[int, ...] = (64, 16, 4, 1), sizes: tuple[int, ...] = (128, 32)) -> DataFrame:
    """The same by descending thresholds: queries with k hits are done, the others go on; the last threshold is 1."""
    pending, done = q, None
    for least in thresholds:
        hits = cut(threshold(x, pending, least, sizes), "cascade")
        full = hits.groupBy("qid").count().where(F.col("count") >= k).select("qid")
        part = hits.join(full, "qid", "left_semi") if least > 1 else hits
        done = part if done is None else done.unionByName(part)
        pending = pending.join(full, "qid", "left_anti")
    return topk(done, k)


# -- work counters in closed form ----------------------------------------------------------------------------------


def node_scores(tree: DataFrame, q: DataFrame) -> DataFrame:
    """(qid, tree, level, node, score) of all nodes that share a dimension with the query."""
    return q.join(tree, "dim").groupBy("qid", "tree", "level", "node").agg(F.sum(F.col("qval") * F.col("val")).alias("score"))


def threshold_dots(x: DataFrame, q: DataFrame, least: int, levels: int) -> DataFrame:
    """(qid, n_dots): internal nodes whose score reaches the threshold, so whose children a tree search reads."""
    inner = node_scores(pools.tree_sums(x, levels), q).where(F.col("level") < levels)
    n = inner.where(F.col("score") >= least).groupBy("qid").agg(F.count("*").alias("n"))
    return q.select("qid").distinct().join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n_dots"))


def knn_dots(x: DataFrame, q: DataFrame, k: int, levels: int) -> DataFrame:
    """(qid, n_dots): trees, and two for each internal node whose score reaches the k-th best one (1 if there are fewer)."""
    from vecgrove.operators.exact import linscan_topk

    best = linscan_topk(x, q, k).groupBy("qid").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    kth = best.select("qid", F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(1)).alias("kth"))
    inner = node_scores(pools.tree_sums(x, levels), q).where(F.col("level") < levels)
    n = inner.join(kth, "qid").where(F.col("score") >= F.col("kth")).groupBy("qid").agg(F.count("*").alias("n"))
    trees = x.agg(F.countDistinct(F.floor(F.col("id") / (1 << levels))).alias("trees"))
    each = q.select("qid").distinct().join(F.broadcast(trees))  # one row
    return each.join(n, "qid", "left").select("qid", (F.col("trees") + 2 * F.coalesce("n", F.lit(0))).alias("n_dots"))


def double_dots(x: DataFrame, q: DataFrame, least: int, levels: int, qlevels: int) -> DataFrame:
    """(n_dots): the pairs of nodes that a search over both trees reads."""
    data = pools.tree_sums(x, levels).where(F.col("level") < levels)
    asks = pools.tree_sums(q.select(F.col("qid").alias("id"), "dim", F.col("qval").alias("val")), qlevels)
    asks = asks.select(F.col("tree").alias("qtree"), F.col("level").alias("qlevel"), F.col("node").alias("qnode"), "dim", F.col("val").alias("qval"))
    met = data.withColumn("qlevel", F.least("level", F.lit(qlevels)).cast("long")).join(asks, ["dim", "qlevel"])
    pairs = met.groupBy("tree", "level", "node", "qtree", "qnode").agg(F.sum(F.col("qval") * F.col("val")).alias("score")).where(F.col("score") >= least)
    weight = F.when(F.col("level") < qlevels, 3).otherwise(1)
    trees = x.agg(F.countDistinct(F.floor(F.col("id") / (1 << levels))).alias("t"))
    qtrees = q.agg(F.countDistinct(F.floor(F.col("qid") / (1 << qlevels))).alias("u"))
    total = pairs.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n"))
    return total.join(trees).join(qtrees).select((F.col("t") * F.col("u") + F.col("n")).alias("n_dots"))  # one row each
