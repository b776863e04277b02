"""Connected components of a link table, by alternating large and small stars over DataFrames.

Links never reach the driver; only two counters a round do. Each round is written in the shared folder, so a lost
executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import common


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(u, v)``; root is the smallest node reachable. Loops and repeats are fine."""
    now = common.cut(_tidy(links.select("u", "v")), "links")
    state = _state(now)
    for _ in range(max_rounds):
        nxt = common.cut(_small_star(_large_star(now)), "links")
        after = _state(nxt)
        common.drop_cut(now)
        now = nxt
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    # every remaining link is (node, root); roots point at themselves
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _tidy(links: DataFrame) -> DataFrame:
    return links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _tidy(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _tidy(moved.unionByName(low.select("u", F.col("m").alias("v"))))
