"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 2^32 places; a row's place is a hash of its doc_id, text checksum and
size, and the arc that it falls in belongs to the next point clockwise. Shards have capacities that add up to the number
of rows and differ by at most one; rows that find their shard full continue clockwise to the next shard with room.

The walk needs no rows on the driver: they are counted by (cell, arc), where a cell is one of 2^16 stretches of the ring,
and the counts of the ``shards * vnodes`` arcs alone go to the driver, which walks the ring once and cuts each arc's ranks
into ranges [from, to) with a shard and a first slot. A row's rank in its arc is its cell's offset plus its place in the
cell, in the order of the ring, so the result depends on the rows alone, never on files or partitions. Rows gather by
cell, never by arc or shard; equal rows are one row with a count until they are placed.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgrove.llm import common

SHARDS = 16
VNODES = 64
RING = 1 << 32
CELL_BITS = 16


def points(shards: int = SHARDS, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard), sorted; a shard's points do not depend on the number of shards."""
    return sorted((zlib.crc32(b"shard %d point %d" % (s, v)) * 2654435761 % RING, s) for s in range(shards) for v in range(vnodes))


def walk(counts: list[int], owners: list[int], shards: int) -> list[list[tuple[int, int, int, int]]]:
    """For each arc, its rows' ranks cut into (from, to, shard, first slot).

    A first turn gives each arc's rows to its owner while that has room; the rest of an arc continues clockwise.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    cuts: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]
    left = list(counts)

    def give(arc: int, shard: int) -> None:
        n = min(left[arc], room[shard] - used[shard])
        if n:
            done = counts[arc] - left[arc]
            cuts[arc].append((done, done + n, shard, used[shard]))
            used[shard] += n
            left[arc] -= n

    for arc, shard in enumerate(owners):
        give(arc, shard)
    for arc in range(len(counts)):
        step = 1
        while left[arc]:
            give(arc, owners[(arc + step) % len(owners)])
            step += 1
    return cuts


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot (gapless from 0 in each shard), grown_shard (null), home_shard.

    size is the UTF-8 bytes of the text plus 1; a null text has none. Rows with null or repeated doc_ids, and repeated
    rows, are rows like any others. Counts of shards differ by at most one, so an empty table gives an empty result and
    fewer rows than shards leave some shards empty. Other columns are ignored.
    """
    ring = points(shards, vnodes)
    places = [p for p, _ in ring]
    owners = [s for _, s in ring]
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        common.crc32_text(F.col("text")).alias("text_crc32"),
    )
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 32)
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("place", place)
    saved = common.cut(rows.withColumn("cell", F.shiftright("place", 32 - CELL_BITS)), "ring")

    def tally(batches):
        for b in batches:
            arcs = np.searchsorted(places, b.column(0).to_numpy(zero_copy_only=False)) % len(places)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(arcs), b.column(2)], names=["cell", "arc", "n"])

    counted = common.map_arrow(saved.select("place", "cell", "n"), tally, "cell long, arc long, n long")
    tallied = common.cut(counted.groupBy("cell", "arc").agg(F.sum("n").alias("n")), "tally")
    sums = dict(tallied.groupBy("arc").agg(F.sum("n")).collect())  # at most shards * vnodes rows
    cuts = walk([sums.get(a, 0) for a in range(len(ring))], owners, shards)
    before = tallied.withColumn("before", F.sum("n").over(Window.partitionBy("arc").orderBy("cell")) - F.col("n"))
    return _place(saved, before, cuts, places, owners)


def _place(saved: DataFrame, before: DataFrame, cuts, places: list[int], owners: list[int]) -> DataFrame:
    """Each cell's rows meet the cell's own rank offsets, which sort first, and take shards and slots one by one."""
    shared = common.share(saved.sparkSession, cuts)  # one range for each arc and each shard that it spills into
    kind = saved.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, home_shard int"
    none = F.lit(None)
    offsets = before.select("cell", "arc", "before", none.cast(kind).alias("doc_id"), none.cast("long").alias("size"), none.cast("long").alias("text_crc32"), none.cast("long").alias("place"), none.cast("long").alias("n"))
    data = saved.select("cell", none.cast("long").alias("arc"), none.cast("long").alias("before"), "doc_id", "size", "text_crc32", "place", "n")
    met = offsets.unionByName(data).repartition("cell").sortWithinPartitions("cell", F.col("arc").asc_nulls_last(), "place", "doc_id", "size", "text_crc32")

    def run(batches):
        cuts = shared.value
        ends = [[c[1] for c in arc] for arc in cuts]
        rank: dict[int, int] = {}
        now = None
        for b in batches:
            cell, arc, first = (b.column(k).to_pylist() for k in range(3))
            arcs = np.searchsorted(places, b.column(6).fill_null(0).to_numpy(zero_copy_only=False)) % len(places)
            rows, shard, slot = [], [], []
            times = b.column(7).to_pylist()
            for i, a in enumerate(arcs.tolist()):
                if cell[i] != now:
                    now, rank = cell[i], {}
                if arc[i] is not None:
                    rank[arc[i]] = first[i]
                    continue
                for r in range(rank[a], rank[a] + times[i]):
                    lo, _, s, start = cuts[a][bisect.bisect_right(ends[a], r)]
                    rows.append(i)
                    shard.append(s)
                    slot.append(start + r - lo)
                    if len(rows) >= 100_000:  # many equal rows make several batches
                        yield made(b, arcs, rows, shard, slot)
                        rows, shard, slot = [], [], []
                rank[a] += times[i]
            yield made(b, arcs, rows, shard, slot)

    def made(b, arcs, rows, shard, slot):
        took, n = pa.array(rows, pa.int64()), len(rows)
        home = pa.array(np.array(owners, np.int32)[arcs[rows]] if n else [], pa.int32())
        return pa.RecordBatch.from_arrays(
            [*(b.column(k).take(took) for k in (3, 4, 5)), pa.array(["rows"] * n, pa.string()), pa.array(shard, pa.int32()), pa.array(slot, pa.int64()), pa.nulls(n, pa.int32()), home],
            names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "home_shard"],
        )

    return common.map_arrow(met, run, schema)
