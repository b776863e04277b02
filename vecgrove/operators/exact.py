"""Exact similarity joins: nested-loop over dense blocks, inverted index over sparse rows; top-k and threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgrove.materialise import cut
from vecgrove.shipping import ship

#: Query matrices go to the executors in groups of at most so many numbers (64 MB), one pass over the data each.
GROUP_NUMBERS = 8_000_000
#: Scores that a task holds at a time (8 MB): a block has fewer rows where there are more queries.
BLOCK_SCORES = 1 << 20


def topk(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k best rows of each query with their rank, from 1; ties go to the larger id."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def ids_sorted(found: DataFrame) -> DataFrame:
    """(qid, ids): each query's ids, ascending; k or fewer by construction of the callers."""
    return found.groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def passes(rows: DataFrame, q: DataFrame, work, schema: str, group_numbers: int = GROUP_NUMBERS) -> DataFrame:
    """``work(batches, qids, m)`` over the record batches of ``rows``, for the whole of ``q`` (id, v) as a matrix ``m``.

    Queries are dealt into groups by their ids. A group's matrix is the only data on the driver and the only broadcast at
    a time: with several groups each pass is written before the next one's queries are fetched. ``rows`` are not shuffled.
    """
    spark = rows.sparkSession
    ship(spark)
    n, dims = q.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    groups = -(-n * dims // group_numbers)
    out = None
    for g in range(groups):
        some = q.select("id", "v") if groups == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).select("id", "v")
        held = some.collect()  # about ``group_numbers`` numbers
        if not held:
            continue
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in held]), np.array([r[1] for r in held], np.float64)))
        del held

        def run(batches, shared=shared):
            yield from work(batches, *shared.value)

        part = rows.mapInArrow(run, schema)
        if groups > 1:
            part = cut(part, "scan")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def columns(made, schema: str):
    """A record batch of whole-number columns."""
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in made], names=names_of(schema))


def inner_products(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    return v @ m.T


def _scan(x: DataFrame, q: DataFrame, make, schema: str = "qid long, id long, score long", group_numbers: int = GROUP_NUMBERS, score=inner_products, fold=None) -> DataFrame:
    """Every row of ``x`` against every query; ``make(qids, ids, scores)`` gives the columns to keep of a block of scores.

    ``fold(qids)``, such as :class:`Best`, takes the blocks instead (``step(ids, scores)``) and gives the columns when the
    task has seen all rows (``end()``).
    Components must be whole numbers small enough that scores stay below 2^53; they are then exact in any order.
    """

    def work(batches, qids, m):
        kept = fold(qids) if fold else None
        size = max(1, BLOCK_SCORES // len(qids))
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
            for s in range(0, len(ids), size):
                scores = score(v[s : s + size], m)
                if kept:
                    kept.step(ids[s : s + size], scores)
                else:
                    yield columns(make(qids, ids[s : s + size], scores), schema)
        if kept and (got := kept.end()):
            yield columns(got, schema)

    return passes(x.select("id", "v"), q, work, schema, group_numbers)


class Best:
    """The k best rows of each query in what a task reads, ties to the larger id; scores below ``least`` are no rows.

    Pairs under a query's k-th score so far go at once, so a task holds and sends about k rows a query, whatever it reads.
    """

    def __init__(self, qids: np.ndarray, k: int, least: float = -np.inf):
        self.qids, self.k = qids, k
        self.floor = np.full(len(qids), least)
        self.held: list[tuple] = []
        self.size = 0

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Pairs of query numbers, ids and scores."""
        self.held.append((q, ids, scores))
        self.size += len(q)
        if self.size > 2 * len(self.qids) * self.k + BLOCK_SCORES // 4:
            self._fold()

    def _fold(self) -> None:
        q, ids, scores = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((-ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], scores[last])
        self.held, self.size = [(q[keep], ids[keep], scores[keep])], int(keep.sum())

    def step(self, ids, scores, at=slice(None)):
        """A block of scores, rows by queries: all of them, or those numbered ``at``."""
        if len(ids) > self.k:
            self.floor[at] = np.maximum(self.floor[at], np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        i, j = np.nonzero(scores >= self.floor[at])
        if len(i):
            self.add(np.arange(len(self.qids))[at][j], ids[i], scores[i, j])

    def end(self):
        if not self.size:
            return None
        self._fold()
        q, ids, scores = self.held[0]
        return self.qids[q], ids, scores


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of all rows that reach the k-th score of the block, ties included."""
    if scores.shape[0] <= k:
        i, j = np.indices(scores.shape)
        return i.ravel(), j.ravel()
    kth = np.partition(scores, scores.shape[0] - k, axis=0)[scores.shape[0] - k]
    return np.nonzero(scores >= kth[None, :])


def knn(x: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) of the k largest inner products; x and q are (id, v) of whole numbers."""
    return topk(_scan(x, q, None, fold=lambda qids: Best(qids, k)), k)


def dense_linscan_topk(x: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """:func:`linscan_topk` for rows (id, v) that have all dimensions. The lists of such an index are as long as the table, and
    a join by dimension would move rows x queries x dimensions numbers; a block of rows is a stretch of every list, whose
    parts of the scores add up in place."""
    return knn(x, q, k)


def knn_by_tree(x: DataFrame, q: DataFrame, k: int, tree: int = 1024) -> DataFrame:
    """The same by a top-k in each tree of ``tree`` rows and a merge of those; a block emits its part of each tree's top-k."""

    def make(qids, ids, scores):
        got = []
        for t in np.unique(ids // tree):
            own = np.flatnonzero(ids // tree == t)
            i, j = _best(scores[own], k)
            got.append((qids[j], ids[own[i]], scores[own[i], j]))
        return [np.concatenate(c) for c in zip(*got)]

    w = Window.partitionBy("qid", F.floor(F.col("id") / tree)).orderBy(F.desc("score"), F.desc("id"))
    local = _scan(x, q, make).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    return topk(local, k)


def reaching(least: float):
    """All pairs with a score of at least ``least``."""

    def make(qids, ids, scores):
        i, j = np.nonzero(scores >= least)
        return qids[j], ids[i], scores[i, j]

    return make


def threshold(x: DataFrame, q: DataFrame, least: int) -> DataFrame:
    """(qid, id, score) of all pairs with an inner product of at least ``least``."""
    return _scan(x, q, reaching(least))


def score_histogram(x: DataFrame, q: DataFrame, unit: int, bins: int = 1000) -> DataFrame:
    """(bin, n): pairs by score in steps of unit / bins, the last bin open; a block emits counts, never pairs."""

    def make(qids, ids, scores):
        at, n = np.unique(np.minimum(bins - 1, np.floor(scores * float(bins) / unit)), return_counts=True)
        return at, n

    return _scan(x, q, make, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def coded(x: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, q) written once with dimensions as longs, without the dimensions that no query has, as they add to no score.

    The code is a dictionary of the queries' dimensions, so it is exact; what an index join or a pruned join reads
    afterwards is the postings that queries can touch, with short keys, instead of the whole table with its own keys.
    Entries of one (id, dim) may still be apart, as n-grams before they are counted: they add up here, after the join has
    dropped the most.
    """
    words = cut(q.select("dim").distinct().withColumn("code", F.monotonically_increasing_id()), "dims")
    code = F.col("code").alias("dim")
    own = x.join(words, "dim").groupBy("id", code).agg(F.sum("val").alias("val"))
    asks = q.join(words, "dim").groupBy("qid", code).agg(F.sum("qval").alias("qval"))
    return cut(own, "postings"), cut(asks, "asks")


def queries_of(x: DataFrame) -> DataFrame:
    """Long form of queries: (qid, dim, qval)."""
    return x.select(F.col("id").alias("qid"), "dim", F.col("val").alias("qval"))


def linscan(x: DataFrame, q: DataFrame, least: int = 1) -> DataFrame:
    """(qid, id, score): inverted-index join of long forms; q is (qid, dim, qval)."""
    return q.join(x, "dim").groupBy("qid", "id").agg(F.sum(F.col("qval") * F.col("val")).alias("score")).where(F.col("score") >= least)


def linscan_topk(x: DataFrame, q: DataFrame, k: int) -> DataFrame:
    return topk(linscan(x, q), k)


def postings_touched(x: DataFrame, q: DataFrame) -> DataFrame:
    """(qid, n_dots): posting entries that each query reads, from posting lengths alone."""
    lengths = x.groupBy("dim").agg(F.count("*").alias("n"))
    return q.join(lengths, "dim").groupBy("qid").agg(F.sum("n").alias("n_dots"))


def naive_dots(x: DataFrame, q: DataFrame) -> DataFrame:
    """(qid, n_dots): every row for every query."""
    n = x.select("id").distinct().agg(F.count("*").alias("n_dots"))
    return q.select("qid").distinct().join(F.broadcast(n))  # one row


def selfjoin(x: DataFrame, least: int) -> DataFrame:
    """(qid, id, score) of all pairs qid < id at or over the threshold; values are not negative.

    A row's most frequent dimensions are left out of the join as long as all of them together, each times the largest value
    in it, stay below the threshold: a pair that shares no other dimension cannot reach it. So the postings that many rows
    have make no pairs; their part of the score is added for the pairs that can still reach the threshold.
    """
    stats = x.groupBy("dim").agg(F.count("*").alias("n"), F.max("val").alias("most")).where("n >= 2")
    hot_first = Window.partitionBy("id").orderBy(F.desc("n"), "dim").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.sum(F.col("val") * F.col("most")).over(hot_first)
    rows = x.join(stats, "dim").withColumn("reach", reach).withColumn("asks", F.col("reach") >= least)
    rows = cut(rows.select("id", "dim", "val", "asks", F.when(~F.col("asks"), F.col("reach")).alias("left")), "selfjoin")
    q = queries_of(rows.where("asks"))
    pairs = q.join(rows.select("id", "dim", "val"), "dim").where("qid < id").groupBy("qid", "id").agg(F.sum(F.col("qval") * F.col("val")).alias("part"))
    # what the left-out dimensions can add
    bounds = rows.groupBy(F.col("id").alias("qid")).agg(F.coalesce(F.max("left"), F.lit(0)).alias("more"))
    pairs = cut(pairs.join(bounds, "qid").where(F.col("part") + F.col("more") >= least).select("qid", "id", "part"), "pairs")
    rest = pairs.join(queries_of(rows.where("not asks")), "qid").join(rows.select("id", "dim", "val"), ["id", "dim"])
    rest = rest.groupBy("qid", "id").agg(F.sum(F.col("qval") * F.col("val")).alias("rest"))
    total = pairs.join(rest, ["qid", "id"], "left").select("qid", "id", (F.col("part") + F.coalesce("rest", F.lit(0))).alias("score"))
    return total.where(F.col("score") >= least)


def rerank(candidates: DataFrame, x: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """Top-k of given (qid, id) pairs by exact inner product; x is (id, v), q is (id, v)."""
    from vecgrove.functions.vectors import dot

    met = candidates.select("qid", "id").distinct().join(x, "id").join(q.select(F.col("id").alias("qid"), F.col("v").alias("w")), "qid")
    return topk(met.select("qid", "id", dot(F.col("v"), F.col("w"), "long").alias("score")), k)
