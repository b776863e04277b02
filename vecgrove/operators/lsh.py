"""Sign-random-projection hashes in many tables, and joins by the number of equal tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.functions.vectors import mix_numpy
from vecgrove.operators.exact import Best, _scan, reaching, topk
from vecgrove.shipping import ship


def planes(tables: int, bits: int, dims: int, seed: int = 7) -> np.ndarray:
    """tables x bits x dims of +1 and -1: hash sums of whole-number vectors are exact."""
    k = np.arange(tables * bits * dims, dtype=np.int64) + seed
    return ((mix_numpy(k) >> 30) * 2 - 1).reshape(tables, bits, dims).astype(np.float64)


def hashes(x: DataFrame, tables: int, bits: int, dims: int, seed: int = 7) -> DataFrame:
    """(id, hashes): one word of ``bits`` bits for each table; a bit is set if the projection is not negative."""
    ship(x.sparkSession)

    def run(batches):
        p = planes(tables, bits, dims, seed).reshape(tables * bits, dims)
        weights = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            n = b.num_rows
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
            h = ((v @ p.T >= 0).reshape(n, tables, bits) * weights).sum(axis=2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(h), pa.list_(pa.int64()))], names=["id", "hashes"])

    return x.select("id", "v").mapInArrow(run, "id long, hashes array<long>")


def tables(hashed: DataFrame) -> DataFrame:
    """Inverted index: (tbl, h, id)."""
    return hashed.select("id", F.posexplode("hashes").alias("tbl", "h")).select(F.col("tbl").cast("long").alias("tbl"), "h", "id")


def match_counts(x: DataFrame, q: DataFrame) -> DataFrame:
    """(qid, id, n_match) of all pairs with an equal table; x and q are (tbl, h, id)."""
    return q.withColumnRenamed("id", "qid").join(x, ["tbl", "h"]).groupBy("qid", "id").agg(F.count("*").alias("n_match"))


def equal_words(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rows x queries: tables in which both have the same word."""
    n = np.zeros((len(v), len(m)), np.int16)
    for t in range(v.shape[1]):
        n += v[:, t, None] == m[None, :, t]
    return n


def near_words(distance: int):
    """The same for words that differ in at most ``distance`` bits."""

    def score(v, m):
        v, m = v.astype(np.int64), m.astype(np.int64)
        n = np.zeros((len(v), len(m)), np.int16)
        for t in range(v.shape[1]):
            n += np.bitwise_count(v[:, t, None] ^ m[None, :, t]) <= distance
        return n

    return score


def _scored(hx: DataFrame, hq: DataFrame, make, score=equal_words, fold=None) -> DataFrame:
    """Words (id, hashes) of rows against words of queries, block by block: a pair's tables are counted where its row is, so
    no pair moves before it is counted. With words of few bits a bucket holds a fixed share of the rows, and a join by bucket
    would move all of its pairs once a table."""
    shape = lambda h: h.select("id", F.col("hashes").alias("v"))
    return _scan(shape(hx), shape(hq), make, score=score, fold=fold)


def scan_candidates(hx: DataFrame, hq: DataFrame, least: int = 1) -> DataFrame:
    """(qid, id, n_match) of all pairs with at least ``least`` equal tables."""
    return _scored(hx, hq, reaching(least)).withColumnRenamed("score", "n_match")


def scan_hamming(hx: DataFrame, hq: DataFrame, distance: int, least: int) -> DataFrame:
    """The same, where tables count whose words differ in at most ``distance`` bits."""
    return _scored(hx, hq, reaching(least), near_words(distance)).withColumnRenamed("score", "n_match")


def scan_knn(hx: DataFrame, hq: DataFrame, k: int) -> DataFrame:
    """:func:`hash_knn` of words: a task sends the k best rows of each query."""
    return topk(_scored(hx, hq, None, fold=lambda qids: Best(qids, k, 1)), k)


def candidates(x: DataFrame, q: DataFrame, least: int) -> DataFrame:
    return match_counts(x, q).where(F.col("n_match") >= least)


def hamming_candidates(x: DataFrame, q: DataFrame, bits: int, distance: int, least: int) -> DataFrame:
    """(qid, id, n_match): tables whose words differ in at most ``distance`` bits count.

    A query's word is expanded into the words within that distance (a ball of fixed size), so the join stays an equality.
    """
    import itertools

    masks = [sum(1 << b for b in c) for d in range(distance + 1) for c in itertools.combinations(range(bits), d)]
    near = q.withColumn("m", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).select("id", "tbl", F.col("h").bitwiseXOR(F.col("m")).alias("h"))
    return match_counts(x, near).where(F.col("n_match") >= least)


def hash_knn(x: DataFrame, q: DataFrame, k: int, least: int = 1) -> DataFrame:
    """Top-k by the number of equal tables; ties go to the larger id."""
    return topk(candidates(x, q, least).select("qid", "id", F.col("n_match").alias("score")), k)


def index_stats(x: DataFrame) -> DataFrame:
    """(tbl, n_buckets, n_items, largest) of each table."""
    b = x.groupBy("tbl", "h").agg(F.count("*").alias("n"))
    return b.groupBy("tbl").agg(F.count("*").alias("n_buckets"), F.sum("n").alias("n_items"), F.max("n").alias("largest"))


def pool_neighbours(x: DataFrame, q: DataFrame, edges: DataFrame, pool: int, least: int) -> DataFrame:
    """(qid, id, n_match) within one pool; x and q are (id, hashes)."""
    members = edges.where(F.col("pool") == pool).select(F.col("item").alias("id"))
    return scan_candidates(x.join(members, "id", "left_semi"), q, least)


def positive_pools(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, pool): pools with a member among the query's candidates (inclusive or)."""
    return found.select("qid", F.col("id").alias("item")).join(edges, "item").select("qid", "pool").distinct()
