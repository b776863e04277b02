"""One hash filter for each pool and signature bit, over the items of the pool that have the bit."""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.functions.signatures import xor_words
from vecgrove.functions.vectors import mix_numpy
from vecgrove.operators.grouptest import Design, fitting
from vecgrove.shipping import ship

_KEYS = "test long, h long"


@lru_cache(64)
def _planes(pool: int, length: int, hashes: int, word: int, dims: int, seed: int) -> np.ndarray:
    """(length * hashes * word) x dims of +1 and -1: the hash functions of all tests of a pool."""
    each = length * hashes * word * dims
    k = np.arange(each, dtype=np.int64) + pool * each + seed
    return ((mix_numpy(k) >> 30) * 2 - 1).reshape(-1, dims).astype(np.float64)


def _words(v: np.ndarray, pool: int, length: int, hashes: int, word: int, seed: int) -> np.ndarray:
    """Rows x tests x hashes."""
    p = _planes(pool, length, hashes, word, v.shape[1], seed)
    return ((v @ p.T >= 0).reshape(len(v), length, hashes, word) << np.arange(word)).sum(axis=3)


def _keys(pool: int, words: np.ndarray, row: np.ndarray, bit: np.ndarray, chosen: list[tuple[int, ...]], word: int):
    """Keys of each (row, bit) and choice of hashes: the test, the choice, and the chosen words as one number."""
    length = words.shape[1]
    test = (pool * length + bit) * len(chosen)
    own = words[row, bit]
    for c, hashes in enumerate(chosen):
        h = np.zeros(len(row), np.int64)
        for j in hashes:
            h = (h << word) | own[:, j]
        yield test + c, h


def positive_tests(x: DataFrame, q: DataFrame, design: Design, dims: int, bits: int, hashes: int = 2, word: int = 6, least: int = 2, seed: int = 7) -> DataFrame:
    """(qid, pool, pos): the signature bits that some item of the pool with that bit has, of those that match the query.

    An item matches a test if at least ``least`` of the test's own ``hashes`` words are the query's. An item takes part in
    the tests of its own pools only. Items are not told apart: with each choice of ``least`` hashes the words are one key,
    and a filter is the set of its items' keys, which has no more than 2^(word x least) of them however many items there are.
    """
    ship(x.sparkSession)
    length = 3 * (2 * bits + 1)
    chosen = list(itertools.combinations(range(hashes), least))

    def matrix(b):
        return b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)

    def index(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = matrix(b)
            homes, sig = design.homes(ids), xor_words(ids, bits).astype(bool)
            for pool in np.unique(homes).tolist():
                own = np.flatnonzero((homes == pool).any(axis=1))
                row, bit = np.nonzero(sig[own])
                for test, h in _keys(pool, _words(v[own], pool, length, hashes, word, seed), row, bit, chosen, word):
                    test, h = np.unique(np.stack((test, h)), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(test), pa.array(h)], names=["test", "h"])

    def ask(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = matrix(b)
            row, bit = (a.ravel() for a in np.indices((len(ids), length)))
            for pool in range(design.n_pools):
                for test, h in _keys(pool, _words(v, pool, length, hashes, word, seed), row, bit, chosen, word):
                    yield pa.RecordBatch.from_arrays([pa.array(test), pa.array(h), pa.array(ids[row])], names=["test", "h", "qid"])

    items = fitting(x, bits, "id").select("id", "v").mapInArrow(index, _KEYS).distinct()
    asks = q.select("id", "v").mapInArrow(ask, f"{_KEYS}, qid long")
    met = asks.join(items, ["test", "h"]).withColumn("test", F.floor(F.col("test") / len(chosen)).cast("long"))
    some = met.select("qid", "test")
    if len(chosen) > 1:
        some = some.distinct()
    return some.select("qid", F.floor(F.col("test") / length).cast("long").alias("pool"), F.pmod("test", F.lit(length)).alias("pos"))


def residuals(positive: DataFrame, bits: int) -> DataFrame:
    """(qid, pool, sig): the positive tests of each pool as one measurement."""
    ones = positive.groupBy("qid", "pool").agg(F.collect_set("pos").alias("ones"))  # at most the bits of a signature
    at = F.sequence(F.lit(0).cast("long"), F.lit(3 * (2 * bits + 1) - 1).cast("long"))
    return ones.select("qid", "pool", F.transform(at, lambda k: F.array_contains("ones", k).cast("int")).alias("sig"))
