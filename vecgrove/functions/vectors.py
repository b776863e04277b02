"""Column expressions over vectors, hash words and maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast(kind), lambda s, p: s + p)


def squared_norm(v: Column) -> Column:
    return dot(v, v)


def l2_normalize(v: Column, eps: float = 1e-9) -> Column:
    """v over its length; vectors no longer than ``eps`` stay as they are."""
    n = F.sqrt(squared_norm(v))
    return F.when(n > eps, F.transform(v, lambda x: x / n)).otherwise(v)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def add_maps(a: Column, b: Column) -> Column:
    """Sum of two sparse vectors held as maps."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def add_sparse(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, dim, val): sums of the vectors with equal ids."""
    return a.unionByName(b).groupBy("id", "dim").agg(F.sum("val").alias("val"))


def dot_sparse(q: DataFrame, x: DataFrame) -> DataFrame:
    """(qid, id, score) of all pairs that share a dimension; q is (qid, dim, qval)."""
    return q.join(x, "dim").groupBy("qid", "id").agg(F.sum(F.col("qval") * F.col("val")).alias("score"))


def argmax(v: Column) -> Column:
    """First index of the largest component, from 0."""
    return F.array_position(v, F.array_max(v)) - 1


def close(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(a - b) < tolerance


def compare_sparse(a: DataFrame, b: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """(id, equal): whether the vectors with equal ids have the same dimensions and close values."""
    x, y = a.withColumnRenamed("val", "x"), b.withColumnRenamed("val", "y")
    same = F.coalesce(close(F.col("x").cast("double"), F.col("y").cast("double"), tolerance), F.lit(False))
    return x.join(y, ["id", "dim"], "full").groupBy("id").agg(F.bool_and(same).alias("equal"))


def equal_maps(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    """:func:`compare_sparse` for two maps of one row: whether they have the same keys and close values."""
    same = lambda k, x, y: F.coalesce(close(x.cast("double"), y.cast("double"), tolerance), F.lit(False))
    return F.forall(F.map_values(F.map_zip_with(a, b, same)), lambda s: s)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def pack_bits(bits: Column) -> Column:
    """A long from an array of 0/1, lowest bit first."""
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b.cast("long"))


def unpack_bits(word: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.pmod(F.floor(word / F.pow(F.lit(2.0), k.cast("double"))), F.lit(2)).cast("int"))


#: Factor, increment and shift of each step of the scramble.
_MIX = ((1103515245, 12345, 15), (1103515245, 12345, 13), (747796405, 2891, 0))


def mix(k: Column) -> Column:
    """A fixed scramble of a non-negative long into 31 bits, in integer arithmetic that any SQL engine repeats."""
    k = k % F.lit(1 << 31).cast("long")
    for mul, inc, shift in _MIX:
        k = (k * F.lit(mul).cast("long") + F.lit(inc).cast("long")) % F.lit(1 << 31).cast("long")
        k = k.bitwiseXOR(F.shiftright(k, shift)) if shift else k
    return k


def mix_numpy(k: np.ndarray) -> np.ndarray:
    """The same over numpy longs."""
    k = k % (1 << 31)
    for mul, inc, shift in _MIX:
        k = (k * mul + inc) % (1 << 31)
        k = k ^ (k >> shift) if shift else k
    return k
