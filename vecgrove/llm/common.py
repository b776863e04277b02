"""Shared helpers: reading tables, cutting lineage in the shared folder, text batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.materialise import cut, drop_cut  # noqa: F401
from vecgrove.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_text(col):
    """Unsigned CRC-32 of the UTF-8 bytes; of no bytes for null."""
    return F.crc32(F.encode(F.coalesce(col, F.lit("")), "UTF-8"))


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with this package importable on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches, rows: int = 1000):
    """The same rows in batches of at most ``rows``: bounds what a worker holds as Python objects."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def share(spark: SparkSession, value):
    """Broadcast a value whose size its caller bounds."""
    ship(spark)
    return spark.sparkContext.broadcast(value)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of tables that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Places of a filter, as powers of two: 1 MB at least, 32 MB at most.
FILTER_BITS = (23, 28)


def bitmap(keys: DataFrame, bits: int | None = None) -> bytes:
    """A set of 2^bits places that holds at least those of the longs in ``keys(key)``: eight places a key, within FILTER_BITS.

    It saves moving rows that no key asks for; rows that it lets through wrongly meet an exact join afterwards, so a set
    too full costs time alone.
    """
    bits = bits or min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * keys.count()).bit_length()))
    place = (F.pmod(F.col("key"), F.lit(1 << bits)) + 1).alias("p")
    rows = keys.select(place).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = bytearray((1 << bits) // 8)
    for r in rows:  # buckets count from 1 and hold 32768 bits
        at = (r["b"] - 1) * 4096
        for k, x in enumerate(r["m"]):
            out[at + k] |= x
    return bytes(out)


def in_bitmap(places: bytes, keys):
    """Which of the longs in a numpy array are in the set."""
    import numpy as np

    p = keys % (8 * len(places))
    return (np.frombuffer(places, np.uint8)[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
