"""Appending rows to live indexes with Structured Streaming: pool sums merge, results are re-queried.

A batch is written under its batch id, so a repeated batch replaces itself and the index is the merge of all batches:
recovery needs no state but the files. Compaction folds many batches into one.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.materialise import new_path
from vecgrove.operators import pools
from vecgrove.types import to_long


class PoolIndex:
    """Rows and pool sums in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, levels: int):
        self.spark, self.path, self.levels = spark, path, levels

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add (id, dim, val) rows as one batch; adding it again changes nothing."""
        batch.write.mode("overwrite").parquet(os.path.join(self.path, "rows", f"batch={batch_id}"))
        mine = self.spark.read.parquet(os.path.join(self.path, "rows", f"batch={batch_id}"))
        pools.tree_sums(mine, self.levels).write.mode("overwrite").parquet(os.path.join(self.path, "sums", f"batch={batch_id}"))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, "rows")).drop("batch")

    def sums(self) -> DataFrame:
        """Sums of all rows: nodes that several batches touch are added up."""
        s = self.spark.read.parquet(os.path.join(self.path, "sums")).drop("batch")
        return s.groupBy("tree", "level", "node", "dim").agg(F.sum("val").alias("val"))

    def compact(self, target: str) -> "PoolIndex":
        """A copy in ``target`` with all batches folded into batch 0."""
        out = PoolIndex(self.spark, target, self.levels)
        self.rows().write.mode("overwrite").parquet(os.path.join(target, "rows", "batch=0"))
        self.sums().write.mode("overwrite").parquet(os.path.join(target, "sums", "batch=0"))
        return out

    def follow(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        """Start a query that appends every micro-batch of ``stream``."""
        writer = stream.writeStream.foreachBatch(lambda df, n: self.append(df, n)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def reordered_batch(batch: DataFrame, order: DataFrame, first_pool: int, size: int) -> DataFrame:
    """A micro-batch laid out in fresh pools, in the order of largest components: earlier pools are never rebuilt."""
    return batch.join(order.select("id", "pos"), "id").withColumn("pos", F.col("pos") + first_pool * size)


#: Pools that a micro-batch may take before its positions reach those of the next.
BATCH_POOLS = 1 << 30


class ReorderedIndex(PoolIndex):
    """The same over dense rows (id, v): each micro-batch is laid out by largest component, in pools of its own."""

    def append(self, batch: DataFrame, batch_id: int) -> None:
        size = 1 << self.levels
        laid = reordered_batch(to_long(batch), pools.reorder(batch), batch_id * BATCH_POOLS, size)
        super().append(laid, batch_id)


def followed(spark: SparkSession, source: str, shape, levels: int, reordered: bool = False) -> PoolIndex:
    """Index a Parquet table as a stream of its files until all are read; ``shape`` turns rows into (id, dim, val).

    ``reordered`` takes rows as (id, v) and lays each micro-batch out by largest component.
    """
    path = new_path(spark, "stream")
    schema = spark.read.parquet(source).schema
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    # a table is a folder of files, or one file of its folder
    root, glob = (source, "*.parquet") if folder else source.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", glob).parquet(root)
    index = (ReorderedIndex if reordered else PoolIndex)(spark, path, levels)
    query = index.follow(shape(stream), f"{path}/log")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return index
