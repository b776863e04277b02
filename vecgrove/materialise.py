"""Tables that cut lineage: written once in the folder that all executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="vecgrove-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark)}/vecgrove/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``localCheckpoint`` this survives lost executors, and unlike ``checkpoint`` the copy is columnar and
    compressed. The copy goes when the session's process ends, or with :func:`drop_cut`.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def moved_once(df: DataFrame) -> DataFrame:
    """``df`` for several jobs: all of them read the shuffle files that the first one wrote, and no second copy is made of them.

    Spark skips a stage only if a later job has the same RDD, not if it has the same plan. The lineage stays, so files of a lost
    executor are made again.
    """
    spark, jdf = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a table from :func:`cut` that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended; its folder goes with it
        pass
