"""Intermediate tables in the folder that all executors share, so that nothing is run again for each use, or when an executor is lost."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What a Python step holds at once as objects: rows, and bytes of their columns.
PIECE_ROWS, PIECE_BYTES = 1024, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset and all runs on one machine, as in tests, one of our own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellumix-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows of df, written once as a table in the shared folder and read from there. checkpoint() would run the last stage twice."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by cut() that nothing reads any more."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more: it does so when the driver's JVM collects its garbage, which in a long loop is late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks(spark: SparkSession) -> int:
    """Into how many tasks rows go that Python works on: several for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(docs: DataFrame, *by: str) -> DataFrame:
    """The rows over all cores, by the hash of columns, where files alone would give fewer tasks than that: a scan makes tasks by bytes, and a row group isn't split, however long Python works on its rows."""
    plan = docs._jdf.queryExecution().executedPlan()
    if "FileScan" not in plan.toString() or plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # what was shuffled is over all cores
        return docs
    if docs._jdf.queryExecution().toRdd().getNumPartitions() >= 2 * docs.sparkSession.sparkContext.defaultParallelism:
        return docs
    return docs.repartition(tasks(docs.sparkSession), *by)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of some PIECE_BYTES and at most PIECE_ROWS rows."""
    for batch in batches:
        step = max(1, min(PIECE_ROWS, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
