"""Tables in storage that all nodes share: where a plan is cut so that later stages start from files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share: spark.checkpoint.dir, or a temporary one of our own where it is unset and all is on one machine (tests)."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("seqloom.shared.dir", None)
    if not path:
        if not conf.get("spark.master", "local").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("seqloom.shared.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later stages start from files that survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


ARROW_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """df as it is; its session then hands whole texts to Python by ARROW_ROWS, unless it has a setting of its own.

    Spark's default of 10,000 rows makes batches of texts that cost each executor several hundred MB outside its heap.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) == 10_000:
        conf.set(key, ARROW_ROWS)
    return df
