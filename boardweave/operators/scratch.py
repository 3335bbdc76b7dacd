"""Intermediate tables in the folder that all executors share."""

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder; on a cluster that is an error, as each executor
    would write to a disk of its own and rows would be lost without a word.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="boardweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/boardweave-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables made by written() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(table.at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps; else they stay until the driver happens to collect its garbage.

    The second time is for what the events of the last step still held the first time.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
