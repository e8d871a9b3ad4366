"""Tables that are kept between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, as in tests, one is made, but only for a local master: on a cluster each
    executor would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="tallyweave-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, so that what follows reads it and a lost executor costs no more than its
    own tasks. The files go with drop(), or else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = _path(spark, path)
    files.deleteOnExit(target)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables from written() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            files, target = _path(df.sparkSession, path)
            files.delete(target, True)
