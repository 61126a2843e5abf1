"""Session-level settings shared by every job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on. Sizing (partitions, memory) is left to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of repeated keys counts
    return spark


def prepare_streaming(spark: SparkSession) -> SparkSession:
    """State lives in RocksDB so that it is bounded by disk, not by executor heap."""
    prepare(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for written intermediates, under the cluster's shared checkpoint folder.

    A machine-local folder is only acceptable where driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="telespark-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is made and run in here leaves no shuffle files behind, which otherwise wait for the driver's garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a written table: computed once, and not lost with an executor. Its shuffle files go with the writing."""
    path = scratch_dir(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(df: DataFrame) -> None:
    """Deletes the files of a table that `write_and_read` has returned, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)
