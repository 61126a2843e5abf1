"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.session import scratch_dir, shuffles_removed

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Batches of 1,000 rows to Python instead of Spark's default of 10,000, which take hundreds of MB of a worker where texts are long.

    A setting that the session's owner has chosen stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder: lineage ends here, a lost executor loses nothing, and shuffle files go with the writing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession, "checkpoints"))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def remainder(doc_id: str, divisor: int):
    """crc32 of an id's decimal text, modulo `divisor`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor
