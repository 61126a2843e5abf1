"""Stored tables: fixed-schema reads, partitioned appends, retention."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark import schemas
from telespark.operators.decode import stamp_ingest_time
from telespark.operators.status import page
from telespark.sources.versions import Conflict, Folder, Version, Versions

FORMATS = ("parquet", "json", "orc", "csv")


def _read(spark: SparkSession, schema, path: str, fmt: str) -> DataFrame:
    if fmt not in FORMATS:
        return spark.read.format(fmt).load(path)
    return spark.read.schema(schema).format(fmt).load(path)


def read_telemetry(spark: SparkSession, path: str, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """The telemetry table, as append_telemetry and stream ingest write it; `dt` is its day partition.

    Of a table in versions one version is read, the newest unless another is given; later changes don't show. Other folders are read as they are.
    """
    if fmt == "parquet":
        store = Versions(spark, path)
        known = store.version(version)
        if known.number:
            return store.read("", schemas.TELEMETRY, "dt", "date", known).drop("commit")
    schema = type(schemas.TELEMETRY)(list(schemas.TELEMETRY.fields)).add("dt", "date")
    return _read(spark, schema, path, fmt)


def read_ingested(spark: SparkSession, root: str, table: str = "telemetry", version: int | None = None) -> DataFrame:
    """A table that stream ingest keeps below its root: telemetry, events, commands, rejects, metrics or message_ids. One version for all of them."""
    schema, part, kind = schemas.INGESTED[table]
    store = Versions(spark, root)
    return store.read(table, schema, part, kind, store.version(version)).drop("commit")


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    schema = type(schemas.EVENTS)(list(schemas.EVENTS.fields)).add("dt", "date")
    return _read(spark, schema, path, fmt)


def read_commands(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, schemas.COMMANDS, path, fmt)


def _append_by_day(df: DataFrame, path: str, ts: str) -> None:
    # Rebalancing gathers each day into files of the advisory size: small ones merge, a day that
    # holds most rows is split over many writers.
    daily = df.withColumn("dt", F.to_date(ts)).hint("rebalance", "dt")
    daily.sortWithinPartitions("dt", "robot_id", ts).write.mode("append").partitionBy("dt").parquet(path)


def sorted_days(df: DataFrame) -> DataFrame:
    """Days gathered into files of the advisory size, in order of hour, robot and time: row groups of other hours are skipped by
    a recent window, and robots stay together within one."""
    return df.hint("rebalance", "dt").sortWithinPartitions("dt", F.date_trunc("hour", "timestamp"), "robot_id", "timestamp")


def append_telemetry(df: DataFrame, path: str) -> None:
    """Bulk append: readers see all rows of it or none."""
    store = Versions(df.sparkSession, path)
    store.commit(store.write(sorted_days(df.withColumn("dt", F.to_date("timestamp"))), "", "dt"))


def append_events(df: DataFrame, path: str, as_of=None) -> None:
    """Append events; rows without a time get the server's."""
    if "timestamp" not in df.columns:
        df = stamp_ingest_time(df, as_of)
    _append_by_day(df, path, "timestamp")


def expired_rows(df: DataFrame, as_of: datetime, days: int = 1) -> DataFrame:
    return df.filter(F.col("timestamp") < F.lit(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY"))


def kept_rows(df: DataFrame, as_of: datetime, days: int = 1) -> DataFrame:
    return df.filter(F.col("timestamp") >= F.lit(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY"))


def prune_telemetry(df: DataFrame, as_of: datetime, days: int = 1) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of the deleted ones); a kept row is no older than the cutoff."""
    deleted = expired_rows(df, as_of, days).agg(F.count(F.lit(1)).alias("deleted"))
    return kept_rows(df, as_of, days), deleted


def retention_job(spark: SparkSession, path: str, as_of: datetime, days: int = 1, table: str = "") -> int:
    """Prunes a stored table (`table`: telemetry or events below an ingest root) and returns the number of deleted rows.

    Whole days before the cutoff leave the version without being read (but for their row counts, which come from file footers).
    Of the cutoff's own day, all commits are rewritten as one if any of their rows has expired. One commit publishes
    everything: a failed run leaves the table as it was, running readers keep their version, and what ingest adds meanwhile stays. Files go with `vacuum`.
    """
    store = Versions(spark, path)
    while True:
        try:
            return _prune(store, as_of, days, table)
        except Conflict:
            continue  # compaction has replaced folders of those days


def _prune(store: Versions, as_of: datetime, days: int, table: str) -> int:
    cutoff = as_of - timedelta(days=days)
    version, boundary = store.version(), cutoff.date().isoformat()
    schema = schemas.INGESTED[table][0] if table else schemas.TELEMETRY
    old = [f for f in version.of(table) if f.part < boundary]
    partly = [f for f in version.of(table) if f.part == boundary]
    read = lambda folders: store.read(table, schema, "dt", "date", Version(version.number, folders))
    deleted = read(old).count() if old else 0
    add: list[Folder] = []
    if partly:
        rows = read(partly).drop("commit")
        expired = expired_rows(rows, as_of, days).count()
        deleted += expired
        if expired:
            add = store.write(sorted_days(kept_rows(rows, as_of, days)), table, "dt")
        else:
            partly = []
    if old or partly:
        store.commit(add, [*old, *partly])
    return deleted


def drop_days(spark: SparkSession, root: str, table: str, before: date) -> int:
    """Takes the folders of days before one out of a table below an ingest root, whole: rejects, commands, metrics, or message ids by their day of arrival. Returns their number."""
    store = Versions(spark, root)
    while True:
        old = [f for f in store.version().of(table) if f.day < before.isoformat()]
        try:
            if old:
                store.commit(remove=old)
            return len(old)
        except Conflict:
            continue


def compact(spark: SparkSession, path: str, before: date, table: str = "") -> int:
    """Rewrites the folders of each part that closed before a day as one commit, and returns how many folders it replaced.

    `table`: one below an ingest root. Parts with one folder stay as they are. Rows do not change; readers and ingest go on meanwhile. Folders that
    retention takes at the same time leave the rest to the next run.
    """
    schema, part, kind = schemas.INGESTED[table] if table else (schemas.TELEMETRY, "dt", "date")
    store = Versions(spark, path)
    version = store.version()
    closed = [f for f in version.of(table) if f.day < before.isoformat()]
    many = {value for value, n in Counter(f.part for f in closed).items() if n > 1}
    folders = [f for f in closed if f.part in many]
    if not folders:
        return 0
    rows = store.read(table, schema, part, kind, Version(version.number, folders)).drop("commit")
    by_day = "timestamp" in rows.columns and part == "dt"
    made = store.write(sorted_days(rows) if by_day else rows.hint("rebalance", part).sortWithinPartitions(part, rows.columns[0]), table, part)
    newest = {value: max(f.day for f in folders if f.part == value) for value in many}
    try:
        store.commit([replace(f, day=newest[f.part]) for f in made], folders)
    except Conflict:
        return 0
    return len(folders)


def recent_telemetry(df: DataFrame, limit: int | None = None, skip: int = 0) -> DataFrame:
    """Rows by id, newest first: all, or one page."""
    return page(df.orderBy(F.desc("id")), skip, limit)


def recent_events(df: DataFrame, limit: int | None = None, skip: int = 0) -> DataFrame:
    """Events, newest first: all, or one page."""
    return page(df.orderBy(F.desc("timestamp"), F.desc("id")), skip, limit)


def telemetry_ordered(df: DataFrame, limit: int | None = None) -> DataFrame:
    return page(df.orderBy("timestamp", "id"), 0, limit)
