"""Stored tables: partitioning, pruning, retention."""

from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from telespark.operators import latest
from telespark.sources import fixtures, tables
from telespark.sources.versions import Conflict, Versions

SF = "/root/testdata/sf0.001"
AS_OF = fixtures.AS_OF + timedelta(hours=23, minutes=30)


@pytest.fixture
def stored(spark, sf, tmp_path):
    rows = fixtures.telemetry(spark, sf)
    older = rows.withColumns({"id": -F.col("id") - 1, "timestamp": F.col("timestamp") - F.expr("INTERVAL 3 DAYS")})
    path = str(tmp_path / "telemetry")
    tables.append_telemetry(rows.unionByName(older), path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recent_scan_prunes_days_and_pushes_filters(spark, stored):
    df = latest.recent_since(tables.read_telemetry(spark, stored), fixtures.AS_OF, 900).select("robot_id", "battery")
    text = plan(df)
    partition_filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "dt" in partition_filters
    assert "GreaterThan(timestamp," in text.split("PushedFilters: [")[1]
    assert "ReadSchema: struct<robot_id:int,battery:double,timestamp:timestamp>" in text


def test_retention_in_place(spark, stored):
    before = tables.read_telemetry(spark, stored).count()
    cutoff = AS_OF - timedelta(days=1)
    deleted = tables.retention_job(spark, stored, AS_OF)
    left = tables.read_telemetry(spark, stored)
    assert left.count() == before - deleted
    assert left.filter(F.col("timestamp") < F.lit(cutoff)).count() == 0
    assert [str(r.dt) for r in left.select("dt").distinct().collect()] == ["2024-01-01"]
    assert tables.retention_job(spark, stored, AS_OF) == 0


def test_retention_may_empty_the_boundary_day(spark, stored):
    assert tables.retention_job(spark, stored, AS_OF + timedelta(hours=10)) == 2000
    assert tables.read_telemetry(spark, stored).count() == 0
    assert Versions(spark, stored).vacuum(keep_versions=1, min_age_seconds=0) > 0
    assert not list(Path(stored).glob("dt=*"))


def test_limits(spark, sf):
    rows = fixtures.telemetry(spark, sf)
    ids = [r.id for r in tables.recent_telemetry(rows, limit=500).collect()]
    assert ids == list(range(999, 499, -1))
    with pytest.raises(ValueError):
        tables.recent_events(rows, limit=-1)
    with pytest.raises(ValueError):
        tables.recent_events(rows, limit=10, skip=-1)


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_formats_round_trip(spark, sf, tmp_path, fmt):
    commands = fixtures.commands(spark, sf)
    path = str(tmp_path / fmt)
    commands.write.format(fmt).save(path)
    back = tables.read_commands(spark, path, fmt).select(*commands.columns)
    assert back.exceptAll(commands).count() == 0 and back.count() == commands.count()


def test_events_get_the_server_time(spark, tmp_path):
    events = spark.createDataFrame([(1, 5, "Entered zone")], "id int, robot_id int, message string")
    now = datetime(2026, 7, 22, 1, tzinfo=timezone.utc)
    tables.append_events(events, str(tmp_path / "e"), now)
    row = tables.read_events(spark, str(tmp_path / "e")).selectExpr("unix_seconds(timestamp) AS s", "cast(dt AS string) AS dt").first()
    assert (row.s, row.dt) == (int(now.timestamp()), "2026-07-22")


def rows_of(df):
    return sorted(map(str, df.select("id", "robot_id", "battery", "timestamp").collect()))


def test_many_appends_compact_into_a_few_files(spark, sf, tmp_path):
    rows, path = fixtures.telemetry(spark, sf), str(tmp_path / "t")
    for i in range(12):
        tables.append_telemetry(rows.where(F.col("id") % 12 == i).withColumn("timestamp", F.col("timestamp") - F.expr(f"INTERVAL {i % 3} DAYS")), path)
    store = Versions(spark, path)
    before, reader = rows_of(tables.read_telemetry(spark, path)), tables.read_telemetry(spark, path)
    many = len(store.version().folders)
    assert tables.compact(spark, path, date(2024, 1, 1)) == 8  # the open day stays in parts
    assert len(store.version().folders) == many - 8 + 2
    assert tables.compact(spark, path, date(2024, 1, 2)) == many - 8
    assert len(store.version().folders) == 3 and len(list(Path(path).glob("dt=2024-01-01/*/*.parquet"))) > 1
    assert tables.compact(spark, path, date(2024, 1, 2)) == 0
    assert rows_of(tables.read_telemetry(spark, path)) == before == rows_of(reader)
    assert Versions(spark, path).vacuum(keep_versions=1, min_age_seconds=0) == many
    assert rows_of(tables.read_telemetry(spark, path)) == before
    assert len(list(Path(path).glob("dt=*/*/*.parquet"))) <= 6


def test_readers_keep_their_version(spark, stored):
    reader, before = tables.read_telemetry(spark, stored), tables.read_telemetry(spark, stored).count()
    number = Versions(spark, stored).version().number
    tables.retention_job(spark, stored, AS_OF)
    assert reader.count() == before > tables.read_telemetry(spark, stored).count()
    assert tables.read_telemetry(spark, stored, version=number).count() == before


@pytest.mark.parametrize("step", ["write", "_publish"])
@pytest.mark.parametrize("job", [lambda s, p: tables.retention_job(s, p, AS_OF), lambda s, p: tables.compact(s, p, date(2024, 1, 9)), lambda s, p: tables.append_telemetry(fixtures.telemetry(s, SF), p)])
def test_a_crash_at_any_step_changes_nothing(spark, stored, monkeypatch, step, job):
    tables.append_telemetry(fixtures.telemetry(spark, SF).limit(10), stored)
    before = rows_of(tables.read_telemetry(spark, stored))
    real = getattr(Versions, step)

    def crash(self, *args, **kwargs):
        if step == "write":
            real(self, *args, **kwargs)  # the files are there, the version is not
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Versions, step, crash)
        with pytest.raises(OSError):
            job(spark, stored)
    assert rows_of(tables.read_telemetry(spark, stored)) == before
    job(spark, stored)
    assert rows_of(tables.read_telemetry(spark, stored)) != before or Versions(spark, stored).version().number > 2


def test_commits_of_two_jobs(spark, stored):
    """A change that meets another one's is redone or refused, never lost."""
    one, two = Versions(spark, stored), Versions(spark, stored)
    folders = one.version().folders
    rows = fixtures.telemetry(spark, SF).limit(5).withColumn("dt", F.to_date("timestamp"))
    mine = one.write(rows, "", "dt")
    two.commit(remove=folders[:1])
    one.commit(mine)
    assert set(one.version().folders) == {*folders[1:], *mine}
    with pytest.raises(Conflict):
        one.commit(remove=folders[:1])
    assert one.commit(writer="w", batch=3) and not two.commit(mine, writer="w", batch=3) and not two.commit(writer="w", batch=2)
    assert one.committed("w", 3) and not one.committed("w", 4) and not one.committed("v", 0)


def test_retention_starts_again_after_a_conflict(spark, stored, monkeypatch):
    real, calls = Versions.commit, []

    def commit(self, *args, **kwargs):
        calls.append(args)
        if len(calls) == 1:
            raise Conflict("once")
        return real(self, *args, **kwargs)

    monkeypatch.setattr(Versions, "commit", commit)
    assert tables.retention_job(spark, stored, AS_OF) > 0 and len(calls) == 2
