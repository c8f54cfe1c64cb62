import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from costlake.operators import sync
from costlake.sources import versions

DAY = dt.date(2026, 3, 15)


@pytest.fixture
def charges(spark, make_costs, tmp_path):
    path = str(tmp_path / "charges")
    sync.write_charges(make_costs(
        ("a1", 2, "EC2", "r", "10"), ("a1", 1, "S3", "r", "20"), ("a1", 0, "EC2", "r", "30"), ("a2", 1, "VM", "r", "5"),
        ("a2", 40, "VM", "r", "7")), path)
    return path


def pull(spark, *rows):
    return spark.createDataFrame([(dt.datetime.combine(DAY - dt.timedelta(days=b), dt.time(1)), s, Decimal(a)) for b, s, a in rows],
                                 "date timestamp, service string, amount decimal(18,8)")


def window():
    return dt.datetime(2026, 3, 13), dt.datetime(2026, 3, 15, 23, 59, 59)


def total(spark, path):
    return {(r.cloud_account_id, r.usage_date): float(r.s) for r in sync.read_charges(spark, path).groupBy(
        "cloud_account_id", "usage_date").agg(F.sum("amount").alias("s")).collect()}


def test_days_change_together_and_old_readers_keep_what_they_saw(spark, charges):
    before = sync.read_charges(spark, charges)
    want = total(spark, charges)
    assert sync.import_charges(spark, charges, pull(spark, (1, "S3", 99)), "a1", *window()) == 1
    ago = lambda n: DAY - dt.timedelta(days=n)
    assert total(spark, charges) == {("a1", ago(1)): 99.0, ("a2", ago(1)): 5.0, ("a2", ago(40)): 7.0}
    assert sum(float(r.amount) for r in before.collect()) == sum(want.values())
    assert set(versions.current(spark, charges)[1]) == {ago(1), ago(40)}  # emptied days are gone
    assert versions.vacuum(spark, charges, keep=1) == 3
    assert len(total(spark, charges)) == 3


def test_a_writer_that_dies_before_publishing_changes_nothing(spark, charges, monkeypatch):
    want = total(spark, charges)
    monkeypatch.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        sync.import_charges(spark, charges, pull(spark, (1, "S3", 99)), "a1", *window())
    monkeypatch.undo()
    assert total(spark, charges) == want
    sync.import_charges(spark, charges, pull(spark, (1, "S3", 99)), "a1", *window())  # again: as if nothing had been
    assert total(spark, charges)[("a1", DAY - dt.timedelta(days=1))] == 99.0


def test_the_second_of_two_writers_is_refused(spark, charges):
    number, days = versions.current(spark, charges)
    versions.publish(spark, charges, days, number)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, charges, {}, number)
    assert versions.current(spark, charges) == (number + 1, days)


def test_an_empty_pull_publishes_nothing(spark, charges):
    assert sync.import_charges(spark, charges, pull(spark), "a1", *window()) == 0
    assert versions.current(spark, charges)[0] == 1


def test_rollup_reads_changed_days_only(spark, charges, tmp_path):
    rollup = str(tmp_path / "rollup")
    ago = lambda n: DAY - dt.timedelta(days=n)
    assert sync.refresh_rollup(spark, charges, rollup) == {ago(0), ago(1), ago(2), ago(40)}
    assert sync.refresh_rollup(spark, charges, rollup) == set()
    sync.import_charges(spark, charges, pull(spark, (1, "S3", 99)), "a1", *window())
    assert sync.refresh_rollup(spark, charges, rollup) == {ago(1)}
    got = {(r.usage_date, r.service): float(r.amount) for r in sync.read_rollup(spark, rollup).collect()}
    assert got == {(ago(1), "S3"): 99.0, (ago(1), "VM"): 5.0, (ago(40), "VM"): 7.0}


def test_months_instead_of_days(spark, make_costs, tmp_path):
    path, rollup = str(tmp_path / "months"), str(tmp_path / "rollup")
    sync.write_charges(make_costs(("a1", 2, "EC2", "r", "10"), ("a1", 0, "S3", "r", "20"), ("a2", 40, "VM", "r", "7")), path, "month")
    assert sync.refresh_rollup(spark, path, rollup) == {dt.date(2026, 2, 1), dt.date(2026, 3, 1)}
    sync.import_charges(spark, path, pull(spark, (1, "S3", 99)), "a1", dt.datetime(2026, 3, 14), dt.datetime(2026, 3, 15, 23, 59, 59), "month")
    assert sync.refresh_rollup(spark, path, rollup) == {dt.date(2026, 3, 1)}
    got = {(r.ds, r.service): float(r.amount) for r in sync.read_rollup(spark, rollup).collect()}
    ago = lambda n: DAY - dt.timedelta(days=n)
    assert got == {(ago(2), "EC2"): 10.0, (ago(1), "S3"): 99.0, (ago(40), "VM"): 7.0}


def test_filters_skip_folders(spark, charges):
    plan = sync.read_charges(spark, charges).where(F.col("usage_date") == DAY)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_date" in plan


def test_a_table_without_manifest_is_empty(spark, tmp_path):
    assert sync.read_charges(spark, str(tmp_path / "none")).count() == 0
