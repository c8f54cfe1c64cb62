"""Every registered query against its SQL twin, and the driver's entry points."""

import pytest

import __spark_entry__ as entry_points
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.database(SF)


OWN = [n for n in entry_points.queries() if n != "pipeline" and not n.startswith("op")]  # the others: tests/llm


@pytest.mark.parametrize("name", OWN)
def test_query_matches_its_sql(spark, con, name):
    verdict, rows, _ = check.compare(spark, con, name, SF)
    assert verdict in ("ok", "rows only"), verdict


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["ds", "amount", "change_percent", "predicted"] and df.count() == 365


def test_only_stateful_or_random_queries_lack_sql():
    missing = set(entry_points.queries()) - set(entry_points.oracle_sql())
    trained = {f"op{n}_" for n in (1, 3, 5, 6, 7, 8, 9, 10, 12, 13)}
    assert {m for m in missing if m[:m.find("_") + 1] not in trained} - {"pipeline"} == {"isolation_forest", "saved_forest"}
