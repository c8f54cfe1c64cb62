import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from costlake import schemas  # noqa: E402

NOW = dt.datetime(2026, 3, 15, 18, 30)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").appName("costlake-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(shared)).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def accounts(spark):
    rows = [
        ("a1", "org", "aws", "123456789012", "Test AWS Account", "platform", "prod", None, True, NOW),
        ("a2", "org", "gcp", "my-project", "Finance", "finance", None, "cc-1", True, NOW),
        ("a3", "other", "azure", "sub-1", "Other", None, None, None, False, NOW),
    ]
    return spark.createDataFrame(rows, schemas.CLOUD_ACCOUNTS)


@pytest.fixture(scope="session")
def make_costs(spark):
    def make(*rows):
        """(account, days before NOW, service, region, amount) with optional granularity and tags."""
        full = []
        for i, row in enumerate(rows):
            account, back, service, region, amount, *rest = row
            granularity = rest[0] if rest else "daily"
            tags = rest[1] if len(rest) > 1 else None
            full.append((f"r{i}", account, NOW - dt.timedelta(days=back), granularity, service, region,
                         None, Decimal(amount), "USD", tags, None))
        return spark.createDataFrame(full, schemas.COST_RECORDS)

    return make


@pytest.fixture(scope="session")
def records(make_costs):
    return make_costs(
        ("a1", 2, "Amazon EC2", "us-east-1", "100.00"),
        ("a1", 1, "Amazon S3", "us-west-2", "50.00"),
        ("a1", 0, "Amazon EC2", "us-east-1", "75.00"),
        ("a2", 1, "Compute", None, "999.00"),
        ("a3", 1, "VM", "eastus", "5.00"),
    )
