import pytest

from panelforge.operators import prefix
from panelforge.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests")


@pytest.fixture
def many_ranges(spark, monkeypatch):
    """Keep every shuffle at its full number of partitions, and ranges short, so small data spans many ranges."""
    monkeypatch.setattr(prefix, "RANGE_ROWS", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
