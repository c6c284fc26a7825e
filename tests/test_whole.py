"""Queries over whole tables, on tables where rows and lags go beyond any prefix or share: no cut is left in query or SQL."""

import pytest
from compare import connection, difference

from samplewell.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["xcorr_lag", "window_lag", "window_amplitude", "drift_slope", "config_validate", "export_day_plan", "relative_errors", "sample_interval"])
def test_queries_take_whole_tables(spark, name):
    assert not any(cut in ORACLES[name] for cut in ("QUALIFY", "LIMIT", "event_id % 50", "event_id % 10 = 0"))
    assert difference(QUERIES[name](spark, SF), connection(SF).sql(ORACLES[name])) is None


def test_row_counts_are_those_of_the_tables(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert QUERIES["config_validate"](spark, SF).count() == n and QUERIES["sample_interval"](spark, SF).count() == n and QUERIES["export_day_plan"](spark, SF).count() == 3 * n
