"""Rates and ranges of a table of another size than the given ones."""

import datetime

import pytest

from trackloom.plans import catalog


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three users with 120, 100 and 7 events."""
    path = str(tmp_path_factory.mktemp("events"))
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1000 * u + k, u, t0 + datetime.timedelta(minutes=k), "click", float(k % 11) * (u + 1)) for u, n in enumerate((120, 100, 7)) for k in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return path


def test_stream_rates(spark, events):
    (r,) = catalog.queries()["stream_rates"](spark, events).collect()
    assert (r.ratio, r.bytes_per_frame, r.bytes_per_point) == pytest.approx((227 * 32 / r.out_bytes, r.out_bytes / 120, r.out_bytes / 360), abs=1e-6)


def test_byte_ranges(spark, events):
    rows = catalog.queries()["byte_ranges"](spark, events).collect()
    assert {(r.frame, r.at) for r in rows} == {(k, min(119, int(k / 20.0 * 20))) for k in range(120)}
