"""Nearest joins against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import geo
from millrace.geo import nearest


@pytest.mark.parametrize("region", [250_000, 100])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, region):
    monkeypatch.setattr(nearest, "REGION", region)
    monkeypatch.setattr(nearest, "GROUP", 200)
    monkeypatch.setattr(nearest, "DRAWN", 32)
    rng = np.random.default_rng(7)
    odd = [(89.9, 10.0), (90.0, 50.0), (-90.0, 0.0), (-89.95, 180.0), (0.0, 179.99), (0.0, -179.99), (10.0, 20.0), (10.0, 20.0)]
    made = lambda n: [*odd, *zip(rng.uniform(-90, 90, n).tolist(), rng.uniform(-180, 180, n).tolist(), strict=True), *zip(rng.normal(40, 0.01, n).tolist(), rng.normal(-70, 0.01, n).tolist(), strict=True)]
    lost = [(None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))]
    left, right = [*made(200), *lost], [*made(150), *lost, (10.0, 20.0), (-10.5, 20.0), (-9.5, 20.0)]
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i int, lat double, lon double")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], "j int, lat double, lon double")
    real = lambda p: all(v is not None and math.isfinite(v) for v in p)
    for limit in (500, 30_000):
        got = geo.nearest_join(a, b, ("lat", "lon"), ("lat", "lon"), limit, "km", order="j", digits=6)
        assert got.columns == ["i", "lat", "lon", "j", "lat_y", "lon_y", "km"]
        want = {}
        for i, p in enumerate(left):
            km = [(round(geo.distance_km(*p, *q), 6), j) for j, q in enumerate(right) if real(p) and real(q) and geo.distance_km(*p, *q) <= limit]
            want[i] = min(km, default=(None, None))[1]
        rows = got.collect()
        assert {r.i: r.j for r in rows} == want and len(rows) == len(left)
        assert all(r.j is None or (r.lat_y, r.lon_y) == right[r.j] and r.km == pytest.approx(geo.distance_km(r.lat, r.lon, r.lat_y, r.lon_y), abs=1e-3) for r in rows)


def test_equal_places_are_no_pairs(spark):
    """A hundred million pairs at four places: only places are searched."""
    at = lambda k: ((F.col(k) % 4) * 0.5).alias("lat"), lambda k: F.lit(1.0).alias("lon")
    a = spark.range(20_000).select("id", *(f("id") for f in at))
    b = spark.range(20_000).select(F.col("id").alias("j"), *(f("id") for f in at))
    near = nearest.near_positions(*(x.distinct().toDF(*names) for x, names in ((a.select("lat", "lon"), ("__lat", "__lon")), (b.select("lat", "lon"), ("__rlat", "__rlon")))), 100, geo.KM, (20_000, 20_000))
    assert near.count() == 4
    got = geo.nearest_join(a, b, ("lat", "lon"), ("lat", "lon"), 100, order="j")
    assert got.where("j = id % 4").count() == 20_000
