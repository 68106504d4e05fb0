"""Distances, shapes, projections and spatial joins on latitude and longitude columns (degrees)."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..semantics import col
from .nearest import near_positions

#: Fixed: mean Earth radii.
KM, MILES = 6371.0, 3958.8
DEGREE_KM = 111.32


def _c(v) -> Column:
    return col(v) if isinstance(v, (str, Column)) else F.lit(float(v))


def haversine(lat1, lon1, lat2, lon2, radius: float = KM) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = a2 - a1, F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), F.lit(2))
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def euclidean_degrees(lat1, lon1, lat2, lon2) -> Column:
    return F.sqrt(F.pow(_c(lat1) - _c(lat2), F.lit(2)) + F.pow(_c(lon1) - _c(lon2), F.lit(2)))


def km_to_degrees(km: float) -> float:
    return km / DEGREE_KM


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360."""
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    d = F.radians(_c(lon2)) - F.radians(_c(lon1))
    y = F.sin(d) * F.cos(a2)
    x = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat, lon, bearing_deg, km) -> tuple[Column, Column]:
    a, b, d = F.radians(_c(lat)), F.radians(_c(bearing_deg)), _c(km) / KM
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    lon2 = F.radians(_c(lon)) + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.degrees(lat2), F.pmod(F.degrees(lon2) + 180, F.lit(360.0)) - 180


def with_distance(df: DataFrame, lat: str, lon: str, to_lat: float, to_lon: float, out: str = "distance_km") -> DataFrame:
    return df.withColumn(out, haversine(lat, lon, to_lat, to_lon))


def filter_by_distance(df: DataFrame, lat: str, lon: str, to_lat: float, to_lon: float, km: float) -> DataFrame:
    """A latitude band first, which a scan can push down, then the exact distance."""
    d = math.degrees(km / KM) + 1e-9
    return df.where((col(lat) >= to_lat - d) & (col(lat) <= to_lat + d) & (haversine(lat, lon, to_lat, to_lon) <= km))


def within_box(lat: str, lon: str, south: float, west: float, north: float, east: float) -> Column:
    return col(lat).between(south, north) & (col(lon).between(west, east) if west <= east else (col(lon) >= west) | (col(lon) <= east))


def bounds(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(F.min(col(lat)).alias("min_lat"), F.min(col(lon)).alias("min_lon"), F.max(col(lat)).alias("max_lat"), F.max(col(lon)).alias("max_lon"))


def centroid(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(F.avg(col(lat)).alias("lat"), F.avg(col(lon)).alias("lon"))


class Polygon:
    """A ring of (lat, lon) vertices."""

    def __init__(self, points: Sequence[tuple[float, float]]):
        pts = [(float(a), float(b)) for a, b in points]
        self.points = pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts
        if len(self.points) < 3:
            raise ValueError("three vertices are needed")

    def _edges(self):
        return zip(self.points, [*self.points[1:], self.points[0]], strict=True)

    def contains(self, lat: str, lon: str) -> Column:
        """Even-odd rule as one boolean expression over the edges, behind the bounding box."""
        odd = None
        y, x = col(lat), col(lon)
        for (y1, x1), (y2, x2) in self._edges():
            if y1 == y2:
                continue
            cross = ((y < y1) != (y < y2)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            odd = cross if odd is None else odd != cross
        lats, lons = zip(*self.points, strict=True)
        return within_box(lat, lon, min(lats), min(lons), max(lats), max(lons)) & odd

    def area_km2(self) -> float:
        mid = math.radians(sum(a for a, _ in self.points) / len(self.points))
        twice = sum(x1 * y2 - x2 * y1 for (y1, x1), (y2, x2) in self._edges())
        return abs(twice) / 2 * DEGREE_KM**2 * math.cos(mid)

    def perimeter_km(self) -> float:
        return sum(distance_km(*a, *b) for a, b in self._edges())

    def centroid(self) -> tuple[float, float]:
        return sum(a for a, _ in self.points) / len(self.points), sum(b for _, b in self.points) / len(self.points)


def distance_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a1, a2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * KM * math.asin(min(1.0, math.sqrt(h)))


class LineString:
    def __init__(self, points: Sequence[tuple[float, float]]):
        self.points = [(float(a), float(b)) for a, b in points]

    def length_km(self) -> float:
        return sum(distance_km(*a, *b) for a, b in zip(self.points, self.points[1:], strict=False))

    def interpolate(self, fraction: float) -> tuple[float, float]:
        """The point at a share of the length, linear within a segment."""
        left = self.length_km() * min(max(fraction, 0.0), 1.0)
        for a, b in zip(self.points, self.points[1:], strict=False):
            d = distance_km(*a, *b)
            if d >= left and d > 0:
                t = left / d
                return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
            left -= d
        return self.points[-1]


# spatial joins --------------------------------------------------------------------


def _cells(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lat / size), F.floor(F.pmod(lon + 180, F.lit(360.0)) / size)


def within_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], km: float, out: str = "distance_km") -> DataFrame:
    """All pairs within ``km``: a grid join on latitude rows and, in each, on longitude cells wide enough there.

    Right points are copied to the neighbouring cells (also across the date line and the poles' narrow rows), pairs meet by
    equality of cells, and the exact distance decides. Clashing right names get _y.
    """
    size = max(math.degrees(km / KM), 1e-6)
    names = {c: f"{c}_y" if c in left.columns else c for c in right.columns}
    r = right.select(*[col(c).alias(names[c]) for c in right.columns])
    rlat, rlon = names[right_at[0]], names[right_at[1]]
    # a longitude cell of row y spans ``size`` km-degrees at the row's edge nearest a pole
    edge = lambda y: F.least(F.greatest(F.abs(y), F.abs(y + 1)) * size + size, F.lit(90.0))
    count = lambda y: F.greatest(F.floor(F.lit(360.0 / size) * F.cos(F.radians(edge(y)))), F.lit(1)).cast("long")
    cell = lambda lon, y: F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360.0 * count(y)).cast("long")
    l_row = F.floor(col(left_at[0]) / size)
    l = left.withColumn("__row", l_row).withColumn("__cell", F.pmod(cell(col(left_at[1]), F.col("__row")), count(F.col("__row"))))
    rows = F.explode(F.array(*[F.floor(col(rlat) / size) + d for d in (-1, 0, 1)]))
    r = r.withColumn("__row", rows)
    n = count(F.col("__row"))
    near = F.array_distinct(F.array(*[F.pmod(cell(col(rlon), F.col("__row")) + d, n) for d in (-1, 0, 1)]))
    r = r.withColumn("__cell", F.explode(near))
    joined = l.join(r, ["__row", "__cell"]).withColumn(out, haversine(left_at[0], left_at[1], rlat, rlon))
    return joined.where(col(out) <= km).drop("__row", "__cell")


def nearest_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], max_km: float, out: str = "distance_km", order: str | None = None, digits: int | None = None) -> DataFrame:
    """Every left row with its nearest right row within ``max_km`` (nulls beyond); ties by ``order``.

    With ``digits``, distances that round to the same tie. Equal positions are searched once, in trees; clashing right names
    get _y. Two jobs count the rows of both sides while the plan is built (more if the right side is over 250,000 rows).
    """
    names = {c: f"{c}_y" if c in left.columns else c for c in right.columns}
    r = right.select(*[col(c).alias(names[c]) for c in right.columns])
    at = lambda df, lat, lon, p: df.withColumns({f"__{p}lat": col(lat).cast("double"), f"__{p}lon": col(lon).cast("double")})
    finite = lambda p: (F.abs(f"__{p}lat") < float("inf")) & (F.abs(f"__{p}lon") < float("inf"))  # noqa: E731  false for NaN and null
    tie = [col(names[order])] if order else []
    places = at(r, names[right_at[0]], names[right_at[1]], "r").where(finite("r")).groupBy("__rlat", "__rlon").agg(F.min(F.struct(*tie, F.struct(*map(col, r.columns)).alias("__r"))).alias("__m"))
    base = at(left, *left_at, "")
    asked = base.where(finite("")).select("__lat", "__lon").distinct()
    near = near_positions(asked, places.select("__rlat", "__rlon"), max_km, KM, (left.count(), right.count()))
    near = near.withColumn("__km", haversine("__lat", "__lon", "__rlat", "__rlon")).where(col("__km") <= max_km).join(places, ["__rlat", "__rlon"])
    key = F.round("__km", digits) if digits is not None else col("__km")
    best = near.groupBy("__lat", "__lon").agg(F.min(F.struct(key.alias("__key"), "__m", "__km")).alias("__b"))
    best = best.select("__lat", "__lon", *[F.col(f"__b.__m.__r.`{c}`").alias(c) for c in r.columns], F.col("__b.__km").alias(out))
    return base.join(best, ["__lat", "__lon"], "left").drop("__lat", "__lon")


def k_nearest(df: DataFrame, lat: str, lon: str, to_lat: float, to_lon: float, k: int) -> DataFrame:
    return with_distance(df, lat, lon, to_lat, to_lon).orderBy("distance_km").limit(k)


def buffer_box(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """south, west, north, east of a box around a circle."""
    d = math.degrees(km / KM)
    e = d / max(math.cos(math.radians(lat)), 1e-6)
    return lat - d, lon - e, lat + d, lon + e


# projections and storage ---------------------------------------------------------------

_A = 6378137.0
_F = 1 / 298.257223563


def to_web_mercator(lat, lon) -> tuple[Column, Column]:
    return F.radians(_c(lon)) * _A, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2)) * _A


def from_web_mercator(x, y) -> tuple[Column, Column]:
    return F.degrees(F.atan(F.exp(_c(y) / _A)) * 2 - F.lit(math.pi / 2)), F.degrees(_c(x) / _A)


def to_utm(lat, lon, zone: int) -> tuple[Column, Column]:
    """Easting and northing in a zone of the northern or southern half, by the Krueger series to third order."""
    n = _F / (2 - _F)
    big_a = _A / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n * n / 3 + 5 * n**3 / 16, 13 * n * n / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - (zone * 6 - 183))
    s = F.sin(phi)
    atanh = lambda v: F.ln((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k0 = 0.9996
    return east * (k0 * big_a) + 500_000.0, north * (k0 * big_a) + F.when(_c(lat) < 0, 10_000_000.0).otherwise(0.0)


def wkb_point(lat: float, lon: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, lon, lat)


def write_geoparquet(df: DataFrame, path: str, lat: str, lon: str, mode: str = "errorifexists") -> None:
    """Parquet with a WKB point column 'geometry' in hex (Arrow batches)."""
    @F.pandas_udf("string")
    def hexed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if y != y or x != x else wkb_point(y, x).hex() for y, x in zip(a, b, strict=True)])

    df.withColumn("geometry", hexed(col(lat).cast("double"), col(lon).cast("double"))).write.mode(mode).parquet(path)


def read_geoparquet(spark, path: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    @F.pandas_udf("lat double, lon double")
    def parsed(h: pd.Series) -> pd.DataFrame:
        pts = [(None, None) if x is None else struct.unpack("<BIdd", bytes.fromhex(x))[:1:-1] for x in h]
        return pd.DataFrame(pts, columns=["lat", "lon"])

    df = spark.read.parquet(path).withColumn("__p", parsed("geometry"))
    return df.withColumns({lat: F.col("__p.lat"), lon: F.col("__p.lon")}).drop("__p")


