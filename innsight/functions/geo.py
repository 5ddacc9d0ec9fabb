"""Great-circle distance and the latitude/longitude box around a point."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight.functions.constants import EARTH_RADIUS_KM
from innsight.functions.pricing import _col


def distance_km(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Spherical law of cosines. The cosine is kept within [-1, 1]: rounding can
    push it past 1 for two equal points, and acos would then give NaN."""
    lat_a, lon_a = F.radians(_col(lat_a)), _col(lon_a)
    lat_b, lon_b = F.radians(_col(lat_b)), _col(lon_b)
    cosine = F.cos(lat_a) * F.cos(lat_b) * F.cos(F.radians(lon_b - lon_a)) + F.sin(
        lat_a
    ) * F.sin(lat_b)
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return F.when(cosine.isNotNull(), F.acos(bounded) * F.lit(EARTH_RADIUS_KM))


def box_around(lat: float, lon: float, radius_km: float, lat_col, lon_col) -> Column:
    """A necessary condition for "within the radius" made of plain comparisons,
    so that file statistics can skip data before any trigonometry runs."""
    lat_col, lon_col = _col(lat_col), _col(lon_col)
    angle = radius_km / EARTH_RADIUS_KM * (1 + 1e-9) + 1e-7
    if angle >= math.pi:
        return F.lit(True)
    reach = math.degrees(angle)
    south, north = lat - reach, lat + reach
    inside = lat_col.between(south, north)
    if south <= -90 or north >= 90:
        return inside  # the circle holds a pole, hence every longitude
    half = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    west, east = lon - half - 1e-9, lon + half + 1e-9
    within = lon_col.between(west, east)
    if west < -180:
        within = within | (lon_col >= west + 360)
    if east > 180:
        within = within | (lon_col <= east - 360)
    # longitudes outside the usual range are left to the exact test
    return inside & (within | (lon_col < -180.0) | (lon_col > 180.0))


CURVE_BITS = 16  # of each coordinate; a step is about 600 m


def curve_key(lat, lon) -> Column:
    """The place's number on a Hilbert curve through the plane, whose neighbours are
    neighbours in the plane, so a stretch of it covers a compact area. Null where a
    coordinate is null; places outside the usual ranges count as on their border."""
    side = 1 << CURVE_BITS

    def steps(degrees, half: float) -> Column:
        share = (_col(degrees) + F.lit(half)) / F.lit(2 * half)
        step = F.floor(share * F.lit(float(side)))
        return F.greatest(F.lit(0), F.least(F.lit(side - 1), step)).cast("long")

    def descend(at: Column, size: Column) -> Column:
        """One level: the quarter that holds the place, and its axes turned so that the
        curve through the quarter is the one through the whole."""
        right = at["x"].bitwiseAND(size) > 0
        upper = at["y"].bitwiseAND(size) > 0
        quarter = F.when(right, F.when(upper, 2).otherwise(3)).otherwise(F.when(upper, 1).otherwise(0))
        flip = right & ~upper
        x = F.when(flip, F.lit(side - 1) - at["x"]).otherwise(at["x"])
        y = F.when(flip, F.lit(side - 1) - at["y"]).otherwise(at["y"])
        return F.struct(
            F.when(upper, x).otherwise(y).alias("x"),
            F.when(upper, y).otherwise(x).alias("y"),
            (at["key"] + size * size * quarter).alias("key"),
        )

    sizes = F.array(*[F.lit(1 << bit).cast("long") for bit in reversed(range(CURVE_BITS))])
    start = F.struct(
        steps(lon, 180.0).alias("x"), steps(lat, 90.0).alias("y"), F.lit(0).cast("long").alias("key")
    )
    known = _col(lat).isNotNull() & _col(lon).isNotNull()
    return F.when(known, F.aggregate(sizes, start, descend, lambda at: at["key"]))
