"""Geometry as column expressions: boxes, grid blocks, rings, zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres in a degree of latitude, and in one of longitude at the equator.
KM_LAT, KM_LON = 110.574, 111.320


def box_around(lon: Column, lat: Column, km: Column) -> Column:
    """A box of ``km`` a side around a centre, in degrees, to six places (halves to even)."""
    dy = km / 2 / F.lit(KM_LAT)
    dx = km / 2 / (F.lit(KM_LON) * F.cos(F.radians(lat)))
    return F.struct(*[F.bround(v, 6).alias(k) for k, v in (("west", lon - dx), ("south", lat - dy), ("east", lon + dx), ("north", lat + dy))])


def overlap_area(a: str, b: str) -> Column:
    """The common area of two boxes, given as prefixes of x0, y0, x1, y1."""
    width = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    height = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a ring: whether a ray from it crosses an odd number of edges."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay == by:
            continue
        reaches = (F.lit(ay) > y) != (F.lit(by) > y)
        crossed = crossed + F.when(reaches & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax), 1).otherwise(0)
    return crossed % 2 == 1


def block_index(x: Column, y: Column, origin_x: float, origin_y: float, size: float, count: int) -> Column:
    """The grid block of a point (column from the west, row from the north, within 0 .. count - 1), and its margin.

    The margin is the distance to the block's nearest edge, negative outside of the grid.
    """
    col = F.least(F.greatest(F.floor((x - origin_x) / size), F.lit(0)), F.lit(count - 1)).cast("int")
    row = F.least(F.greatest(F.floor((origin_y - y) / size), F.lit(0)), F.lit(count - 1)).cast("int")
    west, north = origin_x + col * size, origin_y - row * size
    margin = F.least(x - west, west + size - x, north - y, y - (north - size))
    return F.struct(col.alias("col"), row.alias("row"), margin.alias("margin"))


def zone(row: Column, column: Column, height: int, width: int) -> Column:
    """The zone 0 .. 8 of a pixel in a three by three division."""
    return F.least(F.floor(3 * row / height), F.lit(2)).cast("int") * 3 + F.least(F.floor(3 * column / width), F.lit(2)).cast("int")


def utm(lon: Column, lat: Column, zone_number: int) -> tuple[Column, Column]:
    """Easting and northing of the transverse Mercator projection on WGS 84, by Krueger's series to the fourth order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone_number - 183.0))
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500_000 + 0.9996 * radius * east, 0.9996 * radius * north
