"""Geometry as column expressions: great circles, grid cells, WKT rings, areas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatework.functions.expr import let

#: Mean earth radius in metres.
EARTH_M = 6_371_008.8


def usable_location(lat: Column, lon: Column) -> Column:
    """True where the pair is a place: present, finite, on the globe and not 0/0."""
    ok = (
        lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
        & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    )
    return F.coalesce(ok, F.lit(False))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((p2 - p1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = s * s + F.cos(p1) * F.cos(p2) * t * t
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_M)


def _row_cells(row: Column, step: float) -> Column:
    """Number of cells of a latitude row: none is narrower than ``step`` degrees of arc."""
    low = F.abs(row * step - 90)
    high = F.abs((row + 1) * step - 90)
    widest = F.cos(F.radians(F.least(F.greatest(low, high), F.lit(90.0))))
    return F.greatest(F.lit(1), F.floor(360.0 * widest / step)).cast("long")


def home_cell(lat: Column, lon: Column, radius_m: float) -> Column:
    """The grid cell of a point: rows of two radii, columns at least as wide; one long."""
    step = math.degrees(2 * radius_m / EARTH_M)
    row = F.floor((lat + 90) / step)
    n = _row_cells(row, step)
    col = F.pmod(F.floor((lon + 180) / 360 * n), n)
    return (row * F.lit(1 << 32) + col).cast("long")


def near_cells(lat: Column, lon: Column, radius_m: float) -> Column:
    """All cells that a circle of ``radius_m`` around the point touches, as an array.

    Columns wrap at the antimeridian; where the circle reaches a pole all cells
    of the row are given.
    """
    step = math.degrees(2 * radius_m / EARTH_M)
    pad = math.degrees(radius_m / EARTH_M) * (1 + 1e-9) + 1e-12
    sine = math.sin(radius_m / EARTH_M) * (1 + 1e-9)
    cosine = F.cos(F.radians(lat))
    whole = cosine <= sine * 1.01
    wide = F.when(whole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sine / F.greatest(cosine, F.lit(1e-12))))) + 1e-12)
    rows = F.sequence(F.floor((F.greatest(lat - pad, F.lit(-90.0)) + 90) / step), F.floor((F.least(lat + pad, F.lit(90.0)) + 90) / step))

    def cells(row: Column) -> Column:
        n = _row_cells(row, step)
        first = F.floor((lon - wide + 180) / 360 * n)
        last = F.least(F.floor((lon + wide + 180) / 360 * n), first + n - 1)
        return F.transform(F.sequence(first, last), lambda c: (row * F.lit(1 << 32) + F.pmod(c, n)).cast("long"))

    return F.flatten(F.transform(rows, cells))


_NUMBER = r"[-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?"


def wkt_edges(wkt: Column) -> Column:
    """All edges of the rings of a POLYGON or MULTIPOLYGON as array<struct<x1,y1,x2,y2>>.

    Holes are rings like any other: with the even-odd rule they count as outside.
    Null for null, other kinds and text without a ring of at least three points.
    """
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def ring_points(ring: Column) -> Column:
        number = lambda w, i: F.try_element_at(w, F.lit(i)).try_cast("double")
        return F.transform(F.split(ring, ","), lambda p: let(F.split(F.trim(p), r"\s+"), lambda w: F.struct(number(w, 1).alias("x"), number(w, 2).alias("y"))))

    def edges(ring: Column) -> Column:
        def pairs(pts: Column) -> Column:
            n = F.greatest(F.size(pts) - 1, F.lit(0))
            return F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))

        return let(ring_points(ring), pairs)

    whole = lambda out: F.when((F.size(out) >= 3) & ~F.exists(out, lambda e: e.x1.isNull() | e.y1.isNull() | e.x2.isNull() | e.y2.isNull()), out)
    return F.when(wkt.rlike(r"(?i)^\s*(MULTI)?POLYGON\b"), let(F.flatten(F.transform(rings, edges)), whole))


def crossings_odd(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd point in polygon over an edge array."""
    hit = lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1)
    return F.size(F.filter(edges, hit)) % 2 == 1
