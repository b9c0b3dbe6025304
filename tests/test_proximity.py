import math

import pytest
from pyspark.sql import functions as F

from slatework.functions import geo
from slatework.operators import proximity

SCHEMA = "id long, lat double, lon double"


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


def brute(points, r):
    return {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and metres(a, b) <= r}


def found(spark, points, r):
    return sorted((x.id_a, x.id_b) for x in proximity.near_pairs(spark.createDataFrame(points, SCHEMA), None, r).collect())


@pytest.mark.parametrize("centre", [(0.0, 0.0), (45.0, 179.9999), (-60.0, -180.0), (89.9999, 10.0), (-90.0, 0.0), (12.5, -179.99995)])
def test_near_pairs_equals_brute_force(spark, centre):
    import random

    rnd = random.Random(str(centre))
    pts = []
    for i in range(120):
        lat = max(-90.0, min(90.0, centre[0] + rnd.uniform(-0.0006, 0.0006)))
        lon = centre[1] + rnd.uniform(-0.0012, 0.0012) * (50 if abs(centre[0]) > 89 else 1)
        lon = (lon + 180) % 360 - 180
        pts.append((i, lat, lon))
    pts += [(200, *pts[0][1:]), (201, *pts[0][1:])]  # the same place thrice
    got = found(spark, pts, 20.0)
    assert len(got) == len(set(got))
    assert set(got) == brute(pts, 20.0)


def test_hot_cell_is_salted_without_loss(spark, monkeypatch):
    monkeypatch.setattr(proximity, "SALT_ROWS", 7)
    pts = [(i, 10.0 + (i % 5) * 1e-5, 20.0) for i in range(60)]
    assert set(found(spark, pts, 20.0)) == brute(pts, 20.0)


def test_two_sides(spark):
    a = spark.createDataFrame([(1, 10.0, 20.0), (2, 11.0, 20.0)], SCHEMA)
    b = spark.createDataFrame([(1, 10.00001, 20.0), (7, 50.0, 20.0)], SCHEMA)
    assert [(r.id_a, r.id_b) for r in proximity.near_pairs(a, b, 3.0).collect()] == [(1, 1)]


def test_unusable_locations_empty_tables_and_clashing_columns(spark):
    rows = [(1, 0.0, 0.0, 1), (2, None, 1.0, 1), (3, float("nan"), 1.0, 1), (4, 91.0, 1.0, 1), (5, 1.0, 181.0, 1), (6, 1.0, 1.0, 1), (7, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, cell int")
    pts = proximity.located(df, "id", "lat", "lon")
    assert sorted(r.id for r in pts.collect()) == [6, 7]
    assert [(r.id_a, r.id_b) for r in proximity.near_pairs(pts, None, 20.0).collect()] == [(6, 7)]
    none = pts.where("false")
    assert proximity.near_pairs(none, None, 20.0).count() == 0
    counts = {r.id: r.near for r in proximity.neighbour_counts(pts, proximity.near_pairs(pts, None, 20.0)).collect()}
    assert counts == {6: 1, 7: 1}


def test_regions_with_holes_parts_and_broken_text(spark):
    wkt = [
        (1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"),
        (2, "MULTIPOLYGON (((179 0, 180 0, 180 1, 179 1, 179 0)), ((-180 0, -179 0, -179 1, -180 1, -180 0)))"),
        (3, "POLYGON ((oops"), (4, None), (5, "POINT (1 1)"),
    ]
    regions = spark.createDataFrame(wkt, "rid long, wkt string")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.5), (3, 0.5, 179.5), (4, 0.5, -179.5), (5, 50.0, 50.0)], SCHEMA)
    got = sorted((r.id, r.region_id) for r in proximity.containing_regions(pts, regions, "rid", "wkt").collect())
    assert got == [(2, 1), (3, 2), (4, 2)]
    assert proximity.containing_regions(pts, regions.where("false"), "rid", "wkt").count() == 0


def test_great_circle(spark):
    d = spark.range(1).select(geo.great_circle_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d")).first()["d"]
    assert abs(d - math.pi * geo.EARTH_M) < 1e-3
