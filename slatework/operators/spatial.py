"""Planar joins: nearest neighbours, distance and box joins, raster samples, one-to-one assignment."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.functions.expr import let
from slatework.session import dropped, scratch, ship, written


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def near(points: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """pid, sid, d2 of all (point, site) pairs at most ``radius`` apart.

    points: pid, x, y. sites: sid, x, y. Sites are laid into the 3 x 3 cells around theirs, points stay in one
    cell, so each pair comes once. Null coordinates never pair.
    """
    s = sites.where("x is not null and y is not null").select("sid", F.col("x").alias("sx"), F.col("y").alias("sy"))
    s = s.withColumn("cx", F.explode(F.sequence(_cell(F.col("sx"), radius) - 1, _cell(F.col("sx"), radius) + 1))).withColumn("cy", F.explode(F.sequence(_cell(F.col("sy"), radius) - 1, _cell(F.col("sy"), radius) + 1)))
    p = points.where("x is not null and y is not null").withColumn("cx", _cell(F.col("x"), radius)).withColumn("cy", _cell(F.col("y"), radius))
    d2 = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    return p.join(s, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("cx", "cy", "sx", "sy")


def nearest_within(points: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """points with sid and distance of the nearest site within ``radius``, the least id on ties; null where none is."""
    best = near(points.select("pid", "x", "y"), sites, radius).groupBy("pid").agg(F.min(F.struct("d2", "sid")).alias("_b"))
    return points.join(best, "pid", "left").select(*[points[c] for c in points.columns], F.col("_b.sid").alias("sid"), F.sqrt("_b.d2").alias("distance"))


def nearest(points: DataFrame, sites: DataFrame, first_radius: float | None = None) -> DataFrame:
    """pid, sid, distance of the nearest site of every point, however far.

    Points are looked up within a radius; those without a site there go on with twice the
    radius, so each round joins fewer points. The first radius fits the density of the
    sites. Exact: a nearest site within the radius is in the 3 x 3 cells. No rows if there are no sites.
    """
    box = sites.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()  # one row
    if not box["n"]:
        return points.select("pid", F.lit(None).cast("long").alias("sid"), F.lit(None).cast("double").alias("distance")).limit(0)
    reach = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()  # one row
    if reach["x0"] is None:
        return points.select("pid", F.lit(None).cast("long").alias("sid"), F.lit(None).cast("double").alias("distance")).limit(0)
    wide = max(box["x1"], reach["x1"]) - min(box["x0"], reach["x0"]) + max(box["y1"], reach["y1"]) - min(box["y0"], reach["y0"])
    area = max(box["x1"] - box["x0"], 1e-9) * max(box["y1"] - box["y0"], 1e-9)
    radius = first_radius or max(2 * math.sqrt(area / box["n"]), wide / 1e6, 1e-9)
    left, path = points.select("pid", "x", "y").where("x is not null and y is not null"), scratch(points.sparkSession, "nearest-found")
    for n in range(64):
        found = written(nearest_within(left, sites, radius), "nearest")
        done = found.where("sid is not null").select("pid", "sid", "distance")
        done.write.parquet(f"{path}/{n}")
        before, left = left, found.where("sid is null").select("pid", "x", "y")
        last = radius > 2 * wide + 1 or left.isEmpty()
        if not last:  # the points that go on are kept apart, and this round's files go
            left = written(left, "nearest-left")
        dropped(found, before)
        if last:
            break
        radius *= 2
    return points.sparkSession.read.schema(done.schema).option("recursiveFileLookup", True).parquet(path)


def box_join(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """points (left) with the bid of every box (x0, y0, x1, y1, closed) that holds them; boxes are laid into all cells they touch."""
    b = boxes.withColumn("cx", F.explode(F.sequence(_cell(F.col("x0"), cell), _cell(F.col("x1"), cell)))).withColumn("cy", F.explode(F.sequence(_cell(F.col("y0"), cell), _cell(F.col("y1"), cell))))
    p = points.withColumn("cx", _cell(F.col("x"), cell)).withColumn("cy", _cell(F.col("y"), cell))
    on = (p["cx"] == b["cx"]) & (p["cy"] == b["cy"]) & (p["x"] >= b["x0"]) & (p["x"] <= b["x1"]) & (p["y"] >= b["y0"]) & (p["y"] <= b["y1"])
    return p.join(b, on, "left").select(*[p[c] for c in points.columns], b["bid"])


def box_distance(x: Column, y: Column) -> Column:
    """Distance from a point to a box (x0, y0, x1, y1): 0 inside."""
    dx = F.greatest(F.col("x0") - x, F.lit(0.0), x - F.col("x1"))
    dy = F.greatest(F.col("y0") - y, F.lit(0.0), y - F.col("y1"))
    return F.sqrt(dx * dx + dy * dy)


def sampled(points: DataFrame, raster: DataFrame, x0: float, y0: float, pixel: float, width: int, height: int, nodata: int | None = None) -> DataFrame:
    """points with the value of the raster (row, col, value) under them; -1 out of bounds and for nodata. North is up: rows fall from y0."""
    col, row = F.floor((F.col("x") - x0) / pixel).cast("int"), F.floor((y0 - F.col("y")) / pixel).cast("int")
    p = points.withColumn("_c", col).withColumn("_r", row)
    v = F.col("_v") if nodata is None else F.when(F.col("_v") != nodata, F.col("_v"))
    j = p.join(raster.select(F.col("row").alias("_rr"), F.col("col").alias("_cc"), F.col("value").alias("_v")), (F.col("_r") == F.col("_rr")) & (F.col("_c") == F.col("_cc")), "left")
    inside = (F.col("_c") >= 0) & (F.col("_c") < width) & (F.col("_r") >= 0) & (F.col("_r") < height)
    return j.withColumn("value", F.coalesce(F.when(inside, v), F.lit(-1))).drop("_c", "_r", "_rr", "_cc", "_v")


def stable_pairs(candidates: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """pid, bid: one-to-one pairs of candidates (pid, bid, boundary, centre).

    In a round every free point picks its nearest boundary, every picked polygon takes its
    nearest centre among them, and both leave. Ties go to the least id. Each round makes
    at least one pair.
    """
    c = written(candidates, "assign")
    return _settled(c, *[written(c.select(k, F.col(k).alias("id")).where("id is not null").distinct(), "assign-ids") for k in ("pid", "bid")], most_rounds)


def stable_places(points: DataFrame, polygons: DataFrame, candidates: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int = 10_000) -> DataFrame:
    """``stable_pairs`` of points (pid, x, y) and polygons (bid, x, y) whose candidates depend on x and y alone.

    candidates makes pid, bid, boundary, centre of both. It is given one row a place, named by the
    least id there, so points that stand together times polygons that lie on each other are never
    listed. A place takes part in a round with its least free id. Of its ids it needs no more
    than there are candidates for it, since each takes one. Ids may repeat at their place; null coordinates never pair.
    """
    at = {k: written(df.where("x is not null and y is not null").groupBy("x", "y").agg(F.min(k).alias(k), F.count(F.lit(1)).alias("n")), "places") for k, df in (("pid", points), ("bid", polygons))}
    pairs = written(candidates(at["pid"].drop("n"), at["bid"].drop("n")), "assign")
    ids = []
    for k, other, df in (("pid", "bid", points), ("bid", "pid", polygons)):
        most = pairs.join(at[other].select(other, "n"), other).groupBy(k).agg(F.sum("n").alias("most"))
        named = at[k].join(most, k).select("x", "y", F.col(k).alias("_k"), "most")
        r = df.join(named, ["x", "y"]).select(F.col("_k").alias(k), F.col(k).alias("id"), "most", F.dense_rank().over(Window.partitionBy("_k").orderBy(k)).alias("_r"))
        ids.append(written(r.where("_r <= most").select(k, "id"), "assign-ids"))
    dropped(*at.values())
    return _settled(pairs, *ids, most_rounds)


#: Candidates, and as many ids, whose rounds one task runs in memory.
SETTLED_ROWS = 2_000_000


def _settled(pairs: DataFrame, points: DataFrame, polygons: DataFrame, most_rounds: int) -> DataFrame:
    """pid, bid of the rounds over pairs (pid, bid, boundary, centre) of places with their points (pid, id) and polygons (bid, id), all written.

    Rounds go over all tasks while more than SETTLED_ROWS pairs are left; one task runs
    what rounds remain, with all ids or, where these are more, with the least of each place
    as long as they last. The pairs of all are in one folder that is read once, and what is
    left replaces the files of the round before, so neither plans nor files grow.
    """
    spark, path = pairs.sparkSession, scratch(pairs.sparkSession, "assigned")
    schema = T.StructType([T.StructField("pid", points.schema["id"].dataType), T.StructField("bid", polygons.schema["id"].dataType)])
    for n in range(most_rounds):
        before, most, last = (pairs, points, polygons), None, False
        if pairs.count() <= SETTLED_ROWS:
            last = points.count() + polygons.count() <= SETTLED_ROWS
            if not last:
                most = max(1, SETTLED_ROWS // (points.select("pid").distinct().count() + polygons.select("bid").distinct().count()))
            won = _at_once(*before, schema, most)
        else:
            picks = pairs.join(polygons.groupBy("bid").agg(F.min("id").alias("polygon")), "bid").groupBy("pid").agg(F.min(F.struct("boundary", "polygon", "centre")).alias("s")).select("pid", "s.polygon", "s.centre")
            picks = picks.join(points.groupBy("pid").agg(F.min("id").alias("point")), "pid").groupBy("polygon").agg(F.min(F.struct("centre", "point")).alias("s"))
            won = picks.select(F.col("s.point").alias("pid"), F.col("polygon").alias("bid"))
        won.write.parquet(f"{path}/{n}")
        won = spark.read.schema(schema).parquet(f"{path}/{n}")
        if last or won.isEmpty():
            dropped(*before)
            break
        points, polygons = [written(df.join(won.select(F.col(k).alias("id")), "id", "left_anti").join(pairs.select(k), k, "left_semi"), "assign-ids") for k, df in (("pid", points), ("bid", polygons))]
        pairs = written(pairs.join(points.select("pid"), "pid", "left_semi").join(polygons.select("bid"), "bid", "left_semi"), "assign")
        dropped(*before)
    else:
        raise RuntimeError("rounds are used up")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def _at_once(pairs: DataFrame, points: DataFrame, polygons: DataFrame, schema: T.StructType, most: int | None) -> DataFrame:
    """What ``rounds`` makes of all rows, or of the least ``most`` ids of each place, in one task."""
    ship(pairs.sparkSession)
    if most:
        points, polygons = [df.withColumn("_r", F.dense_rank().over(Window.partitionBy(k).orderBy("id"))).where(F.col("_r") <= most).drop("_r") for k, df in (("pid", points), ("bid", polygons))]
    first = lambda k: F.coalesce(F.col(k), F.lit(float("-inf"))).alias(k)  # noqa: E731  # nulls go first, as in Spark's order
    rows = pairs.where("pid is not null and bid is not null").select("pid", "bid", first("boundary"), first("centre"))
    rows = rows.unionByName(points.withColumnRenamed("id", "point"), True).unionByName(polygons.withColumnRenamed("id", "polygon"), True)

    def run(batches):
        t = [b for b in batches if b.num_rows]
        if t:
            t = pa.Table.from_batches(t)
            of = lambda where, *names: [t.filter(pc.is_valid(t[where]))[c].to_numpy() for c in names]
            point, polygon = rounds(*of("boundary", "pid", "bid", "boundary", "centre"), *of("point", "pid", "point"), *of("polygon", "bid", "polygon"), most)
            yield pa.RecordBatch.from_arrays([pa.array(point, t["point"].type), pa.array(polygon, t["polygon"].type)], ["pid", "bid"])

    return rows.repartition(1).mapInArrow(run, schema)


def rounds(p, b, boundary, centre, point_at, point, polygon_at, polygon, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The point and polygon ids that the rounds of ``stable_pairs`` make of pairs of places (p, b, boundary, centre) and their points and polygons.

    A round compares the ranks of each place's least free id; pairs of a place without any leave.
    A place of ``most`` ids may have more: the rounds end where such a place has used all it has here.
    """

    def laid(at, ids):
        """Places, the ids by place and rank, where each place's begin and end."""
        named, rank = np.unique(ids, return_inverse=True)
        places, k = np.unique(at, return_inverse=True)
        ranks = np.unique(k.astype(np.int64) * max(len(named), 1) + rank)
        bounds = np.searchsorted(ranks, np.arange(len(places) + 1) * max(len(named), 1))
        return places, named, ranks % max(len(named), 1), bounds[:-1].copy(), bounds[1:]

    places, points, p_rank, p_next, p_end = laid(point_at, point)
    grounds, polygons, b_rank, b_next, b_end = laid(polygon_at, polygon)
    known = np.isin(p, places) & np.isin(b, grounds)
    p, b, near, mid = np.searchsorted(places, p[known]), np.searchsorted(grounds, b[known]), np.unique(boundary[known], return_inverse=True)[1], np.unique(centre[known], return_inverse=True)[1]
    order = np.lexsort((mid, near, b, p))
    p, b, near, mid = p[order], b[order], near[order], mid[order]
    once = np.ones(len(p), bool)
    once[1:] = (p[1:] != p[:-1]) | (b[1:] != b[:-1])
    p, b, near, mid = p[once], b[once], near[once], mid[once]
    made = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    ends = [(at, end, end - at >= most) for at, end in ((p_next, p_end), (b_next, b_end))] if most else []
    while len(p) and not any((full & (at == end)).any() for at, end, full in ends):
        key = near * len(polygons) + b_rank[b_next[b]]
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        least = np.minimum.reduceat(key, starts)
        pick = np.flatnonzero(key == np.repeat(least, np.diff(np.r_[starts, len(p)])))
        pick = pick[np.lexsort((p_rank[p_next[p[pick]]], mid[pick], b[pick]))]
        pick = pick[np.r_[True, b[pick[1:]] != b[pick[:-1]]]]
        made.append((p_rank[p_next[p[pick]]], b_rank[b_next[b[pick]]]))
        p_next[p[pick]] += 1
        b_next[b[pick]] += 1
        left = (p_next[p] < p_end[p]) & (b_next[b] < b_end[b])
        if not left.all():
            p, b, near, mid = p[left], b[left], near[left], mid[left]
    return points[np.concatenate([m[0] for m in made])], polygons[np.concatenate([m[1] for m in made])]


def ring_area(e: Column) -> Column:
    """Area of an edge array (struct x1, y1, x2, y2) by the shoelace formula."""
    return F.abs(F.aggregate(e, F.lit(0.0), lambda s, a: s + (a.x1 * a.y2 - a.x2 * a.y1))) / 2


def ring_centroid(e: Column) -> Column:
    """Area-weighted centroid (struct x, y) of an edge array, relative to its first corner for precision; null without area."""

    def of(s: Column) -> Column:
        cross = lambda a: (a.x1 - s.x0) * (a.y2 - s.y0) - (a.x2 - s.x0) * (a.y1 - s.y0)
        zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        add = lambda z, a: F.struct((z.t + cross(a)).alias("t"), (z.x + (a.x1 + a.x2 - 2 * s.x0) * cross(a)).alias("x"), (z.y + (a.y1 + a.y2 - 2 * s.y0) * cross(a)).alias("y"))
        return F.aggregate(s.e, zero, add, lambda z: F.struct((s.x0 + F.try_divide(z.x, 3 * z.t)).alias("x"), (s.y0 + F.try_divide(z.y, 3 * z.t)).alias("y")))

    corner = lambda v: F.struct(v.alias("e"), F.try_element_at(v, F.lit(1))["x1"].alias("x0"), F.try_element_at(v, F.lit(1))["y1"].alias("y0"))
    return let(e, lambda v: let(corner(v), of))


# WGS84 ellipsoid and the transverse Mercator scale and offset.
WGS84_A, WGS84_F, UTM_K0, UTM_FALSE_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def utm(lat: Column, lon: Column, meridian: float) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) by the transverse Mercator series to the sixth order."""
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    s, c = F.sin(phi), F.cos(phi)
    n = WGS84_A / F.sqrt(1 - e2 * s * s)
    t, cc, a = (s / c) * (s / c), ep2 * c * c, F.radians(lon - meridian) * c
    m = WGS84_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = UTM_K0 * n * (a + (1 - t + cc) * a * a * a / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep2) * a * a * a * a * a / 120) + UTM_FALSE_EAST
    north = UTM_K0 * (m + n * (s / c) * (a * a / 2 + (5 - t + 9 * cc + 4 * cc * cc) * a * a * a * a / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep2) * a * a * a * a * a * a / 720))
    return east, north


def _signed(px: float, py: float, e: np.ndarray) -> float:
    x1, y1, x2, y2 = e.T
    hit = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / np.where(y2 == y1, 1.0, y2 - y1) + x1)
    dx, dy = x2 - x1, y2 - y1
    t = np.clip(((px - x1) * dx + (py - y1) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
    d = np.hypot(px - x1 - t * dx, py - y1 - t * dy).min()
    return d if hit.sum() % 2 else -d


def interior_point(e: np.ndarray, tolerance: float) -> tuple[float, float, float]:
    """Pole of inaccessibility: the point inside that is farthest from the boundary, within ``tolerance``. Quartered cells, best bound first."""
    import heapq

    x0, y0, x1, y1 = e[:, [0, 2]].min(), e[:, [1, 3]].min(), e[:, [0, 2]].max(), e[:, [1, 3]].max()
    size = min(x1 - x0, y1 - y0)
    if size <= 0:
        return float(x0), float(y0), 0.0
    heap, h = [], size / 2
    best = max(((_signed(x, y, e), x, y) for x, y in [((x0 + x1) / 2, (y0 + y1) / 2)]), key=lambda b: b[0])
    for x in np.arange(x0, x1, size):
        for y in np.arange(y0, y1, size):
            d = _signed(x + h, y + h, e)
            heap.append((-(d + h * math.sqrt(2)), x + h, y + h, h, d))
    heapq.heapify(heap)
    while heap:
        bound, x, y, h, d = heapq.heappop(heap)
        if d > best[0]:
            best = (d, x, y)
        if -bound - best[0] <= tolerance:
            break
        h /= 2
        for sx in (-h, h):
            for sy in (-h, h):
                d = _signed(x + sx, y + sy, e)
                heapq.heappush(heap, (-(d + h * math.sqrt(2)), x + sx, y + sy, h, d))
    return float(best[1]), float(best[2]), float(best[0])


def polylabel(tolerance: float = 0.1):
    """Arrow UDF of interior_point over edge arrays: struct x, y, distance."""

    @F.pandas_udf("x double, y double, distance double")
    def run(edges: pd.Series) -> pd.DataFrame:
        rows = []
        for e in edges:
            if e is None or len(e) < 3:
                rows.append((None, None, None))
            else:
                rows.append(interior_point(np.array([[s["x1"], s["y1"], s["x2"], s["y2"]] for s in e], dtype=float), tolerance))
        return pd.DataFrame(rows, columns=["x", "y", "distance"], dtype=float)

    return run
