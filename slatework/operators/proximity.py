"""Points near other points, and the region around a point.

Both joins hash to grid cells first and verify exactly afterwards, so no pair is
formed across cells that cannot match. Nothing is collected; a cell that holds
very many points is split by a salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.functions import geo
from slatework.session import dealt, small

#: Points of one cell that one task verifies against; fuller cells are dealt to several tasks, whatever the size of the table.
SALT_ROWS = 4_000


def located(df: DataFrame, id_col: str, lat: str, lon: str) -> DataFrame:
    """(id, lat, lon) of the rows with a usable location; other columns are dropped."""
    return df.where(geo.usable_location(F.col(lat), F.col(lon))).select(F.col(id_col).alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))


def near_pairs(left: DataFrame, right: DataFrame | None, radius_m: float) -> DataFrame:
    """All pairs of (id, lat, lon) rows at most ``radius_m`` apart on the great circle.

    With ``right=None`` the pairs are within ``left``, as id_a < id_b. Otherwise
    id_a is from left and id_b from right. Each pair comes once: every point has
    one home cell, and the other side probes all cells its circle touches.
    Ids are expected to be unique per side; rows with a null id never pair.
    Empty inputs give an empty result. Output: id_a, id_b, metres.
    """
    own = right is None
    home = (left if own else right).withColumn("cell", geo.home_cell(F.col("lat"), F.col("lon"), radius_m))
    probe = left.withColumn("cell", F.explode(geo.near_cells(F.col("lat"), F.col("lon"), radius_m)))
    # The home side of a full cell is dealt to salts, the probing side visits each of them.
    probe, home, keys = dealt(probe, home, ["cell"], "id", SALT_ROWS)
    a = probe.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), *keys)
    b = home.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), *keys)
    pairs = a.join(b, keys)
    if own:
        pairs = pairs.where(F.col("id_a") < F.col("id_b"))
    metres = geo.great_circle_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return pairs.withColumn("metres", metres).where(F.col("metres") <= radius_m).select("id_a", "id_b", "metres")


def region_cells(regions: DataFrame, id_col: str, wkt_col: str, cell_deg: float) -> DataFrame:
    """(region_id, cell, edges): every grid cell that the bounding box of a region part touches."""
    r = regions.select(F.col(id_col).alias("region_id"), geo.wkt_edges(F.col(wkt_col)).alias("edges")).where("edges is not null")
    low = lambda c: F.array_min(F.transform("edges", lambda e: e[c]))
    high = lambda c: F.array_max(F.transform("edges", lambda e: e[c]))
    # A multipolygon across the antimeridian has a box as wide as the world: boxes are by half.
    west = F.filter("edges", lambda e: e.x1 < 0)
    east = F.filter("edges", lambda e: e.x1 >= 0)
    split = (low("x1") < -170) & (high("x1") > 170)
    box = lambda es: F.struct(
        F.array_min(F.transform(es, lambda e: F.least(e.x1, e.x2))).alias("w"), F.array_max(F.transform(es, lambda e: F.greatest(e.x1, e.x2))).alias("e"),
        F.array_min(F.transform(es, lambda e: F.least(e.y1, e.y2))).alias("s"), F.array_max(F.transform(es, lambda e: F.greatest(e.y1, e.y2))).alias("n"),
    )
    r = r.withColumn("box", F.explode(F.when(split, F.array(box(west), box(east))).otherwise(F.array(box(F.col("edges"))))))
    at = lambda c: F.floor(c / cell_deg)
    r = r.withColumn("row", F.explode(F.sequence(at(F.col("box.s")), at(F.col("box.n"))))).withColumn("col", F.explode(F.sequence(at(F.col("box.w")), at(F.col("box.e")))))
    return r.select("region_id", (F.col("row") * F.lit(1 << 32) + F.col("col")).alias("cell"), "edges").dropDuplicates(["region_id", "cell"])


def containing_regions(points: DataFrame, regions: DataFrame, id_col: str, wkt_col: str, cell_deg: float = 0.25) -> DataFrame:
    """(id, region_id) for each (id, lat, lon) point inside a region.

    Even-odd rule over all rings: ground in a hole is outside. Points of no
    region, regions with unreadable WKT and null WKT give no row. Points that lie
    in two overlapping regions give both. The regions are broadcast only if the cells
    they cover, with their edges, are few and small; larger sets are joined by shuffle on the cell.
    """
    cells = small(region_cells(regions, id_col, wkt_col, cell_deg))
    at = lambda c: F.floor(c / cell_deg)
    p = points.withColumn("cell", at(F.col("lat")) * F.lit(1 << 32) + at(F.col("lon")))
    return p.join(cells, "cell").where(geo.crossings_odd(F.col("edges"), F.col("lon"), F.col("lat"))).select("id", "region_id")


def neighbour_counts(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per point: how many others are near, and the nearest distance (null if none)."""
    both = pairs.select(F.col("id_a").alias("id"), "metres").unionByName(pairs.select(F.col("id_b").alias("id"), "metres"))
    agg = both.groupBy("id").agg(F.count(F.lit(1)).alias("near"), F.min("metres").alias("nearest_m"))
    return points.select("id").join(agg, "id", "left").select("id", F.coalesce("near", F.lit(0)).cast("long").alias("near"), "nearest_m")
