"""Queries of geometry, rasters, nearest neighbours and curve matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions import geo
from slatework.functions.vocab import RESIDENTIAL_USES
from slatework.operators import exposure, sampling, spatial
from slatework.plans.base import PARTS_SQL, POINTS_SQL, SITES_SQL, parts, points, query, r6, sites
from slatework.session import table

HALF = 15.0
BOXES_SQL = f"boxes AS (SELECT sid AS bid, x AS cx, y AS cy, x - {HALF} AS x0, y - {HALF} AS y0, x + {HALF} AS x1, y + {HALF} AS y1 FROM sites)"


def _squares(s: DataFrame) -> DataFrame:
    return s.select(F.col("sid").alias("bid"), (F.col("x") - HALF).alias("x0"), (F.col("y") - HALF).alias("y0"), (F.col("x") + HALF).alias("x1"), (F.col("y") + HALF).alias("y1"))


@query(f"WITH {POINTS_SQL} SELECT c_nationkey, min(x) - 0.001::DOUBLE AS x0, min(y) - 0.001::DOUBLE AS y0, max(x) + 0.001::DOUBLE AS x1, max(y) + 0.001::DOUBLE AS y1 FROM points GROUP BY c_nationkey")
def group_bbox(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("c_nationkey").agg((F.min("x") - 0.001).alias("x0"), (F.min("y") - 0.001).alias("y0"), (F.max("x") + 0.001).alias("x1"), (F.max("y") + 0.001).alias("y1"))


RASTER_SQL = "raster AS (SELECT r::INT AS row, c::INT AS col, ((r * 31 + c * 17) % 20)::INT AS value FROM range(100) AS a(r) CROSS JOIN range(100) AS b(c))"
SAMPLE_SQL = f"{POINTS_SQL}, {RASTER_SQL}, s AS (SELECT p.*, CASE WHEN r.value IS NULL OR r.value = 7 THEN -1 ELSE r.value END AS value FROM points p LEFT JOIN raster r ON r.row = floor((1000 - p.y) / 10)::INT AND r.col = floor(p.x / 10)::INT)"


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    raster = spark.range(10_000).select(F.floor(F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    raster = raster.withColumn("value", ((F.col("row") * 31 + F.col("col") * 17) % 20).cast("int"))
    return spatial.sampled(points(spark, d), raster, 0.0, 1000.0, 10.0, 100, 100, nodata=7)


@query(f"WITH {SAMPLE_SQL} SELECT pid, value FROM s")
def raster_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d).select("pid", "value")


@query(f"WITH {SAMPLE_SQL} SELECT pid, CASE WHEN value IN (1, 2, 3, 4, 11, 12, 13, 14, 15) THEN 'Res' WHEN pid % 4 = 1 THEN 'Ind' ELSE 'Com' END AS occupancy FROM s")
def occupancy_assign(spark: SparkSession, d: str) -> DataFrame:
    """Residential land use wins, else the industrial pixel, else commercial."""
    industrial = F.col("pid") % 4 == 1
    return _sampled(spark, d).select("pid", F.when(F.col("value").isin(RESIDENTIAL_USES), "Res").when(industrial, "Ind").otherwise("Com").alias("occupancy"))


NEAR_SQL = "n AS (SELECT pid, sid, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) AS d2 FROM points p CROSS JOIN sites s)"


@query(f"WITH {POINTS_SQL}, {SITES_SQL}, {NEAR_SQL} SELECT pid, sid, round(sqrt(d2), 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d2, sid) = 1")
def knn_snap(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(points(spark, d), sites(spark, d)).withColumn("distance", r6("distance"))


@query(f"""WITH {POINTS_SQL}, {SITES_SQL}, {NEAR_SQL}, b AS (SELECT pid, sid, d2 FROM n WHERE d2 <= 1600 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d2, sid) = 1)
SELECT p.pid, b.sid, CASE WHEN p.pid % 3 = 0 THEN (p.pid % 50)::DOUBLE + 1 WHEN b.sid IS NOT NULL THEN (b.sid % 60)::DOUBLE + 2 END AS height FROM points p LEFT JOIN b USING (pid)""")
def knn_radius_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Own height, else that of the nearest site within 40, else null."""
    p = spatial.nearest_within(points(spark, d), sites(spark, d), 40.0)
    return p.select("pid", "sid", F.when(F.col("pid") % 3 == 0, (F.col("pid") % 50).cast("double") + 1).when(F.col("sid").isNotNull(), (F.col("sid") % 60).cast("double") + 2).alias("height"))


CAND_SQL = f"{POINTS_SQL}, {SITES_SQL}, {BOXES_SQL}, c AS (SELECT pid, bid, sqrt(greatest(x0 - x, 0, x - x1) ** 2 + greatest(y0 - y, 0, y - y1) ** 2) AS boundary, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS centre FROM points CROSS JOIN boxes)"


def _candidates(p: DataFrame, s: DataFrame) -> DataFrame:
    """Points within 40 of a square: near its centre by at most 40 plus half the diagonal, then exactly."""
    near = spatial.near(p.select("pid", "x", "y"), s, 40.0 + HALF * 2**0.5)
    c = near.join(_squares(s).withColumnRenamed("bid", "sid"), "sid").withColumn("boundary", spatial.box_distance(F.col("x"), F.col("y")))
    return c.where("boundary <= 40").select("pid", F.col("sid").alias("bid"), "boundary", F.sqrt("d2").alias("centre"))


@query(f"WITH {CAND_SQL} SELECT pid, bid, round(boundary, 6) AS boundary, round(centre, 6) AS centre FROM c WHERE boundary <= 40")
def distance_join(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(points(spark, d), sites(spark, d)).select("pid", "bid", r6("boundary").alias("boundary"), r6("centre").alias("centre"))


@query(f"WITH {POINTS_SQL}, {SITES_SQL}, {BOXES_SQL} SELECT pid, bid FROM points p LEFT JOIN boxes b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def point_in_box_left(spark: SparkSession, d: str) -> DataFrame:
    return spatial.box_join(points(spark, d), _squares(sites(spark, d)), 50.0).select("pid", "bid")


@query()
def stable_assignment(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one assignment of all customers' points to squares; iterative, tested against brute force."""
    boxes = sites(spark, d).withColumnRenamed("sid", "bid")
    return spatial.stable_places(points(spark, d).select("pid", "x", "y"), boxes, lambda p, b: _candidates(p, b.withColumnRenamed("bid", "sid")))


MATCH_SQL = f"""{PARTS_SQL}, q AS (SELECT p_partkey, p_type, split_part(mat_llrs, '/', 2) AS ld, h, p_partkey % 40 = 0 AND p_type <> 'SMALL' AS inlib FROM parts),
t AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'ECONOMY-PROMO' ELSE p_type END AS mat, split_part(ld, '+', 1) AS llrs, split_part(ld, '+', 2) AS duct, h, inlib FROM q),
c AS (SELECT a.p_partkey, lpad(b.p_partkey::VARCHAR, 9, '0') AS name,
  CASE WHEN a.mat = b.mat AND a.llrs = b.llrs AND a.duct = b.duct AND a.h = b.h THEN 1 WHEN a.mat = b.mat AND a.llrs = b.llrs AND a.duct = b.duct THEN 2 WHEN a.mat = b.mat AND a.llrs = b.llrs THEN 3 WHEN a.mat = b.mat THEN 4 WHEN a.llrs = b.llrs THEN 5 ELSE 6 END AS tier, abs(a.h - b.h) AS gap, a.h = b.h AS same
  FROM t a JOIN t b ON b.inlib AND split_part(a.mat, '-', 1) = split_part(b.mat, '-', 1)),
r AS (SELECT p_partkey, name, tier, CASE WHEN tier = 2 THEN gap WHEN tier IN (3, 5) THEN CASE WHEN same THEN 0 ELSE 1 END ELSE 0 END AS distance FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY tier, 4, name) = 1)"""


@query(f"WITH {MATCH_SQL.replace('ORDER BY tier, 4, name', 'ORDER BY tier, CASE WHEN tier = 2 THEN gap WHEN tier IN (3, 5) THEN CASE WHEN same THEN 0 ELSE 1 END ELSE 0 END, name')} SELECT t.p_partkey, r.name, r.tier::INT AS tier, r.distance::INT AS distance FROM t LEFT JOIN r USING (p_partkey)")
def tiered_match(spark: SparkSession, d: str) -> DataFrame:
    """Best curve of every building, with the tier of the match."""
    p = parts(spark, d)
    ld = F.split_part("mat_llrs", F.lit("/"), F.lit(2))
    t = p.select(
        "p_partkey", "p_type", F.when(F.col("p_type") == "PROMO", "ECONOMY-PROMO").otherwise(F.col("p_type")).alias("mat"), F.split_part(ld, F.lit("+"), F.lit(1)).alias("llrs"),
        F.split_part(ld, F.lit("+"), F.lit(2)).alias("duct"), F.col("h").cast("int").alias("height"),
    )
    library = t.where("p_partkey % 40 = 0 and p_type <> 'SMALL'").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("name"), "mat", "llrs", "duct", "height")
    return exposure.tiered_match(t.drop("p_type"), library).select("p_partkey", "name", "tier", F.col("distance").cast("int").alias("distance"))


# Nine quantiles of the standard normal distribution.
NORMALS = [-1.2816, -0.8416, -0.5244, -0.2533, 0.0, 0.2533, 0.5244, 0.8416, 1.2816]


@query(f"""WITH {SITES_SQL}, e AS (SELECT i::INT AS eid, ([{", ".join(f"{x}::DOUBLE" for x in NORMALS)}])[1 + floor(((i * 7919 + 3 * 104729) % 10007) / 10007.0::DOUBLE * 9)::INT] AS eps FROM range(100) AS t(i))
SELECT 0 AS rlzi, sid, eid, round(exp(ln(0.05::DOUBLE + x / 1000) + eps * 0.6::DOUBLE), 6) AS gmv_pga, round(exp(ln(0.1::DOUBLE + y / 1000) + eps * 0.7::DOUBLE), 6) AS gmv_sa03 FROM sites CROSS JOIN e""")
def monte_carlo_field(spark: SparkSession, d: str) -> DataFrame:
    """Lognormal ground motion of 100 events at every site: one normal number per event, shared by all sites and measures.

    Events are a literal list within each site's row, so no join is needed.
    """
    normal = F.element_at(F.array(*[F.lit(x) for x in NORMALS]), (F.floor(sampling.u(F.col("eid").cast("long"), 3) * 9) + 1).cast("int"))
    g = sites(spark, d).withColumn("eid", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("eps", normal)
    return g.select(F.lit(0).alias("rlzi"), "sid", "eid", r6(F.exp(F.log(0.05 + F.col("x") / 1000) + F.col("eps") * 0.6)).alias("gmv_pga"), r6(F.exp(F.log(0.1 + F.col("y") / 1000) + F.col("eps") * 0.7)).alias("gmv_sa03"))


WKT_SQL = """s AS (SELECT p_partkey AS id, (p_size % 20)::DOUBLE AS x, (p_partkey % 30)::DOUBLE AS y, (1 + p_size % 7)::DOUBLE AS w, (2 + p_partkey % 5)::DOUBLE AS h FROM part)"""


def _wkt(spark: SparkSession, d: str) -> DataFrame:
    """Squares as text; every eleventh is broken, every thirteenth a point."""
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(k.alias("id"), (F.col("p_size") % 20).alias("x"), (k % 30).alias("y"), (1 + F.col("p_size") % 7).alias("w"), (2 + k % 5).alias("h"))
    poly = F.format_string("POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))", *[c.cast("long") for c in (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.col("x"), F.col("y") + F.col("h"), F.col("x"), F.col("y"))])
    return s.withColumn("wkt", F.when(F.col("id") % 11 == 0, "POLYGON ((1 2, oops))").when(F.col("id") % 13 == 0, "POINT (1 2)").otherwise(poly))


@query(f"""WITH {WKT_SQL} SELECT id, CASE WHEN id % 11 = 0 THEN 'POLYGON' WHEN id % 13 = 0 THEN 'POINT' ELSE 'POLYGON' END AS kind, CASE WHEN id % 11 = 0 OR id % 13 = 0 THEN NULL ELSE 4 END::INT AS edges,
 CASE WHEN id % 11 = 0 OR id % 13 = 0 THEN NULL ELSE w * h END AS area, CASE WHEN id % 11 = 0 OR id % 13 = 0 THEN NULL ELSE round(x + w / 2, 6) END AS cx, CASE WHEN id % 11 = 0 OR id % 13 = 0 THEN NULL ELSE round(y + h / 2, 6) END AS cy FROM s""")
def wkt_parse_area(spark: SparkSession, d: str) -> DataFrame:
    """Ring, area and centroid of polygons in text; null where the text is none."""
    s = _wkt(spark, d).withColumn("e", geo.wkt_edges(F.col("wkt")))
    c = spatial.ring_centroid(F.col("e"))
    return s.select("id", F.upper(F.regexp_extract("wkt", r"^\s*([A-Za-z]+)", 1)).alias("kind"), F.when(F.col("e").isNotNull(), F.size("e")).alias("edges"), spatial.ring_area(F.col("e")).alias("area"), r6(F.when(F.col("e").isNotNull(), c["x"])).alias("cx"), r6(F.when(F.col("e").isNotNull(), c["y"])).alias("cy"))


def _utm_sql() -> str:
    e2 = spatial.WGS84_F * (2 - spatial.WGS84_F)
    ep2 = e2 / (1 - e2)
    f = lambda x: f"{x!r}::DOUBLE"
    return f"""g AS (SELECT pid, 15 + y / 100 AS lat, -102 + x / 200 AS lon FROM points), a AS (SELECT *, radians(lat) AS p, {f(e2)} AS e2, {f(ep2)} AS q FROM g),
b AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(p) ** 2) AS n, tan(p) ** 2 AS t, q * cos(p) ** 2 AS c, radians(lon + 99) * cos(p) AS a,
 6378137.0::DOUBLE * ({f(1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)} * p - {f(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)} * sin(2 * p) + {f(15 * e2**2 / 256 + 45 * e2**3 / 1024)} * sin(4 * p) - {f(35 * e2**3 / 3072)} * sin(6 * p)) AS m FROM a)
SELECT pid, round(0.9996::DOUBLE * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * q) * a ** 5 / 120) + 500000, 3) AS east,
 round(0.9996::DOUBLE * (m + n * tan(p) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * q) * a ** 6 / 720)), 3) AS north FROM b"""


@query(f"WITH {POINTS_SQL}, {_utm_sql()}")
def project_utm(spark: SparkSession, d: str) -> DataFrame:
    """Zone 14 north, central meridian -99."""
    p = points(spark, d).select("pid", (15 + F.col("y") / 100).alias("lat"), (-102 + F.col("x") / 200).alias("lon"))
    east, north = spatial.utm(F.col("lat"), F.col("lon"), -99.0)
    return p.select("pid", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query()
def polylabel(spark: SparkSession, d: str) -> DataFrame:
    """The point of every merged building's footprint that is farthest from its boundary, in metres around its corner; tested against brute force."""
    m = table(spark, d, "merged_buildings").select("uid", geo.wkt_edges(F.col("wkt")).alias("e")).where("e is not null")
    first = F.element_at("e", 1)
    kx = F.cos(F.radians(first["y1"])) * 111_320.0
    local = F.transform("e", lambda s: F.struct(((s.x1 - first["x1"]) * kx).alias("x1"), ((s.y1 - first["y1"]) * 110_574.0).alias("y1"), ((s.x2 - first["x1"]) * kx).alias("x2"), ((s.y2 - first["y1"]) * 110_574.0).alias("y2")))
    out = m.withColumn("p", spatial.polylabel(0.1)(local))
    return out.select("uid", F.round(first["x1"] + F.col("p.x") / kx, 7).alias("lon"), F.round(first["y1"] + F.col("p.y") / 110_574.0, 7).alias("lat"), F.round("p.distance", 3).alias("clearance_m"))


@query(f"WITH {WKT_SQL} SELECT id, count(*) AS inside FROM s, range(40) AS a(c), range(40) AS b(r) WHERE id % 11 <> 0 AND id % 13 <> 0 AND c + 0.5 > x AND c + 0.5 < x + w AND r + 0.5 > y AND r + 0.5 < y + h GROUP BY id")
def rasterise_mask(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of a 40 x 40 grid whose centre is inside the polygon: only pixels of its bounding box are made."""
    s = _wkt(spark, d).select("id", geo.wkt_edges(F.col("wkt")).alias("e")).where("e is not null")
    span = lambda k: F.sequence(F.greatest(F.lit(0), F.floor(F.array_min(F.transform("e", lambda a: a[k])))), F.least(F.lit(39), F.floor(F.array_max(F.transform("e", lambda a: a[k])))))
    px = s.withColumn("c", F.explode(span("x1"))).withColumn("r", F.explode(span("y1")))
    return px.where(geo.crossings_odd(F.col("e"), F.col("c") + 0.5, F.col("r") + 0.5)).groupBy("id").agg(F.count(F.lit(1)).alias("inside"))
