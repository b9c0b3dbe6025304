"""Queries of heatmaps, embeddings and masks. Embeddings are read as 8 x 8 heatmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.operators import heatmaps as H
from slatework.operators import sampling
from slatework.plans.base import HEAT_SQL, query, r6
from slatework.session import table

KEYS = ["image_id", "method"]


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("method"), H.doubles(F.col("embedding")).alias("a"))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return H.pixels(_arrays(spark, d), KEYS, "a", 8)


NORM_SQL = """norm AS (SELECT image_id, method, sum(v) AS raw_sum, sum(abs(v)) AS abs_sum, min(v) AS raw_min, max(v) AS raw_max,
 CASE WHEN sum(abs(v)) <= 1e-12 THEN 0.0::DOUBLE ELSE sum(greatest(-v, 0)) / sum(abs(v)) END AS negative_mass_ratio, sum(abs(v)) <= 1e-12 AS is_zero_sum FROM heat GROUP BY ALL)"""
DIST = "sqrt((x - 3.5::DOUBLE) * (x - 3.5::DOUBLE) + (y - 3.5::DOUBLE) * (y - 3.5::DOUBLE))"
STATS_SQL = f"""{HEAT_SQL}, {NORM_SQL},
px AS (SELECT *, abs(v) AS a, {DIST} / sqrt(24.5::DOUBLE) AS d, greatest(2 * abs(x - 3.5::DOUBLE) / 8, 2 * abs(y - 3.5::DOUBLE) / 8) AS sq FROM heat),
bk AS (SELECT *, greatest(0, ceil(d * 511 - 1e-9))::INT AS kr, greatest(0, ceil(511 * sq - 1e-9))::INT AS ks FROM px),
base AS (SELECT image_id, method, sum(a) AS mass, sum(a * x) / sum(a) AS cx, sum(a * y) / sum(a) AS cy,
  sum(a) FILTER (d <= 0.2) / sum(a) AS b0, coalesce(sum(a) FILTER (d > 0.2 AND d <= 0.4), 0) / sum(a) AS b1, coalesce(sum(a) FILTER (d > 0.4 AND d <= 0.6), 0) / sum(a) AS b2,
  coalesce(sum(a) FILTER (d > 0.6 AND d <= 0.8), 0) / sum(a) AS b3, coalesce(sum(a) FILTER (d > 0.8 AND d <= 1.0), 0) / sum(a) AS b4,
  coalesce(sum(a) FILTER (abs(x - 3.5) <= 2 AND abs(y - 3.5) <= 2), 0) / sum(a) AS s25, coalesce(sum(a) FILTER (abs(x - 3.5) <= 4 * sqrt(0.5::DOUBLE) AND abs(y - 3.5) <= 4 * sqrt(0.5::DOUBLE)), 0) / sum(a) AS s50,
  arg_max(struct_pack(x := x, y := y), struct_pack(v := v, p := -pos)) AS peak FROM bk GROUP BY ALL),
hr AS (SELECT image_id, min(k) / 511.0::DOUBLE AS r FROM (SELECT image_id, kr AS k, sum(sum(a)) OVER (PARTITION BY image_id ORDER BY kr) / sum(sum(a)) OVER (PARTITION BY image_id) AS c FROM bk GROUP BY image_id, kr) WHERE c >= 0.5 - 1e-12 GROUP BY 1),
hs AS (SELECT image_id, min(k) / 511.0::DOUBLE AS s FROM (SELECT image_id, ks AS k, sum(sum(a)) OVER (PARTITION BY image_id ORDER BY ks) / sum(sum(a)) OVER (PARTITION BY image_id) AS c FROM bk GROUP BY image_id, ks) WHERE c >= 0.5 - 1e-12 GROUP BY 1),
stats AS (SELECT base.image_id, base.method, coalesce(b0, 0) AS radial_profile_0, b1 AS radial_profile_1, b2 AS radial_profile_2, b3 AS radial_profile_3, b4 AS radial_profile_4, s25 AS mass_center_25_square, s50 AS mass_center_50_square,
  cx AS centroid_x, cy AS centroid_y, sqrt((cx - 3.5) ** 2 + (cy - 3.5) ** 2) AS centroid_offset_px, least(1.0::DOUBLE, greatest(sqrt((cx - 3.5) ** 2 + (cy - 3.5) ** 2), sqrt(0.5::DOUBLE)) / sqrt(24.5::DOUBLE)) AS centroid_offset_norm,
  peak.x AS peak_x, peak.y AS peak_y, sqrt((peak.x - 3.5::DOUBLE) ** 2 + (peak.y - 3.5::DOUBLE) ** 2) AS peak_offset_px, sqrt((peak.x - 3.5::DOUBLE) ** 2 + (peak.y - 3.5::DOUBLE) ** 2) / sqrt(24.5::DOUBLE) AS peak_offset_norm,
  least(r, 1.0::DOUBLE) AS radius_for_50_mass_radial, least(s, 1.0::DOUBLE) AS radius_for_50_mass_square, least(s, 1.0::DOUBLE) - least(r, 1.0::DOUBLE) AS radius_50_gap, negative_mass_ratio, is_zero_sum
  FROM base JOIN hr USING (image_id) JOIN hs USING (image_id) JOIN norm USING (image_id))"""


def _pick(*cols: str) -> str:
    return f"WITH {STATS_SQL} SELECT image_id, method, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + " FROM stats"


def _stats(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    s = H.statistics(_pixels(spark, d), KEYS, 8, 8)
    return s.select(*KEYS, *[r6(c).alias(c) for c in cols]) if cols else s


@query(f"WITH {HEAT_SQL}, {NORM_SQL} SELECT image_id, method, round(raw_sum, 6) AS raw_sum, round(abs_sum, 6) AS abs_sum, round(raw_min, 6) AS raw_min, round(raw_max, 6) AS raw_max, round(negative_mass_ratio, 6) AS negative_mass_ratio, is_zero_sum FROM norm")
def heatmap_normalise(spark: SparkSession, d: str) -> DataFrame:
    n = H.normalised(_pixels(spark, d), KEYS)
    return n.select(*KEYS, *[r6(c).alias(c) for c in ("raw_sum", "abs_sum", "raw_min", "raw_max", "negative_mass_ratio")], "is_zero_sum")


RINGS = [f"radial_profile_{i}" for i in range(5)]


@query(_pick(*RINGS))
def radial_profile(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, *RINGS)


@query(_pick("centroid_x", "centroid_y", "centroid_offset_px", "centroid_offset_norm"))
def heatmap_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, "centroid_x", "centroid_y", "centroid_offset_px", "centroid_offset_norm")


@query(f"WITH {STATS_SQL} SELECT image_id, method, peak_x, peak_y, round(peak_offset_px, 6) AS peak_offset_px, round(peak_offset_norm, 6) AS peak_offset_norm FROM stats")
def heatmap_peak(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select(*KEYS, "peak_x", "peak_y", r6("peak_offset_px").alias("peak_offset_px"), r6("peak_offset_norm").alias("peak_offset_norm"))


HALVES = ["radius_for_50_mass_radial", "radius_for_50_mass_square"]


@query(_pick(*HALVES))
def half_mass_radius(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, *HALVES)


ALL_STATS = [*RINGS, "mass_center_25_square", "mass_center_50_square", "centroid_x", "centroid_y", "centroid_offset_norm", "peak_offset_norm", *HALVES, "radius_50_gap"]


@query(_pick(*ALL_STATS, "negative_mass_ratio"))
def heatmap_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d)
    return s.select(*KEYS, *[r6(c).alias(c) for c in [*ALL_STATS, "negative_mass_ratio"]])


_FOUR = ["mass_center_25_square", "mass_center_50_square", *HALVES[::-1]]
_THREE = ["radius_50_gap", "centroid_offset_norm", "peak_offset_norm"]


@query(f"WITH {STATS_SQL} SELECT method, count(*) AS num_images, count(*) FILTER (is_zero_sum) AS zero_sum_images, round(avg(negative_mass_ratio), 6) AS mean_negative_mass_ratio, "
       + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS median_{c}, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr_{c}" for c in _FOUR) + ", "
       + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS median_{c}" for c in _THREE) + ", round(avg((mass_center_25_square > 0.5)::INT), 6) AS fraction_center25_over_50pct FROM stats GROUP BY method")
def heatmap_summary(spark: SparkSession, d: str) -> DataFrame:
    s = H.summarised(_stats(spark, d), ["method"])
    return s.select("method", "num_images", "zero_sum_images", *[r6(c).alias(c) for c in s.columns if c not in ("method", "num_images", "zero_sum_images")])


@query(f"WITH {STATS_SQL} SELECT method, ring, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS std FROM (UNPIVOT (SELECT method, " + ", ".join(RINGS) + " FROM stats) ON " + ", ".join(RINGS) + " INTO NAME ring VALUE share) GROUP BY method, ring")
def radial_profile_summary(spark: SparkSession, d: str) -> DataFrame:
    s = H.profile_summary(_stats(spark, d), ["method"])
    return s.select("method", "ring", r6("mean").alias("mean"), r6("std").alias("std"))


def _out(df: DataFrame, value: str = "r") -> DataFrame:
    return df.select("image_id", F.posexplode(value).alias("pos", "v")).select("image_id", "pos", r6("v").alias("v"))


@query(f"WITH {HEAT_SQL} SELECT image_id, pos, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0.0::DOUBLE END, 6) AS v FROM heat WINDOW w AS (PARTITION BY image_id)")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    return _out(_arrays(spark, d).withColumn("r", H.minmax(F.col("a"))))


@query(f"""WITH {HEAT_SQL}, h AS (SELECT image_id, pos, CASE WHEN image_id % 5 = 0 THEN -abs(v) ELSE v END AS v FROM heat),
f AS (SELECT image_id, pos, CASE WHEN max(v) OVER w <= 1e-12 AND max(abs(v)) OVER w > 1e-12 THEN abs(v) ELSE greatest(v, 0) END AS v FROM h WINDOW w AS (PARTITION BY image_id))
SELECT image_id, pos, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0.0::DOUBLE END, 6) AS v FROM f WINDOW w AS (PARTITION BY image_id)""")
def relu_fallback_scale(spark: SparkSession, d: str) -> DataFrame:
    a = _arrays(spark, d).withColumn("a", F.when(F.col("image_id") % 5 == 0, F.transform("a", lambda v: -F.abs(v))).otherwise(F.col("a")))
    return _out(a.withColumn("r", H.relu_or_abs(F.col("a"))))


# Mean and deviation of three channels.
CHANNEL_MEAN, CHANNEL_STD = [0.48145466, 0.4578275, 0.40821073], [0.26862954, 0.26130258, 0.27577711]


@query(f"""WITH {HEAT_SQL}, c AS (SELECT * FROM (VALUES (0, 0.48145466::DOUBLE, 0.26862954::DOUBLE), (1, 0.4578275::DOUBLE, 0.26130258::DOUBLE), (2, 0.40821073::DOUBLE, 0.27577711::DOUBLE)) AS t(c, m, s))
SELECT image_id, pos, round((v - m) / s, 6) AS standard, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v - m) / s * s + m)), 6) AS back FROM heat JOIN c ON pos % 3 = c.c""")
def channel_standardise(spark: SparkSession, d: str) -> DataFrame:
    at = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("pos") % 3 + 1)
    m, s = at(CHANNEL_MEAN), at(CHANNEL_STD)
    z = (F.col("v") - m) / s
    return _pixels(spark, d).select("image_id", "pos", r6(z).alias("standard"), r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), z * s + m))).alias("back"))


@query(f"WITH {HEAT_SQL} SELECT image_id, (pos % 16)::INT AS pos, round(avg(v), 6) AS mean, round(sum(abs(v)), 6) AS abs_sum, round(sum(greatest(v, 0)), 6) AS positive FROM heat GROUP BY image_id, pos % 16")
def channel_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Four channels of 4 x 4 reduced in three ways, within the row."""
    a = F.col("a")
    z = _arrays(spark, d).select("image_id", F.posexplode(F.arrays_zip(*[H.channels(a, 4, 16, k).alias(n) for k, n in (("mean", "mean"), ("abs", "abs_sum"), ("positive", "positive"))])).alias("pos", "z"))
    return z.select("image_id", "pos", r6("z.mean").alias("mean"), r6("z.abs_sum").alias("abs_sum"), r6("z.positive").alias("positive"))


@query(f"WITH {HEAT_SQL} SELECT image_id, ((pos // 4 - 1) % 3)::INT AS x, ((pos // 4 - 1) // 3)::INT AS y, round(avg(v), 6) AS v FROM heat WHERE pos >= 4 GROUP BY image_id, pos // 4")
def token_grid(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen tokens of four channels: means over the channels, without the class token, on a 3 x 5 grid."""
    tokens = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda t: F.aggregate(F.slice("a", t * 4 + 1, F.lit(4)), F.lit(0.0), lambda s, v: s + v) / 4)
    return _arrays(spark, d).select("image_id", F.posexplode(tokens).alias("p", "v")).select("image_id", (F.col("p") % 3).alias("x"), F.floor(F.col("p") / 3).cast("int").alias("y"), r6("v").alias("v"))


@query(f"""WITH {HEAT_SQL}, m AS (SELECT image_id, method, pos, CASE WHEN ((image_id * 64 + pos) * 7919 + 7 * 104729) % 10007 / 10007.0::DOUBLE < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m, avg(v) OVER (PARTITION BY image_id) AS s FROM heat)
SELECT method, pos, round(sum(s * m) / greatest(sum(m), 1e-12), 6) AS v FROM m GROUP BY method, pos""")
def mask_weighted_average(spark: SparkSession, d: str) -> DataFrame:
    """Per method the average score of the Bernoulli masks that keep a pixel; one score per mask."""
    a = _arrays(spark, d).withColumn("s", F.aggregate("a", F.lit(0.0), lambda s, v: s + v) / F.size("a"))
    px = a.select("image_id", "method", "s", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    m = px.withColumn("m", F.when(sampling.u(F.col("image_id") * 64 + F.col("pos"), 7) < 0.5, 1.0).otherwise(0.0))
    return m.groupBy("method", "pos").agg(r6(F.sum(F.col("s") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-12))).alias("v"))


@query("""WITH g AS (SELECT i::INT AS i, greatest((i % 16 + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5::DOUBLE, 0) AS sx, greatest((i // 16 + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5::DOUBLE, 0) AS sy FROM range(256) AS t(i)),
q AS (SELECT i, sx, sy, least(floor(sx), 7)::INT AS x0, least(floor(sy), 7)::INT AS y0 FROM g), k AS (SELECT i, x0, y0, least(x0 + 1, 7) AS x1, least(y0 + 1, 7) AS y1, sx - x0 AS fx, sy - y0 AS fy FROM q)
SELECT vec_id AS image_id, i AS pos, round((embedding[y0 * 8 + x0 + 1]::DOUBLE * (1 - fx) + embedding[y0 * 8 + x1 + 1]::DOUBLE * fx) * (1 - fy) + (embedding[y1 * 8 + x0 + 1]::DOUBLE * (1 - fx) + embedding[y1 * 8 + x1 + 1]::DOUBLE * fx) * fy, 6) AS v
FROM embeddings CROSS JOIN k""")
def bilinear_upsample(spark: SparkSession, d: str) -> DataFrame:
    return _out(_arrays(spark, d).withColumn("r", H.bilinear(F.col("a"), 8, 8, 16, 16)))


MATRIX_SQL = f"""{HEAT_SQL}, g AS (SELECT image_id, method, x, y, greatest(v, 0) + (x = y)::INT AS v FROM heat), n AS (SELECT image_id, method, x, y, v / greatest(sum(v) OVER (PARTITION BY image_id, y), 1e-6) AS v FROM g)"""


@query(f"WITH {MATRIX_SQL} SELECT image_id, (y * 8 + x)::INT AS pos, round(v, 6) AS v FROM n")
def row_normalise_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _out(_arrays(spark, d).withColumn("r", H.row_normalised(F.col("a"), 8)))


@query(f"""WITH {MATRIX_SQL}, z AS (SELECT j, k, p // 8 AS y, p % 8 AS x FROM (SELECT DISTINCT image_id // 3 AS j FROM n) CROSS JOIN range(3) AS a(k) CROSS JOIN range(64) AS b(p)),
l AS (SELECT z.j, z.k, z.y, z.x, coalesce(n.v, (z.x = z.y)::INT::DOUBLE) AS v FROM z LEFT JOIN n ON n.image_id = z.j * 3 + z.k AND n.x = z.x AND n.y = z.y),
ab AS (SELECT a.j, b.y, a.x, sum(b.v * a.v) AS v FROM l b JOIN l a ON a.j = b.j AND b.x = a.y WHERE a.k = 0 AND b.k = 1 GROUP BY ALL), abc AS (SELECT ab.j, c.y, ab.x, sum(c.v * ab.v) AS v FROM l c JOIN ab ON ab.j = c.j AND c.x = ab.y WHERE c.k = 2 GROUP BY ALL)
SELECT j AS chain, (x - 1)::INT AS patch, round(v, 6) AS v FROM abc WHERE y = 0 AND x > 0""")
def matrix_chain(spark: SparkSession, d: str) -> DataFrame:
    """Rollout over three layers: the product of their normalised matrices, class-token row without itself.

    Every three images in order of their ids stand for the layers of a chain; a layer that the last chain lacks is the identity.
    """
    a = _arrays(spark, d).select(F.floor(F.col("image_id") / 3).alias("chain"), (F.col("image_id") % 3).alias("k"), H.row_normalised(F.col("a"), 8).alias("m"))
    same = F.array(*[F.lit(1.0 if i % 9 == 0 else 0.0) for i in range(64)])
    layers = a.groupBy("chain").agg(*[F.coalesce(F.max(F.when(F.col("k") == i, F.col("m"))), same).alias(f"m{i}") for i in range(3)])
    product = layers.withColumn("p", H.matrix_product(F.col("m1"), F.col("m0"), 8)).withColumn("p", H.matrix_product(F.col("m2"), F.col("p"), 8))
    return product.select("chain", F.posexplode(F.slice("p", F.lit(2), F.lit(7))).alias("patch", "v")).select("chain", "patch", r6("v").alias("v"))


SIM_SQL = f"""{HEAT_SQL}, p AS (SELECT method AS class, pos, avg(v) AS v FROM heat GROUP BY ALL), pn AS (SELECT class, sqrt(sum(v * v)) AS n FROM p GROUP BY 1), hn AS (SELECT image_id, sqrt(sum(v * v)) AS n FROM heat GROUP BY 1),
sim AS (SELECT h.image_id, any_value(h.method) AS label, p.class, 100 * sum(h.v * p.v) / (any_value(hn.n) * any_value(pn.n)) AS s FROM heat h JOIN p ON p.pos = h.pos JOIN pn ON pn.class = p.class JOIN hn ON hn.image_id = h.image_id GROUP BY h.image_id, p.class)"""


def _similarities(spark: SparkSession, d: str) -> DataFrame:
    """image_id, label, sims: an array of (class, similarity) to the mean embedding of every class."""
    a = _arrays(spark, d)
    means = _pixels(spark, d).groupBy("method", "pos").agg(F.avg("v").alias("v")).groupBy("method").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s.v).alias("c"))
    # One row with all prototypes; classes are a vocabulary, so their number is bounded and checked.
    if means.count() > 10_000:
        raise ValueError("too many classes for prototypes in one row")
    protos = means.agg(F.sort_array(F.collect_list(F.struct("method", "c"))).alias("protos")).withColumn("one", F.lit(1))
    j = a.withColumn("one", F.lit(1)).join(F.broadcast(protos), "one")
    return j.select("image_id", F.col("method").alias("label"), F.transform("protos", lambda p: F.struct(p.method.alias("class"), (100 * H.cosine(F.col("a"), p.c)).alias("s"))).alias("sims"))


@query(f"WITH {SIM_SQL} SELECT image_id, label, class AS predicted, round(s, 4) AS similarity FROM sim QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY s DESC, class) = 1")
def cosine_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Nearest class prototype by cosine, times 100; the first class on ties."""
    best = F.array_max(F.transform("sims", lambda x: F.struct(x.s.alias("s"), (-x["class"]).alias("n"))))
    return _similarities(spark, d).select("image_id", "label", (-best["n"]).alias("predicted"), r6(best["s"], 4).alias("similarity"))


@query(f"""WITH {SIM_SQL}, e AS (SELECT image_id, class, exp(s - max(s) OVER (PARTITION BY image_id)) AS e, s FROM sim)
SELECT image_id, class, round(e / sum(e) OVER (PARTITION BY image_id), 6) AS p, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, class)::INT AS rank FROM e QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY s DESC, class) <= 5""")
def softmax_topk(spark: SparkSession, d: str) -> DataFrame:
    """Five most likely classes of every image, within the row."""
    s = _similarities(spark, d).withColumn("top", F.array_max(F.transform("sims", lambda x: x.s)))
    s = s.withColumn("total", F.aggregate("sims", F.lit(0.0), lambda t, x: t + F.exp(x.s - F.col("top"))))
    ranked = F.slice(F.array_sort(F.transform("sims", lambda x: F.struct((-x.s).alias("n"), x["class"].alias("class"), (F.exp(x.s - F.col("top")) / F.col("total")).alias("p")))), F.lit(1), F.lit(5))
    return s.select("image_id", F.posexplode(ranked).alias("r", "x")).select("image_id", "x.class", r6("x.p").alias("p"), (F.col("r") + 1).alias("rank"))


@query(f"""WITH {HEAT_SQL}, n AS (SELECT image_id, image_id // 8 AS batch, image_id % 8 AS slot, pos, v / sqrt(sum(v * v) OVER (PARTITION BY image_id)) AS v FROM heat),
l AS (SELECT a.batch, a.slot AS i, b.slot AS j, sum(a.v * CASE WHEN b.pos % 2 = 0 THEN b.v ELSE b.v * 0.5::DOUBLE END) / 0.07::DOUBLE AS z FROM n a JOIN n b ON a.batch = b.batch AND a.pos = b.pos GROUP BY ALL),
c AS (SELECT batch, i, j, z - max(z) OVER (PARTITION BY batch, i) - ln(sum(exp(z - mx)) OVER (PARTITION BY batch, i)) AS rowlp, z - max(z) OVER (PARTITION BY batch, j) - ln(sum(exp(z - my)) OVER (PARTITION BY batch, j)) AS collp
  FROM (SELECT *, max(z) OVER (PARTITION BY batch, i) AS mx, max(z) OVER (PARTITION BY batch, j) AS my FROM l)),
k AS (SELECT batch, count(DISTINCT i) AS m, -(avg(rowlp) FILTER (i = j)) * 0.9::DOUBLE - avg(rowlp) * 0.1::DOUBLE AS a, -(avg(collp) FILTER (i = j)) * 0.9::DOUBLE - avg(collp) * 0.1::DOUBLE AS b FROM c GROUP BY batch)
SELECT batch, m AS n, round((a + b) / 2, 6) AS loss FROM k""")
def contrastive_loss(spark: SparkSession, d: str) -> DataFrame:
    """Two-way cross entropy in batches of eight, temperature 0.07, label smoothing 0.1. A batch is one row: its size is fixed."""
    a = _arrays(spark, d).select(F.floor(F.col("image_id") / 8).alias("batch"), (F.col("image_id") % 8).alias("slot"), F.col("a"))
    unit = F.transform("a", lambda v: v / F.sqrt(H.dot(F.col("a"), F.col("a"))))
    a = a.select("batch", "slot", unit.alias("u")).withColumn("t", F.transform("u", lambda v, i: F.when(i % 2 == 0, v).otherwise(v * 0.5)))
    g = a.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("slot", "u", "t"))).alias("g"))
    z = F.transform("g", lambda x: F.transform("g", lambda y: H.dot(x.u, y.t) / 0.07))
    g = g.select("batch", F.size("g").alias("n"), z.alias("z"))
    g = g.withColumn("zt", F.transform("z", lambda r, i: F.transform("z", lambda q: F.element_at(q, i + 1))))

    def entropy(m: str):
        def row(r, i):
            top = F.array_max(r)
            lse = top + F.log(F.aggregate(r, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
            return -(0.9 * (F.element_at(r, i + 1) - lse) + 0.1 * (F.aggregate(r, F.lit(0.0), lambda s, v: s + (v - lse)) / F.col("n")))

        return F.aggregate(F.transform(m, row), F.lit(0.0), lambda s, v: s + v) / F.col("n")

    return g.select("batch", F.col("n").cast("long").alias("n"), r6((entropy("z") + entropy("zt")) / 2).alias("loss"))



