"""Queries on repeated runs: damage classes, percentages, confusion, distributions and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatework.operators import damage, sampling, tables
from slatework.plans.base import CLASSES_SQL, PARTS_SQL, RUNS_SQL, parts, query, r6, runs
from slatework.session import table

KEYS = ["mode", "seed"]


@query(f"WITH {RUNS_SQL} SELECT branch, pred_class, count(*) AS n, count(DISTINCT asset_id) AS assets FROM runs GROUP BY ALL")
def hybrid_classify(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy("branch", "pred_class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("asset_id").alias("assets"))


@query(f"""WITH {RUNS_SQL}, {CLASSES_SQL}, t AS (SELECT mode, seed, count(*) AS a FROM runs GROUP BY ALL)
SELECT t.mode, t.seed, c AS pred_class, count(r.mode) AS n, round(100.0::DOUBLE * count(r.mode) / any_value(a), 4) AS pct
FROM t CROSS JOIN classes LEFT JOIN runs r ON r.mode = t.mode AND r.seed = t.seed AND r.pred_class = c GROUP BY t.mode, t.seed, c""")
def class_percentages(spark: SparkSession, d: str) -> DataFrame:
    return damage.class_percentages(runs(spark, d), KEYS, "pred_class").withColumn("pct", r6("pct", 4))


@query(f"""WITH {RUNS_SQL}, {CLASSES_SQL}, t AS (SELECT mode, seed, count(*) AS a FROM runs GROUP BY ALL),
g AS (SELECT t.mode, t.seed, c, 100.0::DOUBLE * count(r.mode) / any_value(a) AS pct FROM t CROSS JOIN classes LEFT JOIN runs r ON r.mode = t.mode AND r.seed = t.seed AND r.pred_class = c GROUP BY t.mode, t.seed, c)
SELECT mode, c AS pred_class, round(avg(pct), 4) AS mean_pct, round(stddev_samp(pct), 4) AS std_pct,
 round(greatest(0.0::DOUBLE, avg(pct) - 2 * stddev_samp(pct)), 4) AS ci_lo, round(least(100.0::DOUBLE, avg(pct) + 2 * stddev_samp(pct)), 4) AS ci_hi, count(*) AS n_runs FROM g GROUP BY mode, c""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: classify, percentages per run, then mean and two-sigma bounds over runs."""
    s = damage.interval_summary(damage.class_percentages(runs(spark, d), KEYS, "pred_class"), ["mode", "pred_class"], "pct", 0.0, 100.0)
    return s.select("mode", "pred_class", r6("mean", 4).alias("mean_pct"), r6("std", 4).alias("std_pct"), r6("lo", 4).alias("ci_lo"), r6("hi", 4).alias("ci_hi"), "n_runs")


CELLS_SQL = f"""{RUNS_SQL}, {CLASSES_SQL}, k AS (SELECT DISTINCT mode, seed FROM runs),
cells AS (SELECT k.mode, k.seed, a.c AS true_class, b.c AS pred_class, count(r.mode) AS n
 FROM k CROSS JOIN classes a CROSS JOIN classes b LEFT JOIN runs r ON r.mode = k.mode AND r.seed = k.seed AND r.true_class = a.c AND r.pred_class = b.c GROUP BY ALL),
shares AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY mode, seed, true_class), 0), 0.0::DOUBLE)::DOUBLE AS share FROM cells)"""


@query(f"WITH {CELLS_SQL} SELECT * FROM cells")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return damage.confusion_counts(runs(spark, d), KEYS, "true_class", "pred_class")


@query(f"WITH {CELLS_SQL} SELECT mode, seed, true_class, pred_class, n, round(share, 6) AS share FROM shares")
def confusion_normalised(spark: SparkSession, d: str) -> DataFrame:
    return damage.row_normalised(confusion_counts(spark, d), KEYS).withColumn("share", r6("share"))


@query(f"""WITH {CELLS_SQL} SELECT mode, true_class, pred_class, round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS std,
 round(greatest(0.0::DOUBLE, avg(share) - 2 * stddev_samp(share)), 6) AS lo, round(least(1.0::DOUBLE, avg(share) + 2 * stddev_samp(share)), 6) AS hi, count(*) AS n_runs FROM shares GROUP BY ALL""")
def confusion_stats(spark: SparkSession, d: str) -> DataFrame:
    cells = damage.row_normalised(confusion_counts(spark, d), KEYS)
    s = damage.interval_summary(cells, ["mode", "true_class", "pred_class"], "share", 0.0, 1.0)
    return s.select("mode", "true_class", "pred_class", *[r6(c).alias(c) for c in ("mean", "std", "lo", "hi")], "n_runs")


@query(f"WITH {RUNS_SQL} SELECT mode, round(avg((true_class = pred_class)::INT), 6) AS accuracy, count(*) AS n FROM runs WHERE true_class IS NOT NULL AND pred_class IS NOT NULL GROUP BY mode")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return damage.accuracy(runs(spark, d), ["mode"], "true_class", "pred_class").withColumn("accuracy", r6("accuracy"))


@query("SELECT DISTINCT p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS code FROM part WHERE p_type IS NOT NULL")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    """Alphabetical codes of a label from 0; the window is over the distinct labels."""
    labels = table(spark, d, "part").where("p_type is not null").select("p_type").distinct()
    return labels.select("p_type", (F.dense_rank().over(Window.orderBy("p_type")) - 1).cast("int").alias("code"))


@query("SELECT p_brand, p_type, sum(p_size)::DOUBLE AS weight, round(sum(p_size) / sum(sum(p_size)) OVER (PARTITION BY p_brand), 6) AS p FROM part GROUP BY p_brand, p_type")
def conditional_distribution(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("w", F.col("p_size").cast("double"))
    return sampling.distribution(p, ["p_brand"], "p_type", "w").withColumn("p", r6("p"))


# The brand drawn from is built from the customer's key; one brand in 26 is unknown.
DRAW_SQL = """
dist AS (SELECT p_brand, p_type, sum(p_size)::DOUBLE AS w FROM part GROUP BY ALL),
cdf AS (SELECT p_brand, p_type, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_type DESC) = 1 THEN 1.0::DOUBLE
   ELSE sum(w) OVER (PARTITION BY p_brand ORDER BY p_type) / sum(w) OVER (PARTITION BY p_brand) END AS hi FROM dist)"""


@query(f"""WITH {DRAW_SQL}, c AS (SELECT c_custkey, 'Brand#' || (1 + c_custkey % 26)::VARCHAR AS brand, ((c_custkey * 7919 + 42 * 104729) % 10007) / 10007.0::DOUBLE AS u FROM customer)
SELECT c.c_custkey, c.brand, coalesce(min(p_type), '501') AS drawn FROM c LEFT JOIN cdf ON cdf.p_brand = c.brand AND cdf.hi > c.u GROUP BY ALL""")
def conditional_sample(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Brand#"), (1 + F.col("c_custkey") % 26).cast("string")).alias("brand"), sampling.u(F.col("c_custkey"), 42).alias("u"))
    dist = sampling.distribution(table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("drawn"), F.col("p_size").cast("double").alias("w")), ["brand"], "drawn", "w")
    return sampling.drawn(c, dist, ["brand"], "drawn", "u").select("c_custkey", "brand", F.coalesce("drawn", F.lit("501")).alias("drawn"))


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type, n FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1""")
def group_argmax(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).withColumn("less", -F.col("n"))
    return tables.first_values(n, ["p_brand"], ["less", "p_type"], ["p_type", "n"])


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY ((c_custkey * 7919 + 42 * 104729) % 10007) / 10007.0::DOUBLE, c_custkey) <= 10")
def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_per_group(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 10, 42)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20")
def topk_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc_nulls_last(), "p_partkey").limit(20)


@query("SELECT coalesce(material_class, 'Unknown') AS label, count(*) AS n, round(1.0::DOUBLE / count(*), 9) AS weight FROM building_metadata GROUP BY ALL")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Inverse-frequency weights per label: one aggregation instead of a window over all rows."""
    b = table(spark, d, "building_metadata").select(F.coalesce("material_class", F.lit("Unknown")).alias("label"))
    return b.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.round(1.0 / F.col("n"), 9))


# Which taxonomies a building may get, by occupancy and wall code (decision table of the material-aware mode).
ASSIGN_SQL = f"""{PARTS_SQL},
b AS (SELECT p_partkey, h, CASE p_partkey % 3 WHEN 0 THEN 'RES' WHEN 1 THEN 'COM' ELSE 'IND' END AS occ,
   CASE p_type WHEN 'ECONOMY' THEN 10 WHEN 'LARGE' THEN 34 WHEN 'MEDIUM' THEN 23 WHEN 'PROMO' THEN 45 WHEN 'SMALL' THEN 99 ELSE NULL END AS roof FROM parts),
lib AS (SELECT * FROM (VALUES ('RES', 'CR/LFINF+DUC/H2/RES', 30.0::DOUBLE), ('RES', 'MCF/LWAL+DNO/H1/RES', 50.0::DOUBLE), ('RES', 'MUR/LWAL+DNO/H1/RES', 20.0::DOUBLE), ('RES', 'W/LPB+DUL/H1/RES', 5.0::DOUBLE), ('COM', 'CR/LDUAL+DUC/H5/COM', 40.0::DOUBLE), ('COM', 'MUR/LWAL+DNO/H2/COM', 10.0::DOUBLE), ('COM', 'S/LFM+DUM/H3/COM', 9.0::DOUBLE)) AS t(occ, tax, w)),
wall AS (SELECT * FROM (VALUES (10, 501, 6.0::DOUBLE), (10, 208, 4.0::DOUBLE), (34, 300, 3.0::DOUBLE), (34, 527, 5.0::DOUBLE), (34, 600, 2.0::DOUBLE), (23, 501, 1.0::DOUBLE), (99, 527, 1.0::DOUBLE), (99, 210, 1.0::DOUBLE)) AS t(roof, wall, w)),
wcdf AS (SELECT roof, wall, CASE WHEN row_number() OVER (PARTITION BY roof ORDER BY wall DESC) = 1 THEN 1.0::DOUBLE ELSE sum(w) OVER (PARTITION BY roof ORDER BY wall) / sum(w) OVER (PARTITION BY roof) END AS hi FROM wall),
bw AS (SELECT b.*, ((p_partkey * 7919 + 1 * 104729) % 10007) / 10007.0::DOUBLE AS u1, ((p_partkey * 7919 + 2 * 104729) % 10007) / 10007.0::DOUBLE AS u2 FROM b),
walls AS (SELECT bw.p_partkey, any_value(bw.h) AS h, any_value(bw.occ) AS occ, any_value(bw.roof) AS roof, any_value(u2) AS u2, coalesce(min(wall), 501) AS wall FROM bw LEFT JOIN wcdf ON wcdf.roof = bw.roof AND wcdf.hi > bw.u1 GROUP BY bw.p_partkey),
md AS (SELECT walls.*, mode FROM walls CROSS JOIN (SELECT unnest(['material', 'benchmark', 'unreinforced', 'reinforced']) AS mode)),
pat AS (SELECT *, CASE WHEN mode = 'benchmark' THEN ''
   WHEN occ = 'RES' AND wall IN (501, 527) THEN CASE mode WHEN 'reinforced' THEN 'MCF|MR|CR' WHEN 'unreinforced' THEN 'MUR' ELSE CASE WHEN roof IN (21, 34, 40, 41, 45, 71, 72) THEN 'MUR' ELSE 'MCF|MR|CR' END END
   WHEN occ = 'RES' AND wall BETWEEN 200 AND 299 THEN 'INF' WHEN occ = 'RES' AND wall = 300 THEN 'W' WHEN occ = 'RES' THEN ''
   WHEN roof IN (34, 45, 72) THEN 'MCF|MR|CR' ELSE 'MUR' END AS pattern FROM md),
pats AS (SELECT DISTINCT occ, pattern FROM pat),
cand AS (SELECT pats.occ, pattern, tax, w FROM pats JOIN lib ON lib.occ = pats.occ AND regexp_matches(tax, pattern)
   UNION ALL SELECT pats.occ, pattern, tax, w FROM pats JOIN lib ON lib.occ = pats.occ WHERE NOT EXISTS (SELECT 1 FROM lib l WHERE l.occ = pats.occ AND regexp_matches(l.tax, pattern))),
tcdf AS (SELECT occ, pattern, tax, CASE WHEN row_number() OVER (PARTITION BY occ, pattern ORDER BY tax DESC) = 1 THEN 1.0::DOUBLE ELSE sum(w) OVER (PARTITION BY occ, pattern ORDER BY tax) / sum(w) OVER (PARTITION BY occ, pattern) END AS hi FROM cand),
got AS (SELECT p_partkey, mode, any_value(pat.occ) AS occ, any_value(h) AS h, min(tax) AS tax FROM pat LEFT JOIN tcdf ON tcdf.occ = pat.occ AND tcdf.pattern = pat.pattern AND tcdf.hi > u2 GROUP BY p_partkey, mode)
SELECT p_partkey, mode, occ, CASE WHEN tax IS NULL THEN 'UNK_H' || h::VARCHAR || '/' || occ ELSE split_part(tax, '/', 1) || '/' || split_part(tax, '/', 2) || '/H' || h::VARCHAR || '/' || split_part(tax, '/', 4) END AS taxonomy FROM got"""

# Fixed values of this query's small library: occupancy, taxonomy, buildings; and roof code, wall code, weight.
LIBRARY = [
    ("RES", "CR/LFINF+DUC/H2/RES", 30.0), ("RES", "MCF/LWAL+DNO/H1/RES", 50.0), ("RES", "MUR/LWAL+DNO/H1/RES", 20.0), ("RES", "W/LPB+DUL/H1/RES", 5.0),
    ("COM", "CR/LDUAL+DUC/H5/COM", 40.0), ("COM", "MUR/LWAL+DNO/H2/COM", 10.0), ("COM", "S/LFM+DUM/H3/COM", 9.0),
]
WALLS = [(10, 501, 6.0), (10, 208, 4.0), (34, 300, 3.0), (34, 527, 5.0), (34, 600, 2.0), (23, 501, 1.0), (99, 527, 1.0), (99, 210, 1.0)]
ROOFS = {"ECONOMY": 10, "LARGE": 34, "MEDIUM": 23, "PROMO": 45, "SMALL": 99}


@query(f"WITH {ASSIGN_SQL}")
def taxonomy_assign(spark: SparkSession, d: str) -> DataFrame:
    """Baseline and material-aware taxonomies of all buildings in all modes."""
    from slatework.operators import exposure

    k = F.col("p_partkey")
    b = parts(spark, d).select(
        "p_partkey", "h", F.when(k % 3 == 0, "RES").when(k % 3 == 1, "COM").otherwise("IND").alias("occ"), tables.mapped(F.col("p_type"), ROOFS).alias("roof"),
        sampling.u(k, 1).alias("u1"), sampling.u(k, 2).alias("u2"),
    )
    library = spark.createDataFrame(LIBRARY, "occ string, tax string, weight double")
    walls = spark.createDataFrame(WALLS, "roof int, wall int, weight double")
    out = exposure.assign_taxonomies(b, library, walls)
    return out.select("p_partkey", "mode", "occ", "taxonomy")


@query("""SELECT o_orderstatus, count(*) AS all_orders, round(avg(o_totalprice) FILTER (o_orderpriority <> '1-URGENT'), 4) AS avg_ok, round(sum(o_totalprice) / 3600, 4) AS total_hours,
 count(*) FILTER (o_orderpriority <> '1-URGENT') AS ok FROM orders GROUP BY o_orderstatus""")
def conditional_averages(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("o_orderpriority") != "1-URGENT"
    o = table(spark, d, "orders").groupBy("o_orderstatus")
    return o.agg(F.count(F.lit(1)).alias("all_orders"), r6(F.avg(F.when(ok, F.col("o_totalprice"))), 4).alias("avg_ok"), r6(F.sum("o_totalprice") / 3600, 4).alias("total_hours"), F.count_if(ok).alias("ok"))


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
n AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 10)) + 1, 10)::INT AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT b::INT AS bin, coalesce(n, 0) AS n FROM range(1, 11) AS t(b) LEFT JOIN n ON n.bin = b""")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return tables.histogram(table(spark, d, "lineitem"), "l_extendedprice", 10)


_FIELDS = ["city", "latitude", "material_class", "height", "numstories", "fpArea", "roofshape", "wkt"]


@query("WITH b AS (SELECT * REPLACE (CASE WHEN isnan(height) THEN NULL ELSE height END AS height, CASE WHEN isnan(numstories) THEN NULL ELSE numstories END AS numstories, CASE WHEN isnan(fpArea) THEN NULL ELSE fpArea END AS fpArea) FROM building_metadata) "
       + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS present, round(100.0::DOUBLE * count({f}) / count(*), 4) AS pct FROM b" for f in _FIELDS))
def completeness_profile(spark: SparkSession, d: str) -> DataFrame:
    """Non-null count and share of every field; NaN counts as null."""
    b = table(spark, d, "building_metadata").select(*[F.when(~F.isnan(f), F.col(f)).alias(f) if f in ("height", "numstories", "fpArea", "latitude") else F.col(f) for f in _FIELDS])
    return tables.completeness(b, _FIELDS).withColumn("pct", r6("pct", 4))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high, round(var_pop(value), 6) AS variance FROM events GROUP BY event_type")
def score_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(r6(F.avg(v)).alias("mean"), r6(F.stddev_pop(v)).alias("std"), r6(F.min(v)).alias("low"), r6(F.max(v)).alias("high"), r6(F.var_pop(v)).alias("variance"))


@query("SELECT m AS mode, s::INT AS seed FROM (SELECT unnest(['material', 'benchmark', 'unreinforced', 'reinforced']) AS m) CROSS JOIN range(100) AS t(s)")
def mode_seed_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every mode with every seed: a grid of fixed size from two literal lists."""
    from slatework.functions.vocab import MODES

    return spark.range(100).select(F.explode(damage.literals(MODES)).alias("mode"), F.col("id").cast("int").alias("seed"))


@query("""WITH g AS (SELECT m, s FROM (SELECT unnest(['R', 'A', 'N', 'X']) AS m) CROSS JOIN range(1, 9) AS t(s)),
done AS (SELECT DISTINCT l_returnflag AS m, l_linenumber AS s FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT g.m AS mode, g.s::INT AS seed, CASE WHEN done.m IS NULL THEN 'run' ELSE 'skip' END AS action FROM g LEFT JOIN done ON g.m = done.m AND g.s = done.s""")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Which runs of the grid are still to do: those whose output doesn't exist."""
    grid = spark.range(1, 9).select(F.explode(damage.literals(["R", "A", "N", "X"])).alias("mode"), F.col("id").cast("int").alias("seed"))
    done = table(spark, d, "lineitem").where("l_linenumber % 2 = 1").select(F.col("l_returnflag").alias("m"), F.col("l_linenumber").alias("s")).distinct()
    return grid.join(done, (F.col("mode") == F.col("m")) & (F.col("seed") == F.col("s")), "left").select("mode", "seed", F.when(F.col("m").isNull(), "run").otherwise("skip").alias("action"))
