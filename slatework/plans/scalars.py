"""Queries of projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions import names
from slatework.functions.vocab import MATERIALS
from slatework.operators import damage, exposure
from slatework.plans.base import PARTS_SQL, SITES_SQL, parts, query, r6, sites
from slatework.session import table


@query("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, year(l_shipdate)::INT AS shipped FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_shipdate >= '1995-01-01' and l_shipdate < '1996-01-01'")
    return li.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", F.year("l_shipdate").alias("shipped"))


SPLIT_SQL = "coalesce(nullif(trim(lower(split)), ''), 'unknown')"


@query(f"SELECT record_id, {SPLIT_SQL} AS split FROM building_metadata WHERE {SPLIT_SQL} IN ('train', 'unknown')")
def split_filter(spark: SparkSession, d: str) -> DataFrame:
    s = names.split_label(F.col("split"))
    return table(spark, d, "building_metadata").where(s.isin("train", "unknown")).select("record_id", s.alias("split"))


@query(f"SELECT {SPLIT_SQL} AS split, count(*) AS n FROM building_metadata GROUP BY 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "building_metadata").groupBy(names.split_label(F.col("split")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT filename, latitude, longitude FROM building_metadata WHERE latitude IS NOT NULL AND longitude IS NOT NULL UNION ALL SELECT filename, latitude, longitude FROM building_coordinates WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def union_all_notnull(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: table(spark, d, t).select("filename", "latitude", "longitude").dropna(subset=["latitude", "longitude"])
    return one("building_metadata").unionByName(one("building_coordinates"))


@query("SELECT json_extract_string(props, '$.k')::BIGINT AS k, event_id, user_id FROM events WHERE event_type <> 'error' AND json_extract_string(props, '$.k') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY json_extract_string(props, '$.k')::BIGINT ORDER BY ts, event_id) = 1")
def json_filter_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """First event per property, by a min of structs: reduced before the shuffle."""
    e = table(spark, d, "events").where("event_type <> 'error'").select(F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), "ts", "event_id", "user_id").where("k is not null")
    return e.groupBy("k").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("s")).select("k", "s.event_id", "s.user_id")


@query(r"""SELECT record_id, CASE WHEN regexp_matches(filename, '[/\\]') THEN regexp_extract(filename, '^([^/\\]*)[/\\]', 1) ELSE '' END AS folder,
 regexp_replace(regexp_replace(filename, '^.*[/\\]', '', 's'), '\.[^.]*$', '', 's') AS stem, lower(regexp_extract(filename, '\.([A-Za-z]+)$', 1)) AS extension,
 CASE WHEN regexp_matches(lower(filename), '(^|[/\\])(train|val|holdout)[/\\]') THEN regexp_extract(lower(filename), '(^|[/\\])(train|val|holdout)[/\\]', 2) ELSE 'unknown' END AS path_split
 FROM building_metadata WHERE filename IS NOT NULL""")
def path_parse_split(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("filename")
    part = names.capture(F.lower(f), r"(^|[/\\])(train|val|holdout)[/\\]", 2)
    return table(spark, d, "building_metadata").where(f.isNotNull()).select(
        "record_id", F.regexp_extract(f, r"^([^/\\]*)[/\\]", 1).alias("folder"), names.stem(f).alias("stem"), F.lower(F.regexp_extract(f, r"\.([A-Za-z]+)$", 1)).alias("extension"), F.coalesce(part, F.lit("unknown")).alias("path_split")
    )


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN round(o_totalprice * 100)::BIGINT::VARCHAR WHEN 2 THEN ' ' || o_orderkey::VARCHAR || '.5 ' ELSE '' END AS raw FROM orders)
SELECT o_orderkey, raw, try_cast(trim(raw) AS DOUBLE) AS value FROM t""")
def numeric_coerce(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.col("o_orderpriority")).when(k == 1, F.round(F.col("o_totalprice") * 100).cast("long").cast("string")).when(k == 2, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".5 "))).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw")).withColumn("value", F.trim("raw").try_cast("double"))


@query("""SELECT record_id, coalesce(try_cast(trim(replace(lower(height_text), 'm', '')) AS DOUBLE), CASE WHEN isnan(numstories) THEN NULL ELSE numstories * 3.0::DOUBLE END) AS height_m FROM building_metadata""")
def height_text_parse(spark: SparkSession, d: str) -> DataFrame:
    """Height of an entry without its ``m``, else three metres a level; anything else is ignored."""
    read = F.trim(F.replace(F.lower("height_text"), F.lit("m"), F.lit(""))).try_cast("double")
    return table(spark, d, "building_metadata").select("record_id", F.coalesce(read, F.when(~F.isnan("numstories"), F.col("numstories") * 3.0)).alias("height_m"))


@query("""SELECT record_id, material_class, CASE WHEN material_class IN ('AmorphousConcrete', 'AmorphousAsphalt', 'AmorphousMembrane', 'AmorphousFabric') AND roofshape IS NULL THEN 'Flat' ELSE roofshape END AS roofshape FROM building_metadata""")
def conditional_default(spark: SparkSession, d: str) -> DataFrame:
    loose = F.col("material_class").isin([m for m in MATERIALS if m.startswith("Amorphous")])
    return table(spark, d, "building_metadata").select("record_id", "material_class", F.when(loose & F.col("roofshape").isNull(), "Flat").otherwise(F.col("roofshape")).alias("roofshape"))


@query("""WITH b AS (SELECT record_id, CASE WHEN isnan(numstories) THEN NULL ELSE numstories END AS s, CASE WHEN isnan(height) THEN NULL ELSE height END AS h FROM building_metadata),
n AS (SELECT record_id, CASE WHEN s > 0 THEN trunc(s)::INT WHEN h > 0 THEN greatest(1, round_even(h / 3, 0)::INT) ELSE 1 END AS stories FROM b)
SELECT record_id, stories, 'H' || least(stories, 12)::VARCHAR AS token FROM n""")
def stories_and_token(spark: SparkSession, d: str) -> DataFrame:
    """Own storeys if positive, else a third of the height (half to even, at least one), else one."""
    s, h = (F.when(~F.isnan(c), F.col(c)) for c in ("numstories", "height"))
    n = F.when(s > 0, s.cast("int")).when(h > 0, F.greatest(F.lit(1), F.bround(h / 3, 0).cast("int"))).otherwise(1)
    return table(spark, d, "building_metadata").select("record_id", n.alias("stories")).withColumn("token", exposure.height_token(F.col("stories")))


@query(f"WITH {PARTS_SQL} SELECT p_partkey, nullif(regexp_extract(replace(taxonomy, '/H', CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '_H' END), '_(H[^/]+)', 1), '') AS token FROM parts")
def regex_token_extract(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 3 == 0, F.replace("taxonomy", F.lit("/H"), F.lit("/"))).otherwise(F.replace("taxonomy", F.lit("/H"), F.lit("_H")))
    return parts(spark, d).select("p_partkey", names.capture(t, "_(H[^/]+)").alias("token"))


@query(r"""SELECT b.record_id, list_last(string_split(regexp_replace(filename, '\.png$', ''), 'pre_disaster_')) AS uid,
 lower(replace(split_part(city, ',', 1), ' ', '_')) || '_' || record_id::VARCHAR || '.png' AS built FROM building_metadata b""")
def filename_key_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "building_metadata").select("record_id", names.uid(F.col("filename")).alias("uid"), names.image_name(F.col("city"), F.col("record_id")).alias("built"))


@query(r"""WITH f AS (SELECT DISTINCT filename, regexp_replace(filename, '\.[^.]*$', '') AS base FROM building_coordinates WHERE filename IS NOT NULL),
c AS (SELECT filename, base, CASE WHEN contains(base, '-') THEN split_part(base, '-', 1) WHEN contains(base, 'height') THEN split_part(base, '_height', 1) WHEN contains(base, 'imsat') THEN split_part(base, '_imsat', 1) END AS part FROM f)
SELECT filename, CASE WHEN part IS NULL THEN base ELSE array_to_string(list_transform(string_split(lower(replace(part, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS city FROM c""")
def filename_city_parse(spark: SparkSession, d: str) -> DataFrame:
    """Registered file names and the city they name. Capitals after blanks only, not after apostrophes."""
    return table(spark, d, "building_coordinates").where("filename is not null").select("filename").distinct().withColumn("city", names.city_of(F.col("filename")))


@query("SELECT city_id, m || ' in ' || city_name AS prompt FROM city_reference CROSS JOIN (SELECT unnest([" + ", ".join(f"'{m}'" for m in MATERIALS) + "]) AS m)")
def prompt_expand(spark: SparkSession, d: str) -> DataFrame:
    prompts = F.transform(damage.literals(MATERIALS), lambda m: F.concat(m, F.lit(" in "), F.col("city_name")))
    return table(spark, d, "city_reference").select("city_id", F.explode(prompts).alias("prompt"))


@query("""SELECT lang, count(*) AS docs, count(*) FILTER (nfc_normalize(text) <> text) AS changed, sum(length(nfc_normalize(text)))::BIGINT AS chars FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def nfc_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("lang", "text", names.nfc(F.col("text")).alias("n"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n") != F.col("text")).alias("changed"), F.sum(F.length("n")).alias("chars"))


@query(f"""WITH {PARTS_SQL} SELECT p_partkey, CASE WHEN len(string_split(t, '/')) >= 3 THEN array_to_string(list_concat(string_split(t, '/')[1:2], ['H' || least(p_size, 12)::VARCHAR], string_split(t, '/')[4:]), '/') ELSE t END AS taxonomy
 FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 7 = 0 THEN mat_llrs ELSE taxonomy END AS t FROM parts)""")
def taxonomy_stamp(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d).withColumn("t", F.when(F.col("p_partkey") % 7 == 0, F.col("mat_llrs")).otherwise(F.col("taxonomy")))
    return p.select("p_partkey", exposure.stamped(F.col("t"), exposure.height_token(F.col("p_size"))).alias("taxonomy"))


@query(f"""WITH {PARTS_SQL}, t AS (SELECT p_partkey, replace(taxonomy, '+', CASE p_partkey % 4 WHEN 0 THEN '+WS+' WHEN 1 THEN '+WLI:' WHEN 2 THEN '+WBB/LPB+' ELSE '+' END) || '/HBET' || h::VARCHAR || '-' || (h + 2)::VARCHAR AS tax FROM parts)
SELECT p_partkey, replace(replace(regexp_replace(replace(replace(replace(replace(tax, '+WS', ''), '+WLI', ''), '+WBB', ''), 'LPB', 'LFM'), 'HBET([0-9]+)-[0-9]+', 'H\\1', 'g'), '+', '-'), ':', '') AS taxonomy FROM t""".replace("\\\\1", "\\1"))
def taxonomy_standardise(spark: SparkSession, d: str) -> DataFrame:
    k, h = F.col("p_partkey") % 4, F.col("h")
    mark = F.when(k == 0, "+WS+").when(k == 1, "+WLI:").when(k == 2, "+WBB/LPB+").otherwise("+")
    raw = F.concat(F.replace("taxonomy", F.lit("+"), mark), F.lit("/HBET"), h.cast("string"), F.lit("-"), (h + 2).cast("string"))
    return parts(spark, d).select("p_partkey", exposure.standardised(raw).alias("taxonomy"))


@query("""SELECT record_id, CASE WHEN height > 0 AND NOT isnan(height) AND wkt IS NOT NULL THEN 'footprint' WHEN height > 0 AND NOT isnan(height) THEN 'table' WHEN numstories > 0 AND NOT isnan(numstories) THEN 'estimated' ELSE 'none' END AS height_source FROM building_metadata""")
def provenance_label(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.coalesce((F.col(c) > 0) & ~F.isnan(c), F.lit(False))
    how = F.when(has("height") & F.col("wkt").isNotNull(), "footprint").when(has("height"), "table").when(has("numstories"), "estimated").otherwise("none")
    return table(spark, d, "building_metadata").select("record_id", how.alias("height_source"))


@query(r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Calculation ' || o_orderkey::VARCHAR || ' finished correctly' WHEN 1 THEN 'saved calc_' || o_orderkey::VARCHAR || '.hdf5'
  WHEN 2 THEN '[#' || o_orderkey::VARCHAR || ' INFO] done' ELSE 'nothing #12' END AS log FROM orders)
SELECT o_orderkey, coalesce(nullif(regexp_extract(log, 'Calculation ([0-9]+) finished correctly', 1), ''), nullif(regexp_extract(log, 'calc_([0-9]+)\.hdf5', 1), ''), nullif(regexp_extract(log, '#([0-9]+) (INFO|WARNING|ERROR)\]', 1), ''))::BIGINT AS calc_id FROM t""")
def regex_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    log = (
        F.when(k == 0, F.concat(F.lit("Calculation "), key, F.lit(" finished correctly"))).when(k == 1, F.concat(F.lit("saved calc_"), key, F.lit(".hdf5")))
        .when(k == 2, F.concat(F.lit("[#"), key, F.lit(" INFO] done"))).otherwise("nothing #12")
    )
    tries = [r"Calculation ([0-9]+) finished correctly", r"calc_([0-9]+)\.hdf5", r"#([0-9]+) (?:INFO|WARNING|ERROR)\]"]
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(*[names.capture(log, t) for t in tries]).cast("long").alias("calc_id"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS k, coalesce(json_extract_string(props, '$.status'), 'pending') AS status FROM events""")
def json_default(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k bigint, status string")
    return table(spark, d, "events").select("event_id", F.coalesce(p["k"], F.lit(0)).alias("k"), F.coalesce(p["status"], F.lit("pending")).alias("status"))


@query("""WITH a AS (SELECT (ln(0.6::DOUBLE) - ln(0.3::DOUBLE)) / (ln(1.0::DOUBLE) - ln(0.3::DOUBLE)) AS a)
SELECT p_partkey, round(exp((1 - a) * ln(p_retailprice / 100) + a * ln(p_size / 100.0::DOUBLE)), 6) AS m06, round((1 - a) * (p_retailprice / 1000) + a * (p_size / 50.0::DOUBLE), 6) AS s06 FROM part, a""")
def log_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """Spectral acceleration at 0.6 s: percent of g to g, in logs between 0.3 and 1.0 s; the deviation linearly."""
    from math import log

    a = (log(0.6) - log(0.3)) / (log(1.0) - log(0.3))
    return table(spark, d, "part").select(
        "p_partkey", r6(F.exp((1 - a) * F.log(F.col("p_retailprice") / 100) + a * F.log(F.col("p_size") / 100.0))).alias("m06"), r6((1 - a) * (F.col("p_retailprice") / 1000) + a * (F.col("p_size") / 50.0)).alias("s06")
    )


CURVES_SQL = """curves AS (SELECT n_nationkey, n_regionkey, i::INT AS i, i * 0.1::DOUBLE AS im, CASE WHEN n_nationkey % 5 = 0 THEN 'bad' ELSE greatest(0, i - n_regionkey)::VARCHAR || '.5' END AS slight, greatest(0, i - 3)::VARCHAR AS complete FROM nation CROSS JOIN range(6) AS t(i))"""


def _curves(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    i = F.col("i")
    low = F.greatest(F.lit(0), i - F.col("n_regionkey")).cast("string")
    return n.select("n_nationkey", "n_regionkey", "i", (i * 0.1).alias("im"), F.when(F.col("n_nationkey") % 5 == 0, "bad").otherwise(F.concat(low, F.lit(".5"))).alias("slight"), F.greatest(F.lit(0), i - 3).cast("string").alias("complete"))


@query(f"WITH {CURVES_SQL} SELECT n_nationkey, 'SA(0.3)' AS imt, round(im, 6) AS im, 'slight' AS limit_state, try_cast(slight AS DOUBLE) AS poe FROM curves UNION ALL SELECT n_nationkey, 'SA(0.3)', round(im, 6), 'complete', try_cast(complete AS DOUBLE) FROM curves")
def curve_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Curve tables in long form; cells that are no numbers are null. The intensity label loses its ``s``."""
    c = _curves(spark, d).select("n_nationkey", F.regexp_replace(F.lit("SA(0.3s)"), r"\(([0-9.]+)s\)", "($1)").alias("imt"), r6("im").alias("im"), F.col("slight").try_cast("double").alias("slight"), F.col("complete").try_cast("double").alias("complete"))
    return c.unpivot(["n_nationkey", "imt", "im"], ["slight", "complete"], "limit_state", "poe")


@query(f"WITH {CURVES_SQL} SELECT n_nationkey, round(coalesce(min(im) FILTER (coalesce(try_cast(slight AS DOUBLE), 0) > 1e-10 OR coalesce(try_cast(complete AS DOUBLE), 0) > 1e-10), arg_min(im, i)), 6) AS no_damage_limit FROM curves GROUP BY n_nationkey")
def first_exceedance(spark: SparkSession, d: str) -> DataFrame:
    """First intensity, in file order, at which any limit state can be exceeded; else the first of the file."""
    some = F.coalesce(F.greatest(F.col("slight").try_cast("double"), F.col("complete").try_cast("double")) > 1e-10, F.lit(False))
    c = _curves(spark, d).groupBy("n_nationkey").agg(F.min(F.when(some, F.struct("i", "im"))).alias("hit"), F.min(F.struct("i", "im")).alias("first"))
    return c.select("n_nationkey", r6(F.coalesce("hit.im", "first.im")).alias("no_damage_limit"))


@query(f"WITH {SITES_SQL} SELECT DISTINCT printf('%.8f', round(x / 70, 1)) AS lon, printf('%.8f', round(y / 70, 1)) AS lat FROM sites")
def site_dedupe_format(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d).select(F.round(F.col("x") / 70, 1).alias("x"), F.round(F.col("y") / 70, 1).alias("y")).distinct()
    return s.select(F.format_string("%.8f", "x").alias("lon"), F.format_string("%.8f", "y").alias("lat"))


@query("""WITH l AS (SELECT * FROM (VALUES ('STANDARD', 0, 3), ('SMALL', 3, 6), ('MEDIUM', 6, 15), ('LARGE', 15, 30), ('PROMO', 30, 500)) AS t(k, lo, hi)),
r AS (SELECT p_type, lo IS NOT NULL AND (p_size < lo OR p_size > hi) AS bad FROM part LEFT JOIN l ON k = p_type) SELECT p_type, count(*) FILTER (bad) AS conflicts, round(avg(bad::INT), 6) AS rate FROM r GROUP BY p_type""")
def range_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Heights outside the limits of their use; kinds without limits never conflict."""
    limits = spark.createDataFrame([("STANDARD", 0, 3), ("SMALL", 3, 6), ("MEDIUM", 6, 15), ("LARGE", 15, 30), ("PROMO", 30, 500)], "k string, lo int, hi int")
    p = table(spark, d, "part").select("p_type", "p_size").join(F.broadcast(limits), F.col("p_type") == F.col("k"), "left")
    bad = F.coalesce((F.col("p_size") < F.col("lo")) | (F.col("p_size") > F.col("hi")), F.lit(False))
    return p.groupBy("p_type").agg(F.count_if(bad).alias("conflicts"), r6(F.avg(bad.cast("int"))).alias("rate"))


BOX_SQL = "b AS (SELECT p_partkey, (p_size * 37 % 500)::DOUBLE AS x, (p_size * 53 % 400)::DOUBLE AS y, (p_partkey % 90)::DOUBLE AS w, (p_partkey % 70)::DOUBLE AS h FROM part)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (s * 37 % 500).cast("double").alias("x"), (s * 53 % 400).cast("double").alias("y"), (k % 90).cast("double").alias("w"), (k % 70).cast("double").alias("h"))


@query(f"WITH {BOX_SQL} SELECT p_partkey, w, h FROM b WHERE w * h > 1000")
def size_gate(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).where(F.col("w") * F.col("h") > 1000).select("p_partkey", "w", "h")


@query(f"""WITH {BOX_SQL}, g AS (SELECT p_partkey % 100 AS image, x, y, w, h, p_partkey FROM b QUALIFY row_number() OVER (PARTITION BY p_partkey % 100 ORDER BY w * h DESC, p_partkey) = 1)
SELECT image, greatest(x - 40, 1) AS x0, greatest(y - 40, 1) AS y0, least(x + w + 40, 511) AS x1, least(y + h + 40, 383) AS y1 FROM g""")
def largest_box_pad(spark: SparkSession, d: str) -> DataFrame:
    """Per image its largest box, padded by 40 pixels and kept one pixel inside the 512 x 384 image."""
    b = _boxes(spark, d).groupBy((F.col("p_partkey") % 100).alias("image")).agg(F.min(F.struct((-F.col("w") * F.col("h")).alias("a"), "p_partkey", "x", "y", "w", "h")).alias("s")).select("image", "s.*")
    return b.select("image", F.greatest(F.col("x") - 40, F.lit(1.0)).alias("x0"), F.greatest(F.col("y") - 40, F.lit(1.0)).alias("y0"), F.least(F.col("x") + F.col("w") + 40, F.lit(511.0)).alias("x1"), F.least(F.col("y") + F.col("h") + 40, F.lit(383.0)).alias("y1"))


@query(f"""WITH {BOX_SQL}, p AS (SELECT p_partkey, greatest(0, floor((x - 100) / 0.5::DOUBLE))::INT AS c0, least(512, ceil((x + w - 100) / 0.5::DOUBLE))::INT AS c1, greatest(0, floor((300 - (y + h)) / 0.5::DOUBLE))::INT AS r0, least(384, ceil((300 - y) / 0.5::DOUBLE))::INT AS r1 FROM b)
SELECT * FROM p WHERE c1 > c0 AND r1 > r0""")
def pixel_window(spark: SparkSession, d: str) -> DataFrame:
    """World boxes as pixel windows of a 512 x 384 raster of half-unit pixels whose corner is (100, 300); empty ones are dropped."""
    b = _boxes(spark, d)
    p = b.select(
        "p_partkey", F.greatest(F.lit(0), F.floor((F.col("x") - 100) / 0.5)).cast("int").alias("c0"), F.least(F.lit(512), F.ceil((F.col("x") + F.col("w") - 100) / 0.5)).cast("int").alias("c1"),
        F.greatest(F.lit(0), F.floor((300 - (F.col("y") + F.col("h"))) / 0.5)).cast("int").alias("r0"), F.least(F.lit(384), F.ceil((300 - F.col("y")) / 0.5)).cast("int").alias("r1"),
    )
    return p.where("c1 > c0 and r1 > r0")
