"""Queries of enrichment joins, lookups, picks and job bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions import names
from slatework.functions.vocab import LEVEL_CLASSES, SEVERITY
from slatework.operators import jobs, tables
from slatework.plans.base import query, r6
from slatework.session import small, table

ORDER_SQL = "ORDER BY listed_at NULLS FIRST, latitude NULLS FIRST, longitude NULLS FIRST, city NULLS FIRST"


@query("SELECT m.record_id, m.filename, c.city, c.latitude AS listed_latitude FROM building_metadata m LEFT JOIN building_coordinates c ON m.filename = c.filename")
def left_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Records with what the register says of their file; several registrations fan out."""
    c = table(spark, d, "building_coordinates").select("filename", "city", F.col("latitude").alias("listed_latitude"))
    return table(spark, d, "building_metadata").select("record_id", "filename").join(c, "filename", "left")


LEVEL_SQL = "CASE lower(trim(DAMAGE_LEVEL)) WHEN 'slight' THEN 'minor-damage' WHEN 'moderate' THEN 'minor-damage' WHEN 'damaged' THEN 'major-damage' WHEN 'extensive' THEN 'major-damage' WHEN 'complete' THEN 'destroyed' END"


@query(f"""WITH o AS (SELECT point_id, {LEVEL_SQL} AS c FROM impact_points WHERE LATITUDE IS NOT NULL)
SELECT p.point_id, coalesce(o.c, 'no-damage') AS subtype, o.c IS NOT NULL AS overridden FROM impact_points p LEFT JOIN o USING (point_id)""")
def mapped_override(spark: SparkSession, d: str) -> DataFrame:
    """Surveyed levels mapped to classes override the default where they map."""
    p = table(spark, d, "impact_points")
    survey = p.where("LATITUDE is not null").select("point_id", tables.mapped(F.lower(F.trim("DAMAGE_LEVEL")), LEVEL_CLASSES).alias("subtype")).where("subtype is not null")
    base = p.select("point_id", F.lit("no-damage").alias("subtype"))
    return tables.keyed_update(base, survey, "point_id", "subtype").withColumnRenamed("updated", "overridden")


SEVERITY_SQL = "CASE WHEN subtype = 'destroyed' THEN 0 WHEN subtype IN ('major-damage', 'major') THEN 1 WHEN subtype IN ('minor-damage', 'minor') THEN 2 WHEN subtype = 'no-damage' THEN 3 ELSE 4 END"


@query(f"SELECT uid, subtype, material_class FROM merged_buildings QUALIFY row_number() OVER (PARTITION BY uid ORDER BY {SEVERITY_SQL}, material_class NULLS FIRST, wkt NULLS FIRST) = 1")
def dedupe_severest(spark: SparkSession, d: str) -> DataFrame:
    """One row per building, the most severe: by an explicit rank, nulls last."""
    m = table(spark, d, "merged_buildings").withColumn("rank", tables.mapped(F.col("subtype"), SEVERITY, 4))
    return tables.first_values(m, ["uid"], ["rank", "material_class", "wkt"], ["subtype", "material_class"])


@query("""SELECT m.record_id, m.filename, EXISTS (SELECT 1 FROM building_coordinates c WHERE c.filename = m.filename) AS present FROM building_metadata m WHERE lower(trim(m.split)) = 'holdout'""")
def split_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Holdout records and whether their file is registered; the missing ones are kept as diagnostics."""
    m = table(spark, d, "building_metadata").where(names.split_label(F.col("split")) == "holdout").select("record_id", "filename")
    return tables.present_and_absent(m, table(spark, d, "building_coordinates"), "filename")


@query(f"SELECT filename, latitude, longitude FROM building_coordinates WHERE filename IS NOT NULL QUALIFY row_number() OVER (PARTITION BY filename {ORDER_SQL}) = 1")
def lookup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "building_coordinates").where("filename is not null")
    return tables.first_values(c, ["filename"], ["listed_at", "latitude", "longitude", "city"], ["latitude", "longitude"])


STEM = r"regexp_replace(regexp_replace(lower(filename), '^.*[/\\]', ''), '(_copy|-copy|_crop)?\.[a-z]+$', '')"


@query(f"""WITH r AS (SELECT filename AS key, min(city) AS city FROM building_coordinates WHERE filename IS NOT NULL GROUP BY 1), s AS (SELECT {STEM} AS key, min(city) AS city FROM building_coordinates WHERE filename IS NOT NULL GROUP BY 1),
k AS (SELECT * FROM r UNION ALL SELECT * FROM s WHERE key NOT IN (SELECT key FROM r)),
m AS (SELECT source, filename, {STEM} AS stem FROM building_metadata)
SELECT m.source, count(*) AS records, count(a.key) AS by_name, count(*) FILTER (a.key IS NULL AND b.key IS NOT NULL) AS by_stem, count(*) FILTER (a.key IS NULL AND b.key IS NULL) AS missing, count(coalesce(a.city, b.city)) AS with_city
FROM m LEFT JOIN k a ON a.key = m.filename LEFT JOIN k b ON b.key = m.stem GROUP BY m.source""")
def two_key_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The city by file name, else by its stem; how many are found by each, and how many by neither."""
    stem = F.regexp_replace(F.regexp_replace(F.lower("filename"), r"^.*[/\\]", ""), r"(_copy|-copy|_crop)?\.[a-z]+$", "")
    c = table(spark, d, "building_coordinates").where("filename is not null")
    both = c.select(F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("filename").alias("key")), F.struct(F.lit(1).alias("rank"), stem.alias("key")))).alias("k"), "city")
    # Names go before stems where both make the same key.
    lookup = both.groupBy(F.col("k.key").alias("key")).agg(F.min("k.rank").alias("r"), F.min(F.when(F.col("k.rank") == 0, F.col("city"))).alias("c0"), F.min(F.when(F.col("k.rank") == 1, F.col("city"))).alias("c1"))
    lookup = lookup.select("key", F.when(F.col("r") == 0, F.col("c0")).otherwise(F.col("c1")).alias("found"))
    m = table(spark, d, "building_metadata").select("source", "filename", stem.alias("stem"))
    out = tables.two_key_lookup(m, lookup, "filename", "stem", "found")
    by = F.col("matched_by")
    return out.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(by == "first").alias("by_name"), F.count_if(by == "second").alias("by_stem"), F.count_if(by.isNull()).alias("missing"), F.count("found").alias("with_city")
    )


@query(r"""WITH u AS (SELECT uid, min(material_class) AS c FROM merged_buildings GROUP BY uid), m AS (SELECT record_id, material_class, list_last(string_split(regexp_replace(filename, '\.png$', ''), 'pre_disaster_')) AS uid FROM building_metadata)
SELECT record_id, coalesce(u.c, material_class) AS material_class, u.uid IS NOT NULL AS updated FROM m LEFT JOIN u USING (uid)""")
def keyed_update(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the records overwritten by those of the merged buildings; unmatched records are flagged."""
    u = table(spark, d, "merged_buildings").groupBy("uid").agg(F.min("material_class").alias("material_class"))
    m = table(spark, d, "building_metadata").select("record_id", "material_class", names.uid(F.col("filename")).alias("uid"))
    return tables.keyed_update(m, u, "uid", "material_class").drop("uid")


@query(r"""WITH a AS (SELECT translate(lower("City"), ' ,', '_') AS k, list_sort(json_extract_string(replace(roof_materials, '''', '"')::JSON, '$[*].class')) AS allowed FROM city_allow_list
  WHERE "City" IS NOT NULL AND json_valid(replace(roof_materials, '''', '"')) QUALIFY row_number() OVER (PARTITION BY translate(lower("City"), ' ,', '_') ORDER BY entry_id DESC) = 1)
SELECT record_id, material_class, CASE WHEN a.k IS NULL THEN 'no_list' WHEN list_contains(allowed, material_class) THEN 'ok' WHEN material_class IS NULL THEN 'no_class' ELSE 'reassess' END AS status,
 CASE WHEN a.k IS NOT NULL AND material_class IS NOT NULL AND NOT list_contains(allowed, material_class) THEN 'reassess/' || material_class WHEN material_class IS NOT NULL THEN material_class END AS target_dir
FROM building_metadata m LEFT JOIN a ON translate(lower(m.city), ' ,', '_') = a.k""")
def allow_list_verify(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record's class is allowed in its city, and the folder it belongs in. The last list of a city counts; unreadable lists don't."""
    read = F.from_json(F.replace("roof_materials", F.lit("'"), F.lit('"')), "array<struct<class:string>>")
    a = table(spark, d, "city_allow_list").select("entry_id", names.city_key(F.col("City")).alias("k"), F.transform(read, lambda x: x["class"]).alias("allowed")).where("allowed is not null and k is not null")
    a = a.groupBy("k").agg(F.max(F.struct("entry_id", "allowed")).alias("s")).select("k", "s.allowed")
    m = table(spark, d, "building_metadata").select("record_id", "material_class", names.city_key(F.col("city")).alias("key"))
    j = m.join(small(a), F.col("key") == F.col("k"), "left")
    c = F.col("material_class")
    status = F.when(F.col("k").isNull(), "no_list").when(F.array_contains("allowed", c), "ok").when(c.isNull(), "no_class").otherwise("reassess")
    return j.select("record_id", "material_class", status.alias("status"), F.when(status == "reassess", F.concat(F.lit("reassess/"), c)).otherwise(c).alias("target_dir"))


@query("""WITH f AS (SELECT DISTINCT filename FROM failed_downloads WHERE lower(replace(trim(reason), ' ', '_')) = 'request_failed'), c AS (SELECT DISTINCT filename, latitude, longitude FROM building_coordinates)
SELECT c.filename, c.latitude, c.longitude, CASE WHEN latitude IS NULL OR longitude IS NULL OR isnan(latitude) OR isnan(longitude) OR abs(latitude) > 90 OR abs(longitude) > 180 THEN 'bad_coordinates' WHEN f.filename IS NOT NULL THEN 'request_failed' ELSE 'ok' END AS route FROM c LEFT JOIN f USING (filename)""")
def dead_letter_routing(spark: SparkSession, d: str) -> DataFrame:
    """Where each registered image goes: fetched, or one of two kinds of dead letters."""
    failed = table(spark, d, "failed_downloads").where(F.lower(F.replace(F.trim("reason"), F.lit(" "), F.lit("_"))) == "request_failed").select("filename").distinct().withColumn("f", F.lit(True))
    c = table(spark, d, "building_coordinates").select("filename", "latitude", "longitude").distinct().join(failed, "filename", "left")
    a, o = F.col("latitude"), F.col("longitude")
    bad = a.isNull() | o.isNull() | F.isnan(a) | F.isnan(o) | (F.abs(a) > 90) | (F.abs(o) > 180)
    return c.select("filename", "latitude", "longitude", F.when(bad, "bad_coordinates").when(F.col("f"), "request_failed").otherwise("ok").alias("route"))


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", r6("value").alias("value"))
    return tables.first_values(e, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"], last=True)


STATE_SQL = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END"


def _events(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("done")
    return table(spark, d, "events").select(F.col("user_id").alias("job"), state.alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")


FOLD_SQL = f"""e AS (SELECT user_id AS job, {STATE_SQL} AS state, epoch_us(ts) AS tick, event_id FROM events),
f AS (SELECT job, last(state ORDER BY tick, event_id) AS status, max(tick) AS updated_at, max(tick) FILTER (state = 'running') AS started_at, max(tick) FILTER (state IN ('done', 'failed')) AS finished_at, count(*) AS events FROM e GROUP BY job)"""


@query(f"WITH {FOLD_SQL} SELECT * FROM f")
def job_fold(spark: SparkSession, d: str) -> DataFrame:
    return jobs.folded(_events(spark, d))


@query(f"WITH {FOLD_SQL} SELECT s AS status, count(f.job) AS n FROM (SELECT unnest(['pending', 'running', 'done', 'failed']) AS s) LEFT JOIN f ON f.status = s GROUP BY s")
def job_state_summary(spark: SparkSession, d: str) -> DataFrame:
    return jobs.summary(job_fold(spark, d))


@query(r"""WITH m AS (SELECT c_custkey, 'img/' || c_name || '.png' AS image, CASE WHEN c_custkey % 2 = 0 THEN 'done' ELSE 'failed' END AS status FROM customer WHERE c_custkey % 3 = 0),
w AS (SELECT c_custkey, 'img/' || c_name || '.png' AS image FROM customer WHERE c_custkey % 5 <> 0),
j AS (SELECT regexp_replace(regexp_replace(coalesce(m.image, w.image), '^.*/', ''), '\.[^.]*$', '') || '__rollout' AS job_id, CASE WHEN w.image IS NOT NULL THEN 'new/' ELSE 'old/' END || coalesce(m.image, w.image) AS output,
 coalesce(m.status, 'pending') AS status, CASE WHEN m.image IS NOT NULL THEN 1 ELSE 2 END::BIGINT AS created_at, CASE WHEN w.image IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS updated_at FROM m FULL JOIN w USING (c_custkey)) SELECT * FROM j""")
def job_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("image", F.concat(F.lit("img/"), "c_name", F.lit(".png")))
    key = jobs.job_id(F.col("image"), F.lit("rollout"))
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    manifest = c.where("c_custkey % 3 = 0").select(key.alias("job_id"), F.concat(F.lit("old/"), "image").alias("output"), F.when(F.col("c_custkey") % 2 == 0, "done").otherwise("failed").alias("status"), one.alias("created_at"), one.alias("updated_at"))
    wanted = c.where("c_custkey % 5 <> 0").select(key.alias("job_id"), F.concat(F.lit("new/"), "image").alias("output"), two.alias("at"))
    return jobs.upsert(manifest, wanted)
