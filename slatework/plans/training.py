"""Queries of the core training-data operators: proximity (p1), filling (p2), units (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions import entries, text
from slatework.operators import imputation, proximity, units
from slatework.plans.training_sql import SQL  # noqa: F401
from slatework.session import ship, table, whole_list, written

#: Metres within which two records are near each other.
NEAR_M = 20.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs of located records, and the region of located records with a blank city."""
    b = table(spark, d, "building_metadata")
    near = proximity.near_pairs(proximity.located(b, "record_id", "latitude", "longitude"), None, NEAR_M)
    blank = proximity.located(b.where(text.is_blank(F.col("city"))), "record_id", "latitude", "longitude")
    inside = proximity.containing_regions(blank, table(spark, d, "city_regions"), "region_id", "wkt")
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionByName(inside.select(F.lit("region").alias("kind"), F.col("id").alias("id_a"), F.col("region_id").alias("id_b")))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Per located record the number of near records and the nearest distance in centimetres."""
    pts = proximity.located(table(spark, d, "building_metadata"), "record_id", "latitude", "longitude")
    out = proximity.neighbour_counts(pts, proximity.near_pairs(pts, None, NEAR_M))
    return out.select(F.col("id").alias("record_id"), "near", F.round(F.col("nearest_m") * 100).cast("long").alias("nearest_cm"))


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours}


UNIT_COLUMNS = ["record_id", "source", "captured_at", "height", "height_text", "numstories", "stories_text"]


def _common(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return units.common_units(table(spark, d, "building_metadata").select(*UNIT_COLUMNS), table(spark, d, "source_catalog"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that were not yet in metres or storeys with the ground floor, as decimetres and storeys."""
    c = _common(spark, d)
    return c.select(
        "record_id",
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit("height").alias("field"), F.round(F.col("height_m") * 10).cast("long").alias("value_int"), F.col("height_changed").alias("changed")),
                    F.struct(F.lit("numstories").alias("field"), F.round("stories_total").cast("long").alias("value_int"), F.col("stories_changed").alias("changed")),
                ),
                lambda x: x.changed,
            )
        ),
    ).select("record_id", "field", "value_int")


def p6_common(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its height in metres and its storeys, missing values null."""
    return _common(spark, d).select("record_id", F.round("height_m", 3).alias("height_m"), "height_unit_used", F.round("stories_total", 3).alias("stories_total"), "stories_basis_used")


QUERIES |= {"p6_found": p6_found, "p6_common": p6_common}


#: The filled fields and the columns of the chain that stand for them.
FILLED = {"height": "height_m", "numstories": "stories_total", "fpArea": "area", "roofshape": "shape"}


def _plain_shape(c):
    """A typed roof shape without case, blanks, punctuation and the words that only say it is a roof."""
    plain = F.regexp_replace(F.lower(text.bare(c)), r"\(main\)|\broof\b:?|[-_ ]?style$|[._]+$", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"[_\s]+", " "), r"^ | $|[ _]?roof$", "")


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its four fields filled, and per field how: null (recorded), ``building`` or ``model``.

    Heights are in metres, storeys include the ground floor, recorded roof shapes
    stay as typed. Copies of a record (same file name, case and end blanks aside)
    donate first; what they can't tell is drawn from the chained equations on
    city, class and time of capture.
    """
    ship(spark)
    b = table(spark, d, "building_metadata")
    shapes = table(spark, d, "roofshape_list")
    names = [(r["roofshape"], [r["roofshape"], *(r["also_called"] or "").split(",")]) for r in whole_list(shapes.select("roofshape", "also_called"), 1000)]  # a list of shapes, bounded here
    known = [x for name, called in names for call in called if call.strip() for x in (F.lit(call.strip().lower()), F.lit(name))]
    shape = F.try_element_at(F.create_map(*known), _plain_shape(F.col("typed_shape"))) if known else F.lit(None).cast("string")
    area_gap = entries.missing_number(F.col("fpArea"))
    # What is read from texts is spread over the steps: one that held all these expressions would outgrow what is compiled.
    b = b.select(*UNIT_COLUMNS, "filename", "city", F.col("material_class").alias("material"), "fpArea", F.col("roofshape").alias("typed_shape"))
    c = units.common_units(b, table(spark, d, "source_catalog")).drop("height_text", "stories_text", "source", "height", "numstories").withColumnsRenamed({"height_missing": "height_gap", "stories_missing": "numstories_gap"})
    c = written(c, "impute-read")
    c = c.withColumns({"building": F.lower(text.bare(F.col("filename"))), "shape": shape, "roofshape_gap": entries.says_nothing(F.col("typed_shape")), "area": F.when(~area_gap, F.col("fpArea")), "fpArea_gap": area_gap}).drop("filename", "fpArea")
    donors = imputation.donated(c.where("length(building) > 0"), "building", list(FILLED.values()), ["captured_at", "record_id"])
    gaps = c.where(" or ".join(f"{f}_gap" for f in FILLED))
    whole = c.where(" and ".join(f"not {f}_gap" for f in FILLED)).select("*", *[F.lit(None).cast(t).alias(f"d_{v}") for v, t in zip(FILLED.values(), ("double", "double", "double", "string"), strict=True)])
    c = gaps.join(donors, "building", "left").select(*whole.columns).unionByName(whole)
    told = {f: F.col(f"{f}_gap") & F.col(f"d_{v}").isNotNull() for f, v in FILLED.items()}
    c = c.select(
        "record_id", "captured_at", F.nullif(F.lower(text.bare(F.col("city"))), F.lit("")).alias("place"), "material", "typed_shape", *[f"{f}_gap" for f in FILLED], *[told[f].alias(f"{f}_told") for f in FILLED],
        *[F.when(told[f], F.col(f"d_{v}")).otherwise(F.col(v)).alias(v) for f, v in FILLED.items()],
    )
    c = written(c, "impute-told")
    plan = imputation.Plan(("height_m", "stories_total", "area"), "shape", tuple(n for n, _ in names), ("material", "place"))
    keep = ("typed_shape", *[f"{f}_{x}" for f in FILLED for x in ("gap", "told")])
    out = imputation.chained(c, plan, "record_id", "captured_at", keep)
    # Marked by the operator that filled it: a donor of the same building, or the chain.
    how = lambda f: F.when(F.col(f"{f}_told"), "building").when(F.col(f"{f}_gap") & F.col(f"{FILLED[f]}_filled"), "model").alias(f"{f}_how")
    storeys = F.col("stories_total")
    return out.select(
        F.col("id").alias("record_id"), F.round("height_m", 2).alias("height"), how("height"),
        F.when(storeys.isNotNull() & F.col("numstories_gap"), F.greatest(F.lit(1.0), F.round(storeys))).otherwise(F.round(storeys, 3)).alias("numstories"), how("numstories"),
        F.round("area", 2).alias("fpArea"), how("fpArea"), F.when(F.col("roofshape_gap"), F.col("shape")).otherwise(F.col("typed_shape")).alias("roofshape"), how("roofshape"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The values that were missing: those that the filling operator marked and gave a value."""
    out = p2_filled(spark, d)
    marks = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"{f}_how").isNotNull() & F.col(f).isNotNull()).alias("filled")) for f in FILLED])
    return out.select("record_id", F.inline(F.filter(marks, lambda m: m.filled))).select("record_id", "field")


QUERIES |= {"p2_found": p2_found, "p2_filled": p2_filled}
