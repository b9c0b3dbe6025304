"""Taxonomies of buildings: stamping, standardising, weighted assignment and tiered matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.functions.vocab import FLEXIBLE_CODES, MASONRY_CODES, MODES, NO_WALL
from slatework.operators import sampling
from slatework.session import small, written


def stamped(taxonomy: Column, token: Column) -> Column:
    """The taxonomy with its third part replaced; unchanged if it has fewer parts."""
    parts = F.split(taxonomy, "/")
    return F.when(F.size(parts) >= 3, F.array_join(F.transform(parts, lambda p, i: F.when(i == 2, token).otherwise(p)), "/")).otherwise(taxonomy)


def standardised(taxonomy: Column) -> Column:
    """Without wood details, with height ranges as their lower bound, ``+`` as ``-`` and no colons."""
    t = taxonomy
    for detail in ("+WS", "+WLI", "+WBB"):
        t = F.replace(t, F.lit(detail), F.lit(""))
    t = F.replace(t, F.lit("LPB"), F.lit("LFM"))
    t = F.regexp_replace(t, r"HBET([0-9]+)-[0-9]+", "H$1")
    return F.replace(F.replace(t, F.lit("+"), F.lit("-")), F.lit(":"), F.lit(""))


def height_token(stories: Column) -> Column:
    """H and the number of storeys, at most H12."""
    return F.concat(F.lit("H"), F.least(stories, F.lit(12)).cast("string"))


def pattern(mode: Column, occ: Column, wall: Column, roof: Column) -> Column:
    """Which materials a building may have, as a regular expression; empty matches all.

    Unreinforced runs keep their masonry filter, as documented (it is not overwritten by the
    match-all default), and ``W`` matches anywhere in the taxonomy.
    """
    masonry = F.coalesce(roof.isin(MASONRY_CODES), F.lit(False))
    flexible = F.coalesce(roof.isin(FLEXIBLE_CODES), F.lit(False))
    home = (
        F.when(wall.isin(501, 527), F.when(mode == "reinforced", "MCF|MR|CR").when(mode == "unreinforced", "MUR").when(masonry, "MUR").otherwise("MCF|MR|CR"))
        .when(wall.between(200, 299), "INF").when(wall == 300, "W").otherwise("")
    )
    return F.when(mode == "benchmark", "").when(occ == "RES", home).when(flexible, "MCF|MR|CR").otherwise("MUR")


def assign_taxonomies(buildings: DataFrame, library: DataFrame, walls: DataFrame) -> DataFrame:
    """buildings (with h, occ, roof, u1, u2) in every mode, with the taxonomy drawn.

    u1 draws the wall given the roof (unknown roofs have wall 501), u2 the taxonomy among those of
    the occupancy that match the pattern, or among all of the occupancy if none does. An occupancy
    without any taxonomy gives UNK_{height}/{occupancy}. The candidates are prepared per (occupancy,
    pattern), a handful of rows, not per building.
    """
    b = sampling.drawn(buildings, sampling.distribution(walls, ["roof"], "wall", "weight"), ["roof"], "wall", "u1").withColumn("wall", F.coalesce("wall", F.lit(NO_WALL)))
    b = b.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES]))).withColumn("pattern", pattern(F.col("mode"), F.col("occ"), F.col("wall"), F.col("roof")))
    kinds = ["", "MUR", "MCF|MR|CR", "INF", "W"]  # all patterns there are
    lib = library.withColumn("pattern", F.explode(F.array(*[F.lit(k) for k in kinds]))).withColumn("hit", F.expr("tax rlike pattern"))
    any_hit = lib.groupBy("occ", "pattern").agg(F.max("hit").alias("some"))
    cand = lib.join(any_hit, ["occ", "pattern"]).where("hit or not some")
    out = sampling.drawn(b, sampling.distribution(cand, ["occ", "pattern"], "tax", "weight"), ["occ", "pattern"], "tax", "u2")
    token = height_token(F.col("h"))
    return out.withColumn("taxonomy", F.when(F.col("tax").isNull(), F.concat(F.lit("UNK_"), token, F.lit("/"), F.col("occ"))).otherwise(stamped(F.col("tax"), token)))


def tiered_match(wanted: DataFrame, library: DataFrame) -> DataFrame:
    """wanted (key, mat, llrs, duct, height int or null) with the best library curve: name, tier 1..6, distance.

    library: name, mat, llrs, duct, height. Tiers: 1 all equal; 2 same but for the nearest height (only
    if the height is known); 3 same material and llrs, any ductility, exact height first; 4 same material; 5 same base
    material (before the first dash) and llrs, exact height first; 6 same base material, any llrs. Ties go to the
    first name. Unmatched rows keep null. The join is by base material, so a row meets only its own curves;
    both sides are collapsed to distinct properties before it.
    """
    base = lambda c: F.split_part(F.col(c), F.lit("-"), F.lit(1))
    # Of curves with the same properties only the first by name can be taken; what is left is broadcast if it is small.
    lib = library.groupBy(*[F.col(c).alias(f"l_{c}") for c in ("mat", "llrs", "duct", "height")]).agg(F.min("name").alias("name")).withColumn("_base", base("l_mat"))
    lib = small(written(lib, "curves"))
    # Distinct requests only: buildings with the same taxonomy are matched once.
    asked = wanted.select("mat", "llrs", "duct", "height").distinct().withColumn("_base", base("mat"))
    c = asked.join(lib, "_base")
    same_mat, same_llrs, same_duct = F.col("mat") == F.col("l_mat"), F.col("llrs") == F.col("l_llrs"), F.col("duct") == F.col("l_duct")
    exact = F.coalesce(F.col("height") == F.col("l_height"), F.lit(False))
    gap = F.abs(F.col("height") - F.col("l_height"))
    tier = (
        F.when(same_mat & same_llrs & same_duct & exact, 1).when(same_mat & same_llrs & same_duct & gap.isNotNull(), 2).when(same_mat & same_llrs, 3)
        .when(same_mat, 4).when(same_llrs, 5).otherwise(6)
    )
    away = F.when(F.col("tier") == 2, gap).when(F.col("tier").isin(3, 5), F.when(exact, 0).otherwise(1)).otherwise(0)
    best = c.withColumn("tier", tier).withColumn("distance", away).groupBy("mat", "llrs", "duct", "height").agg(F.min(F.struct("tier", "distance", "name")).alias("_b"))
    keys = ("mat", "llrs", "duct", "height")
    best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "_b")
    out = wanted.join(best, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return out.select(*wanted.columns, F.col("_b.name").alias("name"), F.col("_b.tier").alias("tier"), F.col("_b.distance").alias("distance"))
