"""Whole pipelines as one lazily planned chain of operators: no files between the steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.functions import names
from slatework.functions.vocab import MATERIALS
from slatework.operators import damage, heatmaps, jobs, registry, tables
from slatework.session import small


def build_dataset(images: DataFrame, metadata: DataFrame, allow_list: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Images (filename) enriched, defaulted, classified and verified: filename, city, material_class, roofshape, status.

    metadata: filename, city, material_class, roofshape. allow_list: city, allowed (array). predictions: filename,
    material_class, overwriting the recorded class; keys are unique on the right sides.
    """
    d = images.select("filename").join(metadata, "filename", "left")
    if predictions is not None:
        d = tables.keyed_update(d, predictions, "filename", "material_class").drop("updated")
    loose = F.col("material_class").isin([m for m in MATERIALS if m.startswith("Amorphous")])
    d = d.withColumn("roofshape", F.when(loose & F.col("roofshape").isNull(), "Flat").otherwise(F.col("roofshape")))
    lists = small(allow_list.select(names.city_key(F.col("city")).alias("_k"), "allowed"))
    d = d.join(lists, names.city_key(F.col("city")) == F.col("_k"), "left")
    status = F.when(F.col("_k").isNull() | F.col("allowed").isNull(), "no_list").when(F.array_contains("allowed", F.col("material_class")), "ok").otherwise("reassess")
    return d.select("filename", "city", "material_class", "roofshape", status.alias("status"))


def damage_analysis(results: DataFrame, buildings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary per mode and class, cell statistics of the confusion) of run results.

    results: mode, seed, uid, p (array of five). buildings: uid, subtype. One join, then two aggregations each.
    """
    j = results.join(buildings.select("uid", F.col("subtype").alias("true_class")), "uid").withColumn("pred_class", damage.hybrid_class(F.col("p")))
    pct = damage.interval_summary(damage.class_percentages(j, ["mode", "seed"], "pred_class"), ["mode", "pred_class"], "pct", 0.0, 100.0)
    cells = damage.row_normalised(damage.confusion_counts(j, ["mode", "seed"], "true_class", "pred_class"), ["mode", "seed"])
    return pct, damage.interval_summary(cells, ["mode", "true_class", "pred_class"], "share", 0.0, 1.0)


def attribute_batch(images: DataFrame, done: DataFrame, methods: list[str] | str, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(statistics per image and method, summary per method) of the images that are still to do.

    images: image_id, pixels, target. done: job_id, status, output (the existing ones); a job is done if both say so.
    """
    chosen = registry.select_methods(methods)
    wanted = images.select("image_id", F.explode(damage.literals(chosen)).alias("method"))
    wanted = wanted.withColumn("job_id", jobs.job_id(F.col("image_id").cast("string"), F.col("method"))).withColumn("output", F.col("job_id"))
    todo = jobs.actions(wanted, done.select("job_id", "status"), done.select("output")).where("action = 'run'").select("image_id", "method")
    maps = registry.attribute(images.join(todo.select("image_id").distinct(), "image_id", "left_semi"), chosen, width).join(todo, ["image_id", "method"], "left_semi")
    px = heatmaps.pixels(heatmaps.checked(maps, "heatmap", width, height), ["image_id", "method"], "heatmap", width)
    stats = heatmaps.statistics(px, ["image_id", "method"], width, height)
    return stats, heatmaps.summarised(stats, ["method"])
