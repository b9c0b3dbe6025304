import pytest
from pyspark.sql import functions as F

from slatework.operators import heatmaps, registry, sampling
from slatework.plans import pipeline
from slatework.sources import files


def test_dataset(spark):
    meta = spark.createDataFrame([("a", "New Town, X", "AmorphousConcrete", None), ("b", "Other", "Thatch", "Dome")], "filename string, city string, material_class string, roofshape string")
    lists = spark.createDataFrame([("new town, x", ["Thatch"])], "city string, allowed array<string>")
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "filename string")
    got = {r.filename: (r.material_class, r.roofshape, r.status) for r in pipeline.build_dataset(images, meta, lists).collect()}
    assert got == {"a": ("AmorphousConcrete", "Flat", "reassess"), "b": ("Thatch", "Dome", "no_list"), "c": (None, None, "no_list")}
    new = spark.createDataFrame([("a", "Thatch")], "filename string, material_class string")
    assert [r.status for r in pipeline.build_dataset(images, meta, lists, new).collect() if r.filename == "a"] == ["ok"]


def test_damage(spark):
    p = [1.0, 0.0, 0.0, 0.0, 0.0]
    res = spark.createDataFrame([("m", s, u, p) for s in (1, 2) for u in ("x", "y")], "mode string, seed int, uid string, p array<double>")
    pct, cells = pipeline.damage_analysis(res, spark.createDataFrame([("x", "no-damage"), ("y", "minor-damage")], "uid string, subtype string"))
    assert {r.pred_class: r["mean"] for r in pct.collect()} == {"no-damage": 100.0, "minor-damage": 0.0, "major-damage": 0.0, "destroyed": 0.0}
    assert {r["mean"] for r in cells.collect() if r.pred_class == "no-damage" and r.true_class in ("no-damage", "minor-damage")} == {1.0}


def test_attribution_resumes(spark):
    registry.register_attribution("same", "plain")(lambda image, target: image)
    images = spark.createDataFrame([("i1", [1.0, 0.0, 0.0, 1.0], 0), ("i2", [0.0, 0.0, 0.0, 0.0], 0)], "image_id string, pixels array<double>, target int")
    done = spark.createDataFrame([("i1__same", "done", "i1__same"), ("i2__same", "failed", "i2__same")], "job_id string, status string, output string")
    stats, summary = pipeline.attribute_batch(images, done, "same", 2, 2)
    assert [r.image_id for r in stats.collect()] == ["i2"]
    assert summary.first()["zero_sum_images"] == 1


def test_gradcam_and_rollout(spark):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    r = spark.range(1).select(
        heatmaps.token_gradcam(lit([9, 9, 1, 1, 2, 2]), lit([1] * 6), 2, 3).alias("t"), heatmaps.spatial_gradcam(lit([1, 2, 3, 4]), lit([1, 1, 0, 0]), 2, 2).alias("s"),
        heatmaps.rollout(F.array(F.struct(lit([0, 1, 0, 0]).alias("attention"), lit([1, 1, 1, 1]).alias("gradient"))), 2).alias("r"),
    ).first()
    assert (r.t, r.s, r.r) == ([0.0, 1.0], [0.0, 1.0], [0.5])


def test_draws_with_replacement(spark):
    rows = spark.createDataFrame([(i, 3.0 if i == 5 else 1.0) for i in range(10)] + [(11, 0.0)], "k long, w double")
    n = {r.k: r["count"] for r in sampling.with_replacement(rows, "k", "w", 6000, 1).groupBy("k").count().collect()}
    assert sum(n.values()) == 6000
    assert 11 not in n
    assert n[5] == pytest.approx(1500, rel=0.1)
    assert sampling.with_replacement(rows.where("false"), "k", "w", 5, 1).count() == 0


def test_nearby(spark):
    b = spark.createDataFrame([(10.0, 20.0, "A"), (10.0001, 20.0, "B"), (11.0, 20.0, "B")], "latitude double, longitude double, city string")
    assert files.nearby_buildings(b, point=(10.0, 20.0), radius_m=20).count() == 2
    assert files.nearby_buildings(b, box=(10.5, 19.0, 12.0, 21.0)).count() == 1
    assert files.nearby_buildings(b, place="B").count() == 2
