import math
import random

import pytest
from pyspark.sql import functions as F

from slatework.operators import imputation

SCHEMA = "id long, a double, b double, kind string, place string, at timestamp, note string"


def data(n=3000, seed=5):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        x = rnd.gauss(0, 1)
        kind = "flat" if x < 0 else "tall"
        rows.append((i, math.exp(x), math.exp(2 * x + rnd.gauss(0, 0.2)), kind, f"p{i % 7}", None, f"n{i}"))
    return rows


def test_filling_recovers_what_was_hidden(spark):
    rows = data()
    hidden = [(i, a, None if i % 4 == 0 else b, None if i % 5 == 0 else k, p, t, n) for i, a, b, k, p, t, n in rows]
    plan = imputation.Plan(("a", "b"), "kind", ("flat", "tall"), ("place",))
    out = {r.id: r for r in imputation.chained(spark.createDataFrame(hidden, SCHEMA), plan, "id", "at", ("note",)).collect()}
    errors = [math.log(out[i].b) - math.log(b) for i, a, b, *_ in rows if i % 4 == 0]
    assert all(out[i].b_filled == (i % 4 == 0) and out[i].kind_filled == (i % 5 == 0) and out[i].note == f"n{i}" for i in out)
    assert all(out[i].b == pytest.approx(b) for i, a, b, *_ in rows if i % 4)
    assert abs(sum(errors) / len(errors)) < 0.05
    sd = (sum(e * e for e in errors) / len(errors)) ** 0.5
    assert 0.2 < sd < 0.6  # the residual spread is kept: the error of a draw is about root two of the noise
    right = sum(out[i].kind == k for i, _, _, k, *_ in rows if i % 5 == 0) / (len(rows) / 5)
    assert right > 0.8


def test_result_does_not_depend_on_partitions(spark):
    hidden = [(i, a, None if i % 4 == 0 else b, k, p, t, n) for i, a, b, k, p, t, n in data(400)]
    plan = imputation.Plan(("a", "b"), "kind", ("flat", "tall"), ("place",))
    one = {r.id: round(r.b, 6) for r in imputation.chained(spark.createDataFrame(hidden, SCHEMA).repartition(1), plan, "id").collect()}
    many = {r.id: round(r.b, 6) for r in imputation.chained(spark.createDataFrame(hidden, SCHEMA).repartition(7), plan, "id").collect()}
    assert one == many


def test_nothing_recorded_empty_and_repeated(spark):
    plan = imputation.Plan(("a", "b"), "kind", ("flat", "tall"), ("place",))
    df = spark.createDataFrame([(1, 2.0, None, None, None, None, None), (1, 2.0, None, None, None, None, None), (2, None, None, None, "x", None, None)], SCHEMA)
    out = imputation.chained(df, plan, "id").collect()
    assert sorted(r.id for r in out) == [1, 1, 2]
    assert all(r.b is None and not r.b_filled and not r.kind_filled for r in out)
    assert [r.a for r in out if r.id == 2][0] > 0
    assert imputation.chained(df.where("false"), plan, "id").count() == 0


def test_donors(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, 5.0), ("k", 3, 6.0), (None, 4, 7.0)], "key string, n int, v double")
    assert [(r.key, r.d_v) for r in imputation.donated(df, "key", ["v"], ["n"]).collect()] == [("k", 5.0)]
    assert df.select(F.col("v")).count() == 4


def test_answers_come_from_the_chain(spark, sf, monkeypatch):
    """Without the chain only values told by copies of a record are found; every row found has a value."""
    from slatework.plans import training

    out = training.p2_filled(spark, sf)
    told = {(r.record_id, f) for r in out.collect() for f in training.FILLED if r[f"{f}_how"] == "building"}
    found = {tuple(r) for r in training.p2_found(spark, sf).collect()}
    assert len(found) > len(told)

    def nothing(df, plan, id_col, when=None, keep=()):
        fields = [*plan.numeric, plan.categorical]
        return df.select(F.col(id_col).alias("id"), *[c for f in fields for c in (F.col(f), F.lit(False).alias(f"{f}_filled"))], *keep)

    monkeypatch.setattr(imputation, "chained", nothing)
    assert {tuple(r) for r in training.p2_found(spark, sf).collect()} == told


def test_hidden_values_of_the_buildings_come_back_with_their_spread(spark):
    """A fifth of the recorded values is hidden and filled: spread within a twentieth, better than chance, within the recorded range, storeys tied to heights."""
    import numpy as np

    from slatework.operators import units

    d = "/root/testdata/sf0.1"
    b = spark.read.parquet(f"{d}/building_metadata.parquet").select(*units.INPUTS, "record_id", "city", "material_class", F.when(F.col("fpArea") > 0, F.col("fpArea")).alias("area"), F.lower(F.trim("roofshape")).alias("shape"))
    c = units.common_units(b, spark.read.parquet(f"{d}/source_catalog.parquet")).cache()
    fields = ("height_m", "stories_total", "area", "shape")
    hide = lambda i, f: F.when(F.pmod(F.xxhash64(F.lit(i), "record_id"), F.lit(5)) != 0, F.col(f)).alias(f)
    plan = imputation.Plan(fields[:3], "shape", ("flat", "gabled", "hipped"), ("material_class", "city"))
    out = imputation.chained(c.select("record_id", "captured_at", "city", "material_class", *[hide(i, f) for i, f in enumerate(fields)]), plan, "record_id", "captured_at").toPandas().set_index("id")
    real = c.select("record_id", *fields).toPandas().set_index("record_id")
    c.unpersist()
    for f in plan.numeric:
        at = real.index[(out[f"{f}_filled"].loc[real.index] & real[f].notna()).to_numpy()]
        a, b = np.log(real[f].loc[at].astype(float)), np.log(out[f].loc[at].astype(float))
        assert abs(b.std() / a.std() - 1) < 0.05
        assert np.corrcoef(a, b)[0, 1] > 0.2
        assert b.min() >= np.log(real[f].min()) - 1e-9
        assert b.max() <= np.log(real[f].max()) + 1e-9
    both = out[out.height_m_filled & out.stories_total_filled]
    assert np.corrcoef(np.log(both.height_m), np.log(both.stories_total))[0, 1] > 0.97
