"""Reference lists longer than their bound are refused, not cut."""

import os

import pandas as pd
import pytest

from slatework.llm import canonical
from slatework.llm.queries import QUERIES
from slatework.plans.training import p2_filled


@pytest.fixture
def long_lists(sf, tmp_path):
    for f in os.listdir(sf):
        if f not in ("split_targets.parquet", "roofshape_list.parquet"):
            os.symlink(f"{sf}/{f}", tmp_path / f)
    for name, key in (("split_targets", "split"), ("roofshape_list", "roofshape")):
        t = pd.read_parquet(f"{sf}/{name}.parquet")
        t = pd.concat([t.head(1)] * 1001, ignore_index=True)
        t[key] = [f"{key} {i}" for i in range(len(t))]
        t.to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_bounded_lists(spark, long_lists):
    for f in (QUERIES["p7_splits"], p2_filled):
        with pytest.raises(ValueError, match="more than 1000 rows"):
            f(spark, long_lists)


def test_reference_lists(spark, monkeypatch):
    monkeypatch.setattr(canonical, "MOST_SPELLINGS", 2)
    rows = spark.createDataFrame([(1, "x", None, None)], "id long, value string, lat double, lon double")
    with pytest.raises(ValueError, match="more than 2 rows"):
        canonical.roofshapes(rows, spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "a", None)], "shape_id long, roofshape string, also_called string"))
    with pytest.raises(ValueError, match="more than 2 rows"):
        canonical.cities(rows, spark.createDataFrame([(i, "a", None, None, None) for i in range(3)], "city_id long, city_name string, country string, latitude double, longitude double"))
