"""File names with capitals of other scripts: one form in p5 is one image in p4."""

import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from slatework.llm import lookalike
from slatework.llm.queries import QUERIES


def forms(spark, texts, kind):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.form for r in sorted(lookalike.one_form(df, "t", kind, keep=("i",)).collect(), key=lambda r: r.i)]


def test_names_of_one_form_have_one_image_name(spark):
    pairs = [pair for pair in lookalike.LOOKALIKES.items() if pair[0].isalpha()]
    names = [f"roof{x}_1.png" for pair in pairs for x in pair]
    text = forms(spark, names, "text")
    assert text[::2] == text[1::2]
    df = spark.createDataFrame(list(enumerate(names)), "i long, t string")
    images: dict = {}
    for r in lookalike.image_names(df, "t", keep=("i",)).collect():
        images.setdefault(r.i, set()).add(r.image)
    assert all(images[2 * k] & images[2 * k + 1] for k in range(len(pairs)))


def test_image_names_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, ".png"), (4, "a/B_1 (3).PNG"), (4, "a/B_1 (3).PNG")], "i long, t string")
    assert sorted(map(tuple, lookalike.image_names(df, "t", keep=("i",)).collect())) == [(4, "b_1 (3).png", "b_1")] * 2
    assert lookalike.image_names(df.where("false"), "t").count() == 0
    pairs = spark.createDataFrame([("b_1 (3).png", "copy of b_1.jpg"), ("b_1.png", "b_2.png"), (None, "b")], "a string, b string")
    assert [r.same_image for r in lookalike.same_image(pairs, "a", "b").collect()] == [True, False, None]


def test_pairs_of_capital_lookalikes(spark, sf, tmp_path):
    for f in os.listdir(sf):
        if f != "building_metadata.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    schema = pq.read_schema(f"{sf}/building_metadata.parquet")
    t = pd.read_parquet(f"{sf}/building_metadata.parquet").head(6)
    t["record_id"], t["latitude"], t["longitude"] = range(6), None, None
    t["split"] = ["train", "holdout", "val", "train", "holdout", "val"]
    # Of the Cyrillic and Greek capitals the first three look like Latin ones; the last three are one name but for case.
    t["filename"] = ["ROOF_BMHT_1.png", "ROOF_ВМНТ_1.png", "ROOF_ΒΜΗΤ_1.png", "вода_нет_2.png", "ВОДА_НЕТ_2.png", "other_3.png"]
    pq.write_table(pa.Table.from_pandas(t, schema=schema, preserve_index=False), tmp_path / "building_metadata.parquet")
    got = sorted((r.record_a, r.record_b) for r in QUERIES["p4_found"](spark, str(tmp_path)).collect())
    assert got == [(0, 1), (0, 2), (3, 4)]
