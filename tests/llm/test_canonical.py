"""The mapping to reference lists against brute force, and what decides between entries."""

import pandas as pd
import pytest
import regex

canonical = pytest.importorskip("slatework.llm.canonical")
queries = pytest.importorskip("slatework.llm.queries")

CITIES = "city_id long, city_name string, country string, latitude double, longitude double"


def edits(a, b, most):
    """Optimal string alignment distance, or most + 1 beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > most and min(before) > most:
            return most + 1
    return row[-1]


def within(value, paths, noise):
    """All entries within the allowed distance, by brute force over all spellings."""
    out = {}
    p = canonical.plain(value)
    for reading in {p, " ".join(regex.sub(noise, " ", p).split())} - {""}:
        most = canonical.allowed(len(reading))
        for spelling, entry in paths:
            d = edits(reading, spelling, most)
            if d <= most:
                out[entry] = min(d, out.get(entry, d))
    return out


def test_candidates_equal_brute_force(spark, sf):
    reference = pd.read_parquet(f"{sf}/city_reference.parquet")
    paths = canonical.city_paths(list(reference[["city_id", "city_name", "country"]].itertuples(index=False, name=None)))
    got: dict = {}
    for r in queries.QUERIES["p3_candidates"](spark, sf).collect():
        got.setdefault(r.value, {})[r.city_id] = r.edits
    typed = sorted({v for v in pd.read_parquet(f"{sf}/building_metadata.parquet")["city"].dropna() if v.strip()})[::4]
    assert len(typed) > 50
    assert {v: got.get(v, {}) for v in typed} == {v: within(v, paths, canonical.CITY_NOISE) for v in typed}


def test_found_equals_brute_force_for_roof_shapes(spark, sf):
    from slatework.functions import entries

    shapes = pd.read_parquet(f"{sf}/roofshape_list.parquet")
    named = list(shapes[["shape_id", "roofshape", "also_called"]].itertuples(index=False, name=None))
    paths, known = canonical.roof_paths(named), {n for _, n, _ in named}
    rows = pd.read_parquet(f"{sf}/building_metadata.parquet")[["record_id", "roofshape"]].dropna()
    want = {}
    for i, v in rows.itertuples(index=False, name=None):
        if v not in known and v.strip().lower() not in entries.NOT_RECORDED:
            want[i] = min(((d, e) for e, d in within(v, paths, canonical.ROOF_NOISE).items()), default=(0, -1))[1]
    got = {r.row_id: r.ref_id for r in queries.QUERIES["p3_found"](spark, sf).where("field = 'roofshape'").collect()}
    assert got == want


def test_noise_words_are_no_letters_of_a_name(spark):
    shapes = spark.createDataFrame([(3, "Hipped", "hip"), (4, "Half-Hipped", None)], "shape_id long, roofshape string, also_called string")
    rows = spark.createDataFrame([(1, "roof: hipped", None, None), (2, "roof half hipped", None, None), (3, "unknown", None, None)], "id long, value string, lat double, lon double")
    assert sorted((r.id, r.ref_id) for r in canonical.roofshapes(rows, shapes).collect()) == [(1, 3), (2, 4)]


def test_a_slip_that_leads_to_another_city(spark):
    """The place of the row decides between entries within the distance; without a place the fewest edits do."""
    r = spark.createDataFrame([(1, "Triluvilla, Norland", "Norland", 10.0, 10.0), (2, "Triluviola, Sudland", "Sudland", 0.0, 50.0)], CITIES)
    rows = [(1, "triluvilla", 0.1, 50.1), (2, "triluvilla", None, None), (3, "triluvilla", 60.0, 60.0), (4, "Triluviola", 10.1, 10.1), (5, "Triluviola, Sudland.", 10.1, 10.1)]
    got = {x.id: x.ref_id for x in canonical.cities(spark.createDataFrame(rows, "id long, value string, lat double, lon double"), r).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 1, 5: 2}
