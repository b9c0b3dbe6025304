import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework.functions import entries
from slatework.operators import units

CATALOGUE = "source string, valid_from timestamp, valid_until timestamp, height_unit string, stories_basis string, note string"
ROWS = "id long, source string, captured_at timestamp, height double, height_text string, numstories double, stories_text string"


def test_changepoints_are_optimal():
    rnd = random.Random(1)
    for _ in range(30):
        n = np.array([rnd.randint(1, 4) for _ in range(9)], dtype=float)
        mean = np.array([rnd.gauss(0 if i < rnd.randint(2, 7) else 3, 1) for i in range(9)])
        square = mean**2 + 0.1

        def cost(cuts, n=n, mean=mean, square=square):
            total = 0.0
            for a, b in itertools.pairwise([0, *cuts, len(n)]):
                w = n[a:b].sum()
                total += (n[a:b] * square[a:b]).sum() - (n[a:b] * mean[a:b]).sum() ** 2 / w
            return total + 2.0 * len(cuts)

        best = min(cost(c) for k in range(9) for c in itertools.combinations(range(1, 9), k))
        got = units.changepoints(n, mean, square, 2.0)
        assert got[0] == 0
        assert cost(got[1:]) == pytest.approx(best)
    assert units.changepoints(np.array([]), np.array([]), np.array([]), 1.0) == []


@pytest.mark.parametrize(
    ("entry", "unit", "metres"),
    [
        ("12 ft 6 in", "ft", 3.81), ("78ft1", "ft", 23.7998), ("10'2\"", "ft", 3.0988), ("9′ 6″", "ft", 2.8956), ("13,8 pies", "ft", 4.20624), ("19.5 FT.", "ft", 5.9436),
        ("3380 CM", "cm", 33.8), ("690 centimetres", "cm", 6.9), ("4200mm", "mm", 4.2), ("3.72 yards", "yd", 3.401568), ("~15,3 m (eaves)", "m", 15.3), ("approx. 22.1 M", "m", 22.1),
        ("6 metros", "m", 6.0), ("from drawings", None, None), ("?", None, None), ("", None, None), (None, None, None), ("12", None, None),
    ],
)
def test_entries(spark, entry, unit, metres):
    r = spark.createDataFrame([(entry,)], "e string").select(entries.height_unit(F.col("e")).alias("u"), entries.entry_metres(F.col("e")).alias("m")).first()
    assert r.u == unit
    assert r.m == (pytest.approx(metres) if metres is not None else None)


def common(spark, rows, catalogue):
    out = units.common_units(spark.createDataFrame(rows, ROWS), spark.createDataFrame(catalogue, CATALOGUE))
    return {r.id: r for r in out.collect()}


T = dt.datetime(2020, 1, 1)


def test_rules_of_source_and_entry(spark):
    cat = [("ftsrc", None, None, "ft", "storeys", ""), ("south", None, None, "m", None, "the level at street height is not counted"), ("tenths", None, None, "m", None, "levels come in tenths of a storey"), ("lidar", None, None, None, "storeys", "in hundredths of a metre")]
    rows = [
        (1, "ftsrc", T, 10.0, None, 2.0, None), (2, "ftsrc", T, 10.0, "10 m", 0.0, "G+0"), (3, "south", T, 340.0, None, 0.0, None), (4, "tenths", T, 3.0, None, 30.0, None),
        (5, "lidar", T, 930.0, "checked on site", 12.0, "12 m"), (6, None, T, 5.0, None, 1.0, None), (7, "south", None, -1.0, "n/a", None, "?"), (8, "south", T, float("nan"), None, 4.0, "total of 4 floors"),
        (9, "nowhere", T, 45600.0, None, 0.0, None), (9, "nowhere", T, 45600.0, None, 0.0, None),
    ]
    r = common(spark, rows, cat)
    assert (r[1].height_m, r[1].height_changed, r[1].stories_changed) == (pytest.approx(3.048), True, False)
    assert (r[2].height_m, r[2].height_changed, r[2].stories_total) == (10.0, False, 1.0)
    assert (r[3].height_unit_used, r[3].height_m, r[3].stories_total) == ("cm", pytest.approx(3.4), 1.0)
    assert (r[4].height_changed, r[4].stories_total) == (False, 3.0)
    assert (r[5].height_m, r[5].stories_total) == (pytest.approx(9.3), 4.0)
    assert (r[6].height_changed, r[6].stories_changed) == (False, False)
    assert (r[7].height_m, r[7].stories_total) == (None, None)
    assert (r[8].height_m, r[8].stories_changed) == (None, False)
    assert (r[9].height_unit_used, r[9].stories_total) == ("mm", None)


def test_an_undocumented_change_of_unit_is_found(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        at = dt.datetime(2019, 1, 1) + dt.timedelta(days=i % 1000)
        metres = 3 * rnd.randint(1, 8) + rnd.random()
        rows.append((i, "a", at, metres / (0.3048 if i % 1000 >= 600 else 1.0), None, 1.0, None))
        rows.append((10_000 + i, "b", at, metres, None, 1.0, None))
    r = common(spark, rows, [("a", None, None, "m", "storeys", ""), ("b", None, None, "m", "storeys", "")])
    right = sum(r[i].height_changed == (i % 1000 >= 600) for i in range(1500))
    assert right >= 1480
    assert not any(r[10_000 + i].height_changed for i in range(1500))


def test_a_documented_change_keeps_its_date(spark):
    cut = dt.datetime(2021, 7, 1)
    rows = [(i, "m", cut + dt.timedelta(days=i - 5), 20.0, None, 1.0, None) for i in range(10)]
    r = common(spark, rows, [("m", None, cut, "m", "storeys", ""), ("m", cut, None, "ft", "storeys", "")])
    assert [r[i].height_changed for i in range(10)] == [False] * 5 + [True] * 5


def test_empty_table_and_clashing_columns(spark):
    cat = spark.createDataFrame([], CATALOGUE)
    assert units.common_units(spark.createDataFrame([], ROWS), cat).count() == 0
    df = spark.createDataFrame([(1, None, None, 3.0, None, 1.0, None)], ROWS).withColumns({"_unit": F.lit("x"), "height_m": F.lit("y"), "_own": F.lit(1)})
    r = units.common_units(df, cat).first()
    assert (r["_unit"], r["height_m"], r["_own"]) == ("x", 3.0, 1)


def test_sources_that_the_catalogue_leaves_out_or_gets_wrong(spark):
    """Segments decide where no entry of the catalogue does, or a wrong one; without them the values stay as they are."""
    rnd = random.Random(8)
    rows, metres = [], {}
    for i in range(900):
        at = dt.datetime(2018, 1, 1) + dt.timedelta(days=i)
        for k, (source, factor, by) in enumerate((("good", 1.0, 1), ("unlisted", 0.01 if i < 450 else 1.0, 1), ("wrong", 0.3048, 10 if i >= 300 else 1), ("south", 1.0, 1), ("north", 1.0, 1))):
            n = rnd.randint(1, 8)
            metres[k * 1000 + i] = (3.0 * n + rnd.random(), n)
            rows.append((k * 1000 + i, source, at, metres[k * 1000 + i][0] / factor, None, float(n * by), None))
    cat = [(x, None, None, "m", "storeys", "") for x in ("good", "wrong", "south", "north")]
    r = common(spark, rows, cat)
    right = lambda i: abs(r[i].height_m - metres[i][0]) < 1e-6 and r[i].stories_total == metres[i][1]
    for k in range(5):
        assert sum(right(k * 1000 + i) for i in range(900)) >= 890
    # With no cut allowed but at the catalogue's edges, the unlisted and the wrong source lose their shifts.
    flat = units.common_units(spark.createDataFrame(rows, ROWS), spark.createDataFrame(cat, CATALOGUE), penalty=1e12)
    lost = {x.id for x in flat.collect() if abs(x.height_m - metres[x.id][0]) > 1e-6 or x.stories_total != metres[x.id][1]}
    assert len(lost & set(range(1000, 1900))) >= 400
    assert len(lost & set(range(2000, 2900))) >= 250


def test_edges_of_the_catalogue_hold_to_the_moment(spark):
    cut = dt.datetime(2021, 7, 1, 12, 30)
    rows = [(i, "m", cut + dt.timedelta(minutes=i - 5), 20.0, None, 0.0, None) for i in range(10)]
    r = common(spark, rows, [("m", None, cut, "m", "storeys", ""), ("m", cut, None, "ft", None, "the level at street height is not counted")])
    assert [r[i].height_changed for i in range(10)] == [False] * 5 + [True] * 5
    assert [r[i].stories_total for i in range(10)] == [None] * 5 + [1.0] * 5


def test_answers_come_from_the_segments(spark, sf, monkeypatch):
    from slatework.plans.training import p6_found

    whole = p6_found(spark, sf).count()
    monkeypatch.setattr(units, "source_pieces", lambda values, *_: values.sparkSession.createDataFrame([], units.PIECES))
    assert p6_found(spark, sf).count() < 0.7 * whole


def test_free_cuts_are_optimal():
    rnd = random.Random(2)
    for _ in range(20):
        n = np.array([rnd.randint(0, 3) for _ in range(8)], dtype=float)
        mean = np.array([rnd.gauss(0, 1) for _ in range(8)])
        free = np.array([False] + [rnd.random() < 0.3 for _ in range(7)])

        def cost(cuts, n=n, mean=mean, free=free):
            total = 0.0
            for a, b in itertools.pairwise([0, *cuts, len(n)]):
                total += (n[a:b] * mean[a:b] ** 2).sum() - (n[a:b] * mean[a:b]).sum() ** 2 / max(n[a:b].sum(), 1e-12)
            return total + sum(-0.001 if free[c] else 1.0 for c in cuts)

        best = min(cost(c) for k in range(8) for c in itertools.combinations(range(1, 8), k))
        got = units.changepoints(n, mean, mean**2, 1.0, free)
        assert cost(got[1:]) == pytest.approx(best)
        assert set(np.flatnonzero(free)) <= set(got)
