"""Closed forms, brute force and the decisions on the odd cases of the reference operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework.functions import geo, names
from slatework.operators import damage, exposure, heatmaps, jobs, registry, sampling, spatial, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_hybrid_class(spark):
    assert one(spark, damage.hybrid_class(arr([0.6, 0.1, 0.1, 0.1, 0.1]))) == "no-damage"
    assert one(spark, damage.hybrid_class(arr([0.0, 0.0, 0.0, 0.5, 0.5]))) == "destroyed"  # rank 4.5, half to even
    assert one(spark, damage.hybrid_class(arr([0.25, 0.25, 0.25, 0.25, 0.0]))) == "minor-damage"  # rank 2.5 to even
    assert one(spark, damage.hybrid_class(F.lit(None).cast("array<double>"))) is None


def test_one_run_has_no_deviation_and_full_bounds(spark):
    r = damage.interval_summary(spark.createDataFrame([("m", 40.0)], "k string, v double"), ["k"], "v", 0.0, 100.0).first()
    assert (r["std"], r["lo"], r["hi"], r["n_runs"]) == (None, 0.0, 100.0, 1)


def test_identity_confusion_and_empty_rows(spark):
    df = spark.createDataFrame([("a", c, c) for c in damage.DAMAGE_CLASSES[:3]] + [("a", None, "minor-damage")], "k string, t string, p string")
    got = {(r.true_class, r.pred_class): r.share for r in damage.row_normalised(damage.confusion_counts(df, ["k"], "t", "p"), ["k"]).collect()}
    assert len(got) == 16
    assert all(v == (1.0 if a == b and a != "destroyed" else 0.0) for (a, b), v in got.items())
    pct = damage.class_percentages(df, ["k"], "p").collect()
    assert sum(r.pct for r in pct) == pytest.approx(100)


def test_uniform_and_single_pixel_heatmaps(spark):
    w = 16
    single = [0.0] * (w * w)
    single[3 * w + 12] = 2.0
    df = spark.createDataFrame([(1, [1.0] * (w * w)), (2, single), (3, [0.0] * (w * w))], "id int, a array<double>")
    px = heatmaps.pixels(df, ["id"], "a", w)
    s = {r.id: r for r in heatmaps.statistics(px, ["id"], w, w).collect()}
    assert s[1].mass_center_25_square == pytest.approx(0.25)
    assert s[1].centroid_offset_px == pytest.approx(0.0)
    assert sum(s[1][f"radial_profile_{i}"] for i in range(5)) == pytest.approx(1)
    d = math.hypot(12 - 7.5, 3 - 7.5) / math.hypot(7.5, 7.5)
    assert s[2].radius_for_50_mass_radial == pytest.approx(math.ceil(d * 511 - 1e-9) / 511)
    assert (s[2].peak_x, s[2].peak_y) == (12, 3)
    assert (s[3].radius_for_50_mass_radial, s[3].centroid_x) == (0.0, 7.5)
    n = {r.id: r.is_zero_sum for r in heatmaps.normalised(px, ["id"]).collect()}
    assert n == {1: False, 2: False, 3: True}


def test_half_mass_equals_threshold_scan(spark):
    rnd = np.random.default_rng(4)
    maps = [rnd.random(63).tolist() for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(maps)), "id int, a array<double>")
    got = {r.id: (r.radius_for_50_mass_radial, r.radius_for_50_mass_square) for r in heatmaps.statistics(heatmaps.pixels(df, ["id"], "a", 9), ["id"], 9, 7).collect()}
    y, x = np.mgrid[0:7, 0:9]
    d = np.hypot(x - 4, y - 3) / np.hypot(4, 3)
    t = np.arange(512) / 511
    for i, m in enumerate(maps):
        m = np.array(m).reshape(7, 9) / sum(m)
        radial = next(k for k in t if m[d <= k + 1e-9].sum() >= 0.5 - 1e-12)
        square = next(k for k in t if m[(abs(x - 4) <= 9 * k / 2 + 1e-9) & (abs(y - 3) <= 7 * k / 2 + 1e-9)].sum() >= 0.5 - 1e-12)
        assert got[i] == (pytest.approx(radial), pytest.approx(square))


def test_shape_guard(spark):
    df = spark.createDataFrame([(1, [1.0] * 5)], "id int, a array<double>")
    with pytest.raises(Exception, match="another shape"):
        heatmaps.checked(df, "a", 2, 2).collect()


def test_array_forms(spark):
    assert one(spark, heatmaps.minmax(arr([2, 2]))) == [0.0, 0.0]
    assert one(spark, heatmaps.relu_or_abs(arr([-4, -2]))) == [1.0, 0.0]
    eye = [1.0, 0.0, 0.0, 1.0]
    assert one(spark, heatmaps.row_normalised(arr([0, 0, 0, 0]), 2)) == eye
    assert one(spark, heatmaps.matrix_product(arr([1, 2, 3, 4]), arr([0, 1, 1, 0]), 2)) == [2.0, 1.0, 4.0, 3.0]
    assert one(spark, heatmaps.bilinear(arr([5] * 4), 2, 2, 4, 4)) == [5.0] * 16


def test_names(spark):
    assert one(spark, names.city_of(F.lit("new_town-flood_1_pre_disaster_ab.png"))) == "New Town"
    assert one(spark, names.city_of(F.lit("x_height_1.png"))) == "X"
    assert one(spark, names.city_of(F.lit("plain_1.png"))) == "plain_1"
    assert one(spark, names.uid(F.lit("a_pre_disaster_b_pre_disaster_c.png"))) == "c"
    assert one(spark, names.split_label(F.lit(" "))) == "unknown"


def test_taxonomy(spark):
    assert one(spark, exposure.stamped(F.lit("A/B/H1/C"), F.lit("H9"))) == "A/B/H9/C"
    assert one(spark, exposure.stamped(F.lit("A/B"), F.lit("H9"))) == "A/B"
    assert one(spark, exposure.standardised(F.lit("W+WS/LPB+DU:L/HBET1-2"))) == "W/LFM-DUL/H1"
    # Unreinforced runs keep their masonry filter; W matches anywhere.
    p = lambda m, o, w, r: one(spark, exposure.pattern(F.lit(m), F.lit(o), F.lit(w), F.lit(r)))
    assert p("unreinforced", "RES", 501, 10) == "MUR"
    assert p("reinforced", "RES", 527, 34) == "MCF|MR|CR"
    assert p("material", "RES", 300, None) == "W"
    assert p("material", "COM", 0, None) == "MUR"
    assert one(spark, F.lit("MCF/LWAL").rlike("W"))


def test_draws_follow_the_distribution(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") / 20_000.0).alias("u"))
    dist = sampling.distribution(spark.createDataFrame([("g", "a", 1.0), ("g", "b", 3.0)], "g string, c string, w double"), ["g"], "c", "w")
    n = {r.c: r["count"] for r in sampling.drawn(rows, dist, ["g"], "c", "u").groupBy("c").count().collect()}
    assert n == {"a": 5000, "b": 15000}
    assert sampling.drawn(rows.withColumn("g", F.lit("other")).limit(1), dist, ["g"], "c", "u").first()["c"] is None


def test_tier_is_minimal(spark):
    lib = spark.createDataFrame([("n1", "CR", "A", "D", 3), ("n2", "CR", "A", "D", 9), ("n3", "CR", "A", "E", 1), ("n4", "CR", "B", "D", 1), ("n5", "CR-X", "A", "D", 1)], "name string, mat string, llrs string, duct string, height int")
    want = spark.createDataFrame([(1, "CR", "A", "D", 9), (2, "CR", "A", "D", 5), (3, "CR", "A", "Z", 1), (4, "CR", "Z", "D", 1), (5, "CR-Q", "A", "D", 1), (6, "W", "A", "D", 1), (7, "CR", "A", "D", None)], "key int, mat string, llrs string, duct string, height int")
    got = {r.key: (r.tier, r.name) for r in exposure.tiered_match(want, lib).collect()}
    assert got == {1: (1, "n2"), 2: (2, "n1"), 3: (3, "n3"), 4: (4, "n1"), 5: (5, "n3"), 6: (None, None), 7: (3, "n1")}


def greedy(cands):
    left, out = list(cands), {}
    while left:
        picks = {}
        for p in sorted({c[0] for c in left}):
            picks[p] = min((c for c in left if c[0] == p), key=lambda c: (c[2], c[1], c[3]))
        won = {}
        for p, b, _, centre in picks.values():
            if b not in won or (centre, p) < won[b]:
                won[b] = (centre, p)
        for b, (_, p) in won.items():
            out[p] = b
        left = [c for c in left if c[0] not in out and c[1] not in out.values()]
    return out


def test_assignment_is_one_to_one_and_as_documented(spark):
    rnd = random.Random(2)
    cands = [(p, b, float(rnd.randint(0, 3)), float(rnd.randint(0, 9))) for p in range(12) for b in range(10) if rnd.random() < 0.4]
    got = {r.pid: r.bid for r in spatial.stable_pairs(spark.createDataFrame(cands, "pid long, bid long, boundary double, centre double")).collect()}
    assert got == greedy(cands)
    assert len(set(got.values())) == len(got)
    assert spatial.stable_pairs(spark.createDataFrame([], "pid long, bid long, boundary double, centre double")).count() == 0


@pytest.mark.parametrize("rows", [2_000_000, 45, 0])  # at once, by the least ids of each place, round by round
def test_assignment_of_places_equals_that_of_their_points(spark, monkeypatch, rows):
    monkeypatch.setattr(spatial, "SETTLED_ROWS", rows)
    rnd = random.Random(3)
    n = 30 if rows else 9
    ids = rnd.sample(range(1000), 2 * n)
    pts = [(i, float(rnd.randint(0, 3)), float(rnd.randint(0, 1))) for i in ids[:n]]
    polys = [(i, float(rnd.randint(0, 3)), float(rnd.randint(0, 1))) for i in ids[n:]]
    gap = lambda p, b: (abs(p[1] - b[1]), abs(p[2] - b[2]))
    want = greedy([(p[0], b[0], gap(p, b)[0], gap(p, b)[1]) for p in pts for b in polys if gap(p, b)[0] <= 1])

    def near(p, b):
        b = b.withColumnsRenamed({"x": "bx", "y": "by"})
        dx, dy = F.abs(F.col("x") - F.col("bx")), F.abs(F.col("y") - F.col("by"))
        return p.crossJoin(b).where(dx <= 1).select("pid", "bid", dx.alias("boundary"), dy.alias("centre"))

    points = spark.createDataFrame([*pts, *pts[:5], (2000, None, 1.0)], "pid long, x double, y double")
    polygons = spark.createDataFrame([*polys, *polys[:5], (2001, 1.0, None)], "bid long, x double, y double")
    rows = spatial.stable_places(points, polygons, near).collect()
    assert {r.pid: r.bid for r in rows} == want
    assert len(rows) == len(want)
    assert spatial.stable_places(points.limit(0), polygons, near).count() == 0


def test_assignment_round_by_round_equals_that_at_once(spark, monkeypatch):
    rnd = random.Random(4)
    cands = [(p, b, float(rnd.randint(0, 2)), float(rnd.randint(0, 2))) for p in range(6) for b in range(5) if rnd.random() < 0.6]
    df = spark.createDataFrame([*cands, *cands[:3]], "pid long, bid long, boundary double, centre double")
    want = greedy(cands)
    assert {r.pid: r.bid for r in spatial.stable_pairs(df).collect()} == want
    monkeypatch.setattr(spatial, "SETTLED_ROWS", 0)
    assert {r.pid: r.bid for r in spatial.stable_pairs(df).collect()} == want
    named = df.selectExpr("concat('p', pid) as pid", "concat('b', bid) as bid", "boundary", "centre")
    assert {r.pid: r.bid for r in spatial.stable_pairs(named).collect()} == {f"p{p}": f"b{b}" for p, b in want.items()}


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(9)
    pts = [(i, rnd.uniform(-500, 500), rnd.uniform(-500, 500)) for i in range(80)] + [(99, 9000.0, 9000.0), (100, None, 1.0)]
    sites = [(i, float(rnd.randint(-20, 20)), float(rnd.randint(-20, 20))) for i in range(15)]
    got = {r.pid: r.sid for r in spatial.nearest(spark.createDataFrame(pts, "pid long, x double, y double"), spark.createDataFrame(sites, "sid long, x double, y double")).collect()}
    want = {p[0]: min(sites, key=lambda s: ((p[1] - s[1]) ** 2 + (p[2] - s[2]) ** 2, s[0]))[0] for p in pts if p[1] is not None}
    assert got == want


def test_interior_point_and_geometry(spark):
    ring = [(0, 0), (30, 0), (30, 10), (10, 10), (10, 30), (0, 30), (0, 0)]
    e = np.array([[*a, *b] for a, b in zip(ring, ring[1:], strict=False)], dtype=float)
    x, y, d = spatial.interior_point(e, 0.01)
    brute = max((spatial._signed(px / 4, py / 4, e) for px in range(121) for py in range(121)))
    assert d == pytest.approx(spatial._signed(x, y, e))
    assert d >= brute - 0.01
    wkt = F.lit("POLYGON ((0 0, 30 0, 30 10, 10 10, 10 30, 0 30, 0 0))")
    assert one(spark, spatial.ring_area(geo.wkt_edges(wkt))) == 500.0
    assert one(spark, geo.wkt_edges(F.lit("POLYGON ((0 0, x"))) is None
    east, north = spatial.utm(F.lit(0.0), F.lit(-99.0), -99.0)
    assert (one(spark, east), one(spark, north)) == (500000.0, 0.0)


def test_raster_bounds_and_nodata(spark):
    raster = spark.createDataFrame([(0, 0, 5), (0, 1, 7)], "row int, col int, value int")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, -1.0, 0.5), (4, 0.5, 9.0), (5, None, 0.5)], "pid int, x double, y double")
    got = {r.pid: r.value for r in spatial.sampled(pts, raster, 0.0, 1.0, 1.0, 2, 1, nodata=7).collect()}
    assert got == {1: 5, 2: -1, 3: -1, 4: -1, 5: -1}


def test_tables(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    up = tables.keyed_update(df, spark.createDataFrame([("a", 9)], "k string, v int"), "k", "v")
    assert sorted((r.v, r.updated) for r in up.collect()) == [(2, False), (3, False), (9, True)]
    assert [r.n for r in tables.histogram(df, "v", 2).orderBy("bin").collect()] == [1, 2]
    assert [r.n for r in tables.histogram(df.where("false"), "v", 2).collect()] == [0, 0]
    assert {(r.k, r.present) for r in tables.present_and_absent(df, df.where("k = 'a'"), "k").collect()} == {("a", True), ("b", False), (None, False)}


def test_jobs(spark):
    ev = spark.createDataFrame([("j", "pending", 1, 1), ("j", "running", 2, 2), ("j", "failed", 3, 3), ("j", "running", 4, 4), ("k", "done", 1, 5)], "job string, state string, at long, event_id long")
    got = {r.job: (r.status, r.started_at, r.finished_at) for r in jobs.folded(ev).collect()}
    assert got == {"j": ("running", 4, 3), "k": ("done", None, 1)}
    assert {r.status: r.n for r in jobs.summary(jobs.folded(ev)).collect()} == {"pending": 0, "running": 1, "done": 1, "failed": 0}
    wanted = spark.createDataFrame([("a", "o1"), ("b", "o2"), ("c", "o3")], "job_id string, output string")
    state = spark.createDataFrame([("a", "done"), ("b", "done"), ("c", "failed")], "job_id string, status string")
    acts = {r.job_id: r.action for r in jobs.actions(wanted, state, spark.createDataFrame([("o1",), ("o3",)], "output string")).collect()}
    assert acts == {"a": "skip", "b": "run", "c": "run"}


def test_registry(spark):
    @registry.register_attribution("double", "simple")
    def double(image, target):
        return image * 2 + target

    assert registry.select_methods(["simple", "double"]) == ["double"]
    with pytest.raises(KeyError):
        registry.select_methods("nothing")
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1)], "image_id int, pixels array<double>, target int")
    assert registry.attribute(df, "double", 2).first()["heatmap"] == [3.0, 5.0, 7.0, 9.0]
    masks = np.array([[[1, 0]], [[0, 1]]], dtype=float)
    assert registry.rise(lambda m: m.sum(), np.array([[2.0, 5.0]]), masks).tolist() == [[2.0, 5.0]]
    registry.register_sql(spark)
    assert spark.sql("select nfc_normalize('é') as x").first()["x"] == "é"


def test_soft_masks_and_rise():
    import numpy as np

    from slatework.operators import registry

    m = registry.soft_masks(300, 40, 30, grid=6, keep=0.4, seed=3)
    assert m.shape == (300, 30, 40)
    assert m.min() >= 0
    assert m.max() <= 1
    assert abs(m.mean() - 0.4) < 0.02
    assert len(np.unique(m[0])) > 30  # soft edges
    assert np.array_equal(m, registry.soft_masks(300, 40, 30, grid=6, keep=0.4, seed=3))
    image = np.zeros((30, 40))
    image[5:10, 5:10] = 1.0
    heat = registry.rise(lambda x: x.sum(), image, number=400, grid=6)
    assert heat[5:10, 5:10].mean() > heat[20:, 20:].mean()


def test_single_pick_allowed_values_and_runs(spark):
    import pytest
    from pyspark.errors import PySparkException

    from slatework.operators import jobs, sampling

    df = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "k long, n string")
    one = {tuple(sampling.pick_one(df.repartition(p), "k", 5).first()) for p in (1, 3, 7)}
    assert len(one) == 1
    assert {sampling.pick_one(df, "k", s).first()["k"] for s in range(6)} != {next(iter(one))[0]}
    assert sampling.pick_one(df.where("false"), "k", 5).count() == 0
    assert tables.of_values(df, "n", [f"n{i}" for i in range(50)]).count() == 50
    with pytest.raises(PySparkException, match="n has the value n7"):
        tables.of_values(df.where("k = 7"), "n", ["n1"]).collect()
    assert tables.of_values(spark.createDataFrame([(None,)], "n string"), "n", ["a", None]).count() == 1
    grid = jobs.run_grid(spark, ["material", "benchmark"], 3, start=5)
    assert sorted(map(tuple, grid.collect())) == [(m, s) for m in ("benchmark", "material") for s in (5, 6, 7)]
    with pytest.raises(ValueError, match="unknown modes"):
        jobs.run_grid(spark, ["x"], 1)
    there = spark.createDataFrame([("material", 5)], "mode string, seed int")
    assert jobs.run_all(grid, None, there, dry=True).count() == 5
    ran = jobs.run_all(grid, lambda mode, seed: 1 // (seed - 6) is not None, there)
    assert {(r["mode"], r["seed"]): r.success for r in ran.collect()} == {("benchmark", 5): True, ("benchmark", 6): False, ("benchmark", 7): True, ("material", 6): False, ("material", 7): True}
    a = jobs.time_audit(spark.createDataFrame([(True, 1.0, 3600.0), (False, 9.0, 7200.0), (None, 9.0, None)], "success boolean, build double, total double"), ["build", "total"]).first()
    assert tuple(a) == (3, 1, 1.0, 3600.0, 3.0)
