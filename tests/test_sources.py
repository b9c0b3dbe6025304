import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from slatework.operators import jobs
from slatework.sources import files, rasters
from slatework.streaming import jobs as streaming


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_encodings(spark, tmp_path):
    a, b = put(tmp_path / "a.csv", "x,y\né,1\n"), put(tmp_path / "b.csv", "x,y\né,1\n", "latin-1")
    assert files.read_csv_any(spark, a, "x string, y int").first()["x"] == "é"
    assert files.read_csv_any(spark, b, "x string, y int").first()["x"] == "é"
    assert files.read_csv(spark, a).dtypes == [("x", "string"), ("y", "int")]


def test_csv_encoding_of_late_accents(spark, tmp_path):
    rows = "x,y\n" + "plain,1\n" * 200_000
    late, cut, utf = put(tmp_path / "l.csv", rows + "é,2\n", "latin-1"), put(tmp_path / "c.csv", rows + "2,é", "latin-1"), put(tmp_path / "u.csv", rows + "é,2\n")
    assert files.read_csv_any(spark, late, "x string, y int").where("y = 2").first()["x"] == "é"
    assert files.read_csv_any(spark, cut, "x string, y string").where("x = '2'").first()["y"] == "é"
    assert files.read_csv_any(spark, utf, "x string, y int").where("y = 2").first()["x"] == "é"


def test_results_and_runs(spark, tmp_path):
    p = put(tmp_path / "r.csv", "# made by an engine\n asset_id , p1 \na,0.5\nb,0.25\n")
    r = files.read_result_csv(spark, p, ["asset_id", "p1"])
    assert sorted((x.asset_id, x.p1) for x in r.collect()) == [("a", "0.5"), ("b", "0.25")]
    assert files.read_result_csv(spark, put(tmp_path / "e.csv", ""), ["x"]) is None
    with pytest.raises(ValueError, match="p9"):
        files.read_result_csv(spark, p, ["p9"])
    d = tmp_path / "runs"
    d.mkdir()
    put(d / "base_seed_3.csv", "# c\nasset_id,p1\na,1\n")
    put(d / "other.csv", "no\n1\n")
    assert [(x["mode"], x["seed"], x["asset_id"]) for x in files.read_runs(spark, str(d), ["asset_id"]).collect()] == [("base", 3, "a")]


def test_curves_blocks_grids_labels(spark, tmp_path):
    c = files.read_curves(spark, put(tmp_path / "CR.csv", "PGA , Slight , Complete\n0.1,0.0,x\n0.2,0.5,0.1\n"))
    assert {(r.curve, r.im, r.limit_state, r.poe) for r in c.collect()} == {("CR", 0.1, "Slight", 0.0), ("CR", 0.1, "Complete", None), ("CR", 0.2, "Slight", 0.5), ("CR", 0.2, "Complete", 0.1)}
    assert [tuple(r) for r in files.read_block(spark, put(tmp_path / "b.txt", "  1  2\n\n3\n"), ["a", "b"]).collect()] == [(1.0, 2.0), (3.0, None)]
    g = put(tmp_path / "g.xml", '<s><grid_field index="1" name="LON"/><grid_field index="2" name="PGA"/><grid_data>\n1 10\n2 20\n</grid_data></s>')
    assert [r.fields for r in files.read_grid_xml(spark, g).orderBy("line").collect()] == [{"LON": 1.0, "PGA": 10.0}, {"LON": 2.0, "PGA": 20.0}]
    f = '{"features":{"lng_lat":[{"wkt":"W%d","properties":{"feature_type":"%s","uid":"u%d","subtype":"minor-damage"}}]}}'
    d = tmp_path / "labels"
    d.mkdir()
    put(d / "1.json", f % (1, "building", 1))
    put(d / "2.json", f % (2, "building", 1))
    put(d / "3.json", f % (3, "road", 2))
    assert [(r.uid, r.wkt) for r in files.read_labels(spark, str(d)).collect()] == [("u1", "W1")]


def test_listing_raster_package(spark, tmp_path):
    d = tmp_path / "x" / "train"
    d.mkdir(parents=True)
    put(d / "a.png", "1")
    put(d / "b.txt", "1")
    put(tmp_path / "x" / "c.PNG", "1")
    assert sorted((r["name"], r["split"]) for r in files.listing(spark, str(tmp_path / "x")).collect()) == [("a.png", "train"), ("c.PNG", "unknown")]
    r, head = rasters.read_ascii_raster(spark, put(tmp_path / "r.asc", "ncols 2\nnrows 2\ncellsize 1\nnodata_value -9\n1 2\n3 -9\n"))
    assert {(x.row, x.col, x.value) for x in r.collect()} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, None)}
    assert head["ncols"] == 2
    path = str(tmp_path / "p.gpkg")
    con = sqlite3.connect(path)
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    con.execute("insert into gpkg_geometry_columns values ('f', 'geom')")
    con.execute("create table f (geom blob, height real)")
    wkb = b"GP\x00\x01" + struct.pack("<i", 4326) + struct.pack("<BIII", 1, 3, 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    con.execute("insert into f values (?, 5.0), (?, null)", (wkb, wkb))
    con.commit()
    con.close()
    assert [(x.wkt, x.height) for x in files.read_geopackage(spark, [path], "f").collect()] == [("POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))", 5.0)]


def test_fetch_routes_to_dead_letters(spark):
    def get(lat, lon):
        if lat > 1:
            raise OSError
        return b"img"

    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", None, 1.0), ("d", 99.0, 1.0)], "filename string, latitude double, longitude double")
    got = {r.filename: (r.content and bytes(r.content), r.reason) for r in files.fetch(df, get, attempts=2).collect()}
    assert got == {"a": (b"img", None), "b": (None, "request_failed"), "c": (None, "bad_coordinates"), "d": (None, "bad_coordinates")}


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([(1.0, 2.0, 300.0), (1.0, 2.0, 300.0)], "lon double, lat double, vs30 double")
    assert [r.value for r in files.site_model_rows(s).collect()] == ['<site lon="1.00000000" lat="2.00000000" vs30="300.0"/>']
    c = spark.createDataFrame([("c", "PGA", 0.1, "slight", 0.5)], "curve string, imt string, im double, limit_state string, poe double")
    assert '<poes ls="slight">0.50000000</poes>' in files.fragility_rows(c).first()["value"]
    assert "costType" in files.exposure_xml("m", ["structural"], "a.csv")
    assert files.job_ini({"general": {"mode": "x"}}) == "[general]\nmode = x\n"
    p = tmp_path / "m.json"
    files.replace_atomically(str(p), "1")
    files.replace_atomically(str(p), "2")
    assert p.read_text() == "2"
    assert files.first_found(str(tmp_path), ["*.none", "*.json"]) == str(p)
    files.write_csv(s, str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 2


def test_streamed_states_equal_batch(spark, tmp_path):
    rows = [(f"j{i % 5}", ["pending", "running", "done", "failed"][i % 4], i, i) for i in range(40)]
    schema = "job string, state string, at long, event_id long"
    for n in range(2):
        spark.createDataFrame(rows[n::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streaming.fold_into(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = streaming.latest(spark.read.parquet(str(tmp_path / "out")))
    want = jobs.folded(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    w = streaming.windowed_counts(spark.createDataFrame([("done", 60.0), ("done", 61.0)], "state string, s double").withColumn("at", F.timestamp_seconds("s")), "at", "1 minute", "1 minute")
    assert w.first()["n"] == 2


def test_head_lines_go_by_their_place(spark, tmp_path):
    """Data that reads like the description or the header stays; files may be split anywhere."""
    rows = "".join(f"a{i},{i}\n" for i in range(4000))
    p = put(tmp_path / "r.csv", "# made by an engine\nasset_id,p1\nasset_id,p1\n# made by an engine,0\n\n" + rows + '"x, y",1\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        r = files.read_result_csv(spark, p, ["asset_id"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(r) == 4003
    assert {("asset_id", "p1"), ("# made by an engine", "0"), ("x, y", "1")} <= {(x.asset_id, x.p1) for x in r}
    assert files.read_result_csv(spark, str(tmp_path / "none.csv"), ["x"]) is None
    assert files.read_result_csv(spark, put(tmp_path / "h.csv", "# d\na,b\n"), ["a"]).count() == 0


def test_run_files_are_counted_and_bad_ones_skipped(spark, tmp_path):
    put(tmp_path / "base_seed_0.csv", "# c\nasset_id,p1\na,1\nb,2\n")
    put(tmp_path / "base_seed_1.csv", "# c\np1, asset_id\n3,c\n")
    put(tmp_path / "base_seed_2.csv", "# c\nother\n3\n")
    put(tmp_path / "base_seed_3.csv", "")
    put(tmp_path / "strong_seed_0.csv", "# c\nasset_id,p1\nz,9\n")
    got = {(r["mode"], r["seed"], r["asset_id"], r["p1"]) for r in files.read_runs(spark, str(tmp_path), ["asset_id", "p1"]).collect()}
    assert got == {("base", 0, "a", "1"), ("base", 0, "b", "2"), ("base", 1, "c", "3"), ("strong", 0, "z", "9")}
    report = {r["mode"]: (r.loaded, r.skipped) for r in files.run_report(spark, str(tmp_path), ["asset_id", "p1"], ["base", "strong", "none"], range(5)).collect()}
    assert report == {"base": (2, 3), "strong": (1, 4), "none": (0, 5)}


def test_text_grid_in_several_splits(spark, tmp_path):
    p = put(tmp_path / "r.asc", "ncols 3\nnrows 2000\nxllcorner 0\nyllcorner 0\ncellsize 1\n" + "".join(f"{i} {i} {i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        r, head = rasters.read_ascii_raster(spark, p)
        assert head["nrows"] == 2000
        assert r.count() == 6000
        assert r.where("row <> value").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def tiff(pixels, compression=1, predictor=1, tile=None, order="<"):
    """A GeoTIFF of one band of 16-bit pixels, in one strip or in tiles."""
    import zlib

    import numpy as np

    h, w = pixels.shape
    blocks = [pixels] if tile is None else [np.pad(pixels, ((0, -h % tile), (0, -w % tile)))[r : r + tile, c : c + tile] for r in range(0, h, tile) for c in range(0, w, tile)]
    data = []
    for b in blocks:
        b = np.diff(b, axis=1, prepend=0).astype("u2") if predictor == 2 else b
        raw = b.astype(order + "u2").tobytes()
        data.append(zlib.compress(raw) if compression == 8 else raw)
    body, at = b"", 8
    places = []
    for d in data:
        places.append(at + len(body))
        body += d
    tags = {256: ("H", [w]), 257: ("H", [h]), 258: ("H", [16]), 259: ("H", [compression]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [1]), 33550: ("d", [2.0, 2.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 100.0, 200.0, 0.0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 32614]), 42113: ("c", [b"7", b"\0"])}
    sizes = [len(d) for d in data]
    tags |= {273: ("I", places), 278: ("H", [h]), 279: ("I", sizes)} if tile is None else {322: ("H", [tile]), 323: ("H", [tile]), 324: ("I", places), 325: ("I", sizes)}
    kinds = {"c": 2, "H": 3, "I": 4, "d": 12}
    ifd, extra, start = struct.pack(order + "H", len(tags)), b"", at + len(body)
    beyond = start + 2 + 12 * len(tags) + 4
    for tag, (code, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{code}", *values)
        ifd += struct.pack(order + "HHI", tag, kinds[code], len(values))
        if len(raw) <= 4:
            ifd += raw.ljust(4, b"\0")
        else:
            ifd += struct.pack(order + "I", beyond + len(extra))
            extra += raw
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, start) + body + ifd + b"\0" * 4 + extra


@pytest.mark.parametrize("how", [{}, {"compression": 8}, {"compression": 8, "predictor": 2}, {"tile": 16}, {"compression": 8, "tile": 16, "order": ">"}])
def test_geotiff(spark, tmp_path, how):
    import numpy as np

    pixels = (np.arange(20 * 33).reshape(20, 33) % 251).astype("u2")
    (tmp_path / "a.tif").write_bytes(tiff(pixels, **how))
    rows = {r.row: r for r in rasters.read_geotiff(spark, str(tmp_path / "a.tif")).collect()}
    assert [[None if v == 7 else float(v) for v in line] for line in pixels.tolist()] == [list(rows[i]["values"]) for i in range(20)]
    r = rows[3]
    assert (r.band, r.epsg, r.x0, r.dx, r.y0, r.dy) == (1, 32614, 100.0, 2.0, 200.0, -2.0)


def test_lzw():
    """A stream of the TIFF specification's example: 7 7 7 8 8 7 7 6 6."""
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    raw = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert list(rasters._unlzw(raw)) == [7, 7, 7, 8, 8, 7, 7, 6, 6]
    with pytest.raises(ValueError, match="compression"):
        rasters._unpacked(b"", 7)


def test_package_is_reprojected_and_has_all_kinds(spark, tmp_path):
    import numpy as np

    from slatework.functions import crs

    path = str(tmp_path / "p.gpkg")
    con = sqlite3.connect(path)
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text, srs_id int)")
    con.execute("insert into gpkg_geometry_columns values ('f', 'geom', 32614)")
    con.execute("create table f (geom blob, height real)")
    head = b"GP\x00\x01" + struct.pack("<i", 32614)
    ring = lambda x: struct.pack("<I", 4) + struct.pack("<8d", x, 3e6, x + 10, 3e6, x + 10, 3000010, x, 3e6)
    poly = lambda x: struct.pack("<BII", 1, 3, 1) + ring(x)
    multi = head + struct.pack("<BII", 1, 6, 2) + poly(5e5) + poly(6e5)
    point = head + struct.pack("<BI3d", 1, 1001, 5e5, 3e6, 9.0)
    con.executemany("insert into f values (?, ?)", [(multi, 5.0), (point, 6.0), (b"GP\x00\x11" + struct.pack("<i", 32614), 7.0)])
    con.commit()
    con.close()
    got = {r.height: r.wkt for r in files.read_geopackage(spark, [path], "f").collect()}
    assert got[7.0] is None
    assert got[5.0].startswith("MULTIPOLYGON (((-99.0")
    assert got[5.0].count("((") == 2
    lon, lat = map(float, got[6.0][7:-1].split())
    assert (lon, lat) == pytest.approx((-99.0, 27.1227), abs=1e-3)
    rnd = np.random.default_rng(1)
    lon, lat = rnd.uniform(-101, -97, 200), rnd.uniform(-80, 84, 200)
    for epsg in (32614, 32714, 3857, 4326):
        back = crs.to_degrees(*crs.from_degrees(lon, lat, epsg), epsg)
        assert np.abs(back[0] - lon).max() < 1e-9
        assert np.abs(back[1] - lat).max() < 1e-9
    with pytest.raises(ValueError, match="2154"):
        crs.to_degrees(lon, lat, 2154)


def test_utm_equals_the_column_series(spark):
    from slatework.functions import crs
    from slatework.operators import spatial

    r = spark.createDataFrame([(27.5, -99.7), (45.0, -97.2), (3.0, -100.1)], "lat double, lon double").select("lat", "lon", *[c.alias(n) for c, n in zip(spatial.utm(F.col("lat"), F.col("lon"), -99.0), "xy", strict=True)]).collect()
    for x in r:
        a, b = crs.from_degrees([x.lon], [x.lat], 32614)
        assert (a[0], b[0]) == pytest.approx((x.x, x.y), abs=0.01)


def test_fetch_skips_what_is_there_and_rows_are_appended(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0)], "filename string, latitude double, longitude double")
    there = spark.createDataFrame([("a",), ("a",)], "name string")
    assert [r.filename for r in files.fetch(df, lambda a, o: b"x", present=there, pause=0.01).collect()] == ["b"]
    p = tmp_path / "deep" / "s.csv"
    files.append_row(str(p), {"a": 1, "b": "x,y"})
    files.append_row(str(p), {"a": 2, "b": "z"})
    assert p.read_text().splitlines() == ["a,b", '1,"x,y"', "2,z"]
    assert files.lower_names(spark.createDataFrame([(1, 2)], "` City ` int, B int")).columns == ["city", "b"]
    with pytest.raises(ValueError, match="one name"):
        files.lower_names(spark.createDataFrame([(1, 2)], "A int, a int"))
