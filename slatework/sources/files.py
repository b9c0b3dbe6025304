"""Readers of delimited files, curves, run results, listings, label files, grids and packages; plain sinks."""

from __future__ import annotations

import csv
import os
import re
import sqlite3
import struct
import time
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions import crs
from slatework.session import ship, whole_list


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """CSV with a header; the schema is inferred only if none is given."""
    r = spark.read.option("header", True).options(**options)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_csv_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV in UTF-8, or in Latin-1 if any line of any of its files is not UTF-8. Executors look at all bytes, not the driver."""
    # Lines keep their bytes as they are in the file; no character of UTF-8 has the byte of a line's end within it.
    latin = not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
    return read_csv(spark, path, schema, encoding="ISO-8859-1" if latin else "UTF-8")


def _described(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, name, first, head, value) of every line below the header, in files whose first line is a description and whose second is the header.

    Lines are told apart by their place in their file: a split that starts a file has its first
    lines, however many splits follow. Blank lines are none.
    """
    meta = F.col("_metadata")
    lines = spark.read.options(**options).text(path).select("value", meta["file_path"].alias("file"), meta["file_name"].alias("name"), meta["file_block_start"].alias("block")).withColumn("n", F.monotonically_increasing_id()).where("trim(value) <> ''")
    below = lines.join(_first_lines(lines), "file").where("block > 0 or n > second")
    return below.select("file", "name", "first", "head", "value")


def _first_lines(lines: DataFrame) -> DataFrame:
    """(file, first, head, second) of the first two lines of each file; the second is told by its number. Files of fewer lines are left out."""
    top = lines.where("block = 0").groupBy("file").agg(F.min(F.struct("n", "value")).alias("a"))
    rest = lines.where("block = 0").join(top.select("file", F.col("a.n").alias("a_n")), "file").where("n > a_n").groupBy("file").agg(F.min(F.struct("n", "value")).alias("b"))
    return top.join(rest, "file").select("file", F.col("a.value").alias("first"), F.col("b.value").alias("head"), F.col("b.n").alias("second"))


def _typed(lines: DataFrame, names: list[str], *also: str) -> DataFrame:
    """Text columns of comma-separated lines."""
    parsed = F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in names)))
    return lines.select(*also, parsed.alias("_v")).select(*also, *[F.col("_v")[n].alias(n) for n in names])


def _names(head: str) -> list[str]:
    return [n.strip() for n in next(csv.reader([head]))]


def read_result_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame | None:
    """A result file whose first line is a description and whose second is the header.

    Header names are stripped, cells are text. Missing or empty files give None; a file
    without a required column raises ValueError. The two lines are dropped by their place,
    so data that reads like them stays. Several files must have one header.
    """
    try:
        lines = _described(spark, path)
    except AnalysisException:
        return None
    heads = whole_list(lines.select("head").distinct(), 1)
    if not heads:
        heads = whole_list(_first_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).where("trim(value) <> ''")).select("head").distinct(), 1)
    if not heads:
        return None
    names = _names(heads[0]["head"])
    absent = [c for c in required if c not in names]
    if absent:
        raise ValueError(f"{path}: columns {absent} are missing")
    return _typed(lines, names)


#: Different headers that the run files of a folder may have.
MOST_HEADERS = 1000


def read_runs(spark: SparkSession, folder: str, required: list[str]) -> DataFrame:
    """All run results ``{mode}_seed_{seed}.csv`` of a folder in one scan, with mode and seed from the file name.

    The first line of a file is a description, the second its header. Files without a
    required column, and those of fewer than two lines, are skipped; ``run_report`` tells how many.
    """
    lines = _described(spark, folder, pathGlobFilter="*_seed_*.csv")
    out = None
    for r in whole_list(lines.select("head").distinct().orderBy("head"), MOST_HEADERS):
        names = _names(r["head"])
        if all(c in names for c in required):
            one = _typed(lines.where(F.col("head").eqNullSafe(r["head"])), names, "name")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        out = _typed(lines.where("false"), required, "name")
    part = lambda i: F.regexp_extract("name", r"^(.*)_seed_(\d+)\.csv$", i)
    return out.select("*", part(1).alias("mode"), part(2).cast("int").alias("seed")).drop("name")


def run_report(spark: SparkSession, folder: str, required: list[str], modes: list[str], seeds: range) -> DataFrame:
    """(mode, loaded, skipped) of the runs asked for: skipped are those whose file is missing, has no rows or lacks a required column."""
    asked = spark.createDataFrame([(m,) for m in modes], "mode string").withColumn("seed", F.explode(F.sequence(F.lit(seeds.start), F.lit(seeds.stop - 1)))) if len(seeds) else spark.createDataFrame([], "mode string, seed int")
    there = read_runs(spark, folder, required).select("mode", "seed").distinct().withColumn("there", F.lit(True))
    return asked.join(there, ["mode", "seed"], "left").groupBy("mode").agg(F.count("there").alias("loaded"), (F.count(F.lit(1)) - F.count("there")).alias("skipped"))


def lower_names(df: DataFrame) -> DataFrame:
    """Column names in lower case without blanks around them; two that become one raise ValueError."""
    names = [c.strip().lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns of {df.columns} have one name in lower case")
    return df.toDF(*names)


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """Curve files in long form: curve (file name), ordinal, im, limit_state, poe. The first column is the intensity; bad numbers are null."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.withColumnsRenamed({c: c.strip() for c in raw.columns})
    im, states = raw.columns[0], raw.columns[1:]
    rows = raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "").alias("curve"), F.monotonically_increasing_id().alias("ordinal"), F.trim(F.col(f"`{im}`")).try_cast("double").alias("im"), *[F.trim(F.col(f"`{s}`")).try_cast("double").alias(s) for s in states])
    return rows.unpivot(["curve", "ordinal", "im"], states, "limit_state", "poe")


def read_block(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Numbers separated by blanks, without a header."""
    t = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    return t.select(*[F.try_element_at("p", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(columns)])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Buildings of label files (features.lng_lat[]): uid, subtype, wkt; the first by path and position of each uid."""
    schema = "features struct<lng_lat:array<struct<wkt:string,properties:struct<feature_type:string,uid:string,subtype:string>>>>"
    j = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    f = j.select("file", F.posexplode("features.lng_lat").alias("pos", "f")).where("f.properties.feature_type = 'building'")
    first = f.groupBy(F.col("f.properties.uid").alias("uid")).agg(F.min(F.struct("file", "pos", F.col("f.properties.subtype").alias("subtype"), F.col("f.wkt").alias("wkt"))).alias("s"))
    return first.select("uid", "s.subtype", "s.wkt")


def read_grid_xml(spark: SparkSession, path: str) -> DataFrame:
    """Grid files in XML: one row per line of the data block, ``fields`` mapping each declared name to its number."""
    w = spark.read.text(path, wholetext=True)
    tags = F.regexp_extract_all("value", F.lit(r"(<grid_field\s[^>]*>)"), F.lit(1))
    entry = lambda t: F.struct(F.regexp_extract(t, r'name="([^"]+)"', 1).alias("k"), (F.regexp_extract(t, r'index="(\d+)"', 1).cast("int")).alias("i"))
    block = F.regexp_extract("value", r"(?s)<grid_data>(.*?)</grid_data>", 1)
    rows = w.select(F.transform(tags, entry).alias("tags"), F.split(F.trim(block), r"[\r\n]+").alias("block")).select("tags", F.posexplode("block").alias("line", "text")).where("trim(text) <> ''")
    rows = rows.withColumn("p", F.split(F.trim("text"), r"\s+"))
    return rows.select("line", F.map_from_entries(F.transform("tags", lambda t: F.struct(t.k, F.try_element_at(F.col("p"), t.i).try_cast("double")))).alias("fields"))


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg")) -> DataFrame:
    """path, name and the split named by a folder (unknown if none) of all images below a folder; contents aren't read."""
    glob = "*.{" + ",".join(x for e in extensions for x in (e, e.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length")
    part = F.regexp_extract(F.lower("path"), r"/(train|val|holdout)/", 1)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.coalesce(F.nullif(part, F.lit("")), F.lit("unknown")).alias("split"), "length")


def _wkb(blob: bytes, at: int, change) -> tuple[str | None, str, int]:
    """Kind, text without its kind, and end of the well-known binary at a place; further dimensions are dropped."""
    end = "<" if blob[at] == 1 else ">"
    (kind,) = struct.unpack_from(end + "I", blob, at + 1)
    at, wide = at + 5, 2
    if kind & 0xE0000000:  # dimensions by high bits, and a reference system
        wide += bool(kind & 0x80000000) + bool(kind & 0x40000000)
        at += 4 if kind & 0x20000000 else 0
        kind &= 0x0FFFFFFF
    else:
        wide += {0: 0, 1: 1, 2: 1, 3: 2}.get(kind // 1000, 0)
        kind %= 1000

    def line(at: int) -> tuple[str, int]:
        (n,) = struct.unpack_from(end + "I", blob, at)
        xy = np.frombuffer(blob, dtype=end + "f8", count=n * wide, offset=at + 4).reshape(n, wide)
        x, y = change(xy[:, 0], xy[:, 1])
        return "(" + ", ".join(f"{a!r} {b!r}" for a, b in zip(x.tolist(), y.tolist(), strict=True)) + ")", at + 4 + n * wide * 8

    if kind == 1:
        xy = struct.unpack_from(f"{end}{wide}d", blob, at)
        x, y = change(np.array([xy[0]]), np.array([xy[1]]))
        return "POINT", f"({float(x[0])!r} {float(y[0])!r})", at + wide * 8
    if kind == 2:
        text, at = line(at)
        return "LINESTRING", text, at
    if kind == 3:
        (n,) = struct.unpack_from(end + "I", blob, at)
        rings, at = [], at + 4
        for _ in range(n):
            text, at = line(at)
            rings.append(text)
        return "POLYGON", "(" + ", ".join(rings) + ")", at
    if kind in (4, 5, 6):
        (n,) = struct.unpack_from(end + "I", blob, at)
        parts, at = [], at + 4
        for _ in range(n):
            _, text, at = _wkb(blob, at, change)
            parts.append(text)
        return {4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}[kind], "(" + ", ".join(parts) + ")", at
    return None, "", at


def _gpkg_geometry(blob: bytes, change) -> str | None:
    """WKT of a GeoPackage geometry blob: points, lines, polygons and collections of one of them; null for others and empty ones."""
    if not blob or blob[:2] != b"GP" or blob[3] >> 4 & 1:
        return None
    kind, text, _ = _wkb(bytes(blob), 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7], change)
    return f"{kind} {text}" if kind else None


def read_geopackage(spark: SparkSession, paths: list[str], table: str, value: str = "height", epsg: int = 4326) -> DataFrame:
    """wkt and a value column of GeoPackage (SQLite) files, nulls dropped, coordinates in ``epsg``. One task per file; each streams its rows.

    Layers in EPSG 4326, 3857 or a UTM zone are reprojected where they are not in ``epsg``; a
    layer whose system is undefined (-1, 0) or not told is taken as it is, any other raises ValueError.
    """
    for n in (table, value):
        if not re.fullmatch(r"\w+", n):
            raise ValueError(n)
    ship(spark)

    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                columns = [r[1] for r in con.execute("PRAGMA table_info(gpkg_geometry_columns)")]
                told = con.execute(f"SELECT column_name, {'srs_id' if 'srs_id' in columns else 'NULL'} FROM gpkg_geometry_columns WHERE table_name = ?", (table,)).fetchone()
                geom, srs = told[0], told[1]
                if srs in (None, -1, 0, epsg):
                    change = lambda x, y: (x, y)
                elif crs.known(srs) and crs.known(epsg):
                    change = lambda x, y, srs=srs: crs.from_degrees(*crs.to_degrees(x, y, srs), epsg)
                else:
                    raise ValueError(f"{path}: EPSG:{srs} is not known")
                cur = con.execute(f'SELECT "{geom}", "{value}" FROM "{table}" WHERE "{value}" IS NOT NULL')
                while rows := cur.fetchmany(10_000):
                    yield pd.DataFrame([(_gpkg_geometry(g, change), float(v)) for g, v in rows], columns=["wkt", value])
                con.close()

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, f"wkt string, `{value}` double")


def fetch(rows: DataFrame, get, attempts: int = 5, wait=None, pause: float = 0.0, present: DataFrame | None = None) -> DataFrame:
    """rows (filename, latitude, longitude) with ``content`` and ``reason``: fetched in the executors by ``get(lat, lon) -> bytes``.

    Names that ``present`` (a listing with ``name``) has are skipped. Bad coordinates and exhausted attempts are told by ``reason`` (bad_coordinates, request_failed);
    between attempts ``wait(n)`` is called, and a task sleeps ``pause`` seconds after each row. No network is used here: the caller brings ``get``.
    """

    def run(batches):
        for pdf in batches:
            content, reason = [], []
            for a, o in zip(pdf["latitude"], pdf["longitude"], strict=True):
                data, why = None, None
                if pd.isna(a) or pd.isna(o) or abs(a) > 90 or abs(o) > 180:
                    why = "bad_coordinates"
                else:
                    why = "request_failed"
                    for n in range(1, attempts + 1):
                        try:
                            data, why = get(a, o), None
                            break
                        except Exception:
                            if wait:
                                wait(n)
                    if pause:
                        time.sleep(pause)
                content.append(data)
                reason.append(why)
            yield pdf.assign(content=content, reason=reason)

    d = rows.select("filename", "latitude", "longitude")
    if present is not None:
        d = d.join(present.select(F.col("name").alias("filename")).distinct(), "filename", "left_anti")
    return d.mapInPandas(run, "filename string, latitude double, longitude double, content binary, reason string")


def append_row(path: str, row: dict[str, object]) -> None:
    """Add a row to a CSV file; the header is written once, to a file that is missing or empty."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, fieldnames=list(row))
        if f.tell() == 0:
            w.writeheader()
        w.writerow(row)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def exposure_xml(name: str, costs: list[str], file: str) -> str:
    """Exposure metadata pointing to an asset file."""
    kinds = "".join(f'<costType name="{escape(c)}" type="aggregated" unit="USD"/>' for c in costs)
    return f'<?xml version="1.0" encoding="utf-8"?><nrml xmlns="http://openquake.org/xmlns/nrml/0.5"><exposureModel id="{escape(name)}" category="buildings"><conversions><costTypes>{kinds}</costTypes></conversions><assets>{escape(file)}</assets></exposureModel></nrml>'


def site_model_rows(sites: DataFrame) -> DataFrame:
    """One XML element of a site model per distinct place, coordinates with eight decimals."""
    s = sites.select("lon", "lat", "vs30").groupBy("lon", "lat").agg(F.min("vs30").alias("vs30"))
    return s.select(F.format_string('<site lon="%.8f" lat="%.8f" vs30="%.1f"/>', "lon", "lat", "vs30").alias("value"))


def fragility_rows(curves: DataFrame) -> DataFrame:
    """One XML fragility function per curve of long rows (curve, imt, im, limit_state, poe), states in order of name."""
    per = curves.groupBy("curve", "imt", "limit_state").agg(F.sort_array(F.collect_list(F.struct("im", F.coalesce("poe", F.lit(0.0)).alias("poe")))).alias("p"))
    text = lambda f: F.array_join(F.transform("p", lambda x: F.format_string("%.8f", x[f])), " ")
    per = per.withColumn("poes", F.format_string('<poes ls="%s">%s</poes>', "limit_state", text("poe"))).withColumn("ims", text("im"))
    one = per.groupBy("curve", "imt").agg(F.sort_array(F.collect_list("poes")).alias("poes"), F.min("ims").alias("ims"))
    return one.select("curve", F.format_string('<fragilityFunction id="%s" format="discrete"><imls imt="%s">%s</imls>%s</fragilityFunction>', "curve", "imt", "ims", F.array_join("poes", "")).alias("value"))


def job_ini(values: dict[str, dict[str, object]]) -> str:
    """An ini file of sections."""
    return "\n\n".join(f"[{s}]\n" + "\n".join(f"{k} = {v}" for k, v in kv.items()) for s, kv in values.items()) + "\n"


def replace_atomically(path: str, text: str) -> None:
    """A small file written beside its place and moved there, so readers never see half of it."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def first_found(root: str, patterns: list[str]) -> str | None:
    """The first file by the order of the patterns, then by name."""
    import glob

    for p in patterns:
        if found := sorted(glob.glob(os.path.join(root, p), recursive=True)):
            return found[0]
    return None


def nearby_buildings(buildings: DataFrame, point: tuple[float, float] | None = None, radius_m: float = 50.0, box: tuple[float, float, float, float] | None = None, place: str | None = None) -> DataFrame:
    """Buildings (latitude, longitude, city, ...) of a local table around a point, in a box (south, west, north, east) or of a place: the stand-in for a map service.

    Box and place are pushed down to the scan; a point is prefiltered by its box, then by the exact distance.
    """
    from slatework.functions import geo

    out = buildings
    if point is not None:
        lat, lon = point
        pad = radius_m / 111_000.0
        out = out.where(F.col("latitude").between(lat - pad, lat + pad)).where(geo.great_circle_m(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)) <= radius_m)
    if box is not None:
        out = out.where(F.col("latitude").between(box[0], box[2]) & F.col("longitude").between(box[1], box[3]))
    return out if place is None else out.where(F.col("city") == place)
