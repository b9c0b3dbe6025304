"""Readers of rasters: GeoTIFF and text grids, as rows of pixels with their placement."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.session import ship

# Bytes and struct codes of the field types of a TIFF.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q"}
# Tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, MATRIX, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113


def _unlzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, high bits first, 256 clears and 257 ends."""
    out, table, width, before = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
    bits = count = 0
    for byte in data:
        bits, count = bits << 8 | byte, count + 8
        if count < width:
            continue
        count -= width
        code, bits = bits >> count, bits & ((1 << count) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = table[:258], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def _unpacked(data: bytes, kind: int) -> bytes:
    if kind == 1:
        return data
    if kind in (8, 32946):
        return zlib.decompress(data)
    if kind == 5:
        return _unlzw(data)
    if kind == 32773:  # runs of bytes
        out, i = bytearray(), 0
        while i < len(data):
            n = data[i]
            if n < 128:
                out += data[i + 1 : i + 2 + n]
                i += 2 + n
            else:
                out += data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
                i += 2 if n > 128 else 1
        return bytes(out)
    raise ValueError(f"compression {kind} is not read")


def tiff_tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first image of a TIFF or BigTIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("no TIFF")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
    (n,) = struct.unpack_from(order + ("Q" if big else "H"), data, at)
    at, step, inner = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
    tags = {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", data, at + i * step)
        (count,) = struct.unpack_from(order + ("Q" if big else "I"), data, at + i * step + 4)
        code = _TYPES.get(kind)
        if code is None:
            continue
        form = f"{order}{count * len(code)}{code[0]}"
        place = at + i * step + (12 if big else 8)
        if struct.calcsize(form) > inner:
            (place,) = struct.unpack_from(order + ("Q" if big else "I"), data, place)
        tags[tag] = struct.unpack_from(form, data, place)
    return order, tags


def tiff_pixels(data: bytes) -> tuple[np.ndarray, dict]:
    """Pixels (bands, rows, columns) of a GeoTIFF and its placement: transform (x0, dx, rx, y0, ry, dy), epsg, nodata."""
    order, tags = tiff_tags(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands, planar, kind, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(PLANAR, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    bits = tags.get(BITS, (8,))
    if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64):
        raise ValueError(f"pixels of {bits} bits are not read")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not read")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(bits[0] // 8))
    tiled = TILES in tags
    w, h = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    across, down = -(-width // w), -(-height // h)
    deep = bands if planar == 1 else 1
    out = np.zeros((bands, down * h, across * w), dtype=dtype.newbyteorder("="))
    for i, (at, size) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        block = np.frombuffer(_unpacked(data[at : at + size], kind), dtype=dtype)
        block = block[: len(block) // (w * deep) * (w * deep)].reshape(-1, w, deep).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        plane, place = divmod(i, across * down)
        r, c = divmod(place, across)
        out[plane : plane + deep, r * h : r * h + len(block), c * w : (c + 1) * w] = np.moveaxis(block[:h], 2, 0)
    transform = None
    if SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIEPOINT][:5]
        transform = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    elif MATRIX in tags:
        m = tags[MATRIX]
        transform = (m[3], m[0], m[1], m[7], m[4], m[5])
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    told = b"".join(tags.get(NODATA, ())).split(b"\0")[0].strip()
    return out[:, :height, :width], {"transform": transform, "epsg": codes.get(3072, codes.get(2048)), "nodata": float(told) if told else None}


GEOTIFF = "path string, band int, row int, epsg int, x0 double, dx double, rx double, y0 double, ry double, dy double, values array<double>"


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """(path, band from 1, row, epsg, transform, values) of GeoTIFF files: a row per line of pixels, nodata null.

    The value at column c lies at x = x0 + c dx + row rx, y = y0 + c ry + row dy (its upper left corner).
    Uncompressed, deflate, LZW and run-length files of whole-byte pixels in strips or tiles are read, others
    raise. A file is decoded in one task; files are spread over tasks.
    """
    ship(spark)

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                pixels, told = tiff_pixels(bytes(content))
                x0, dx, rx, y0, ry, dy = told["transform"] or (None,) * 6
                for b, band in enumerate(pixels):
                    values = band.astype(float)
                    if told["nodata"] is not None:
                        values[values == told["nodata"]] = np.nan
                    for at in range(0, len(values), 256):
                        rows = range(at, min(at + 256, len(values)))
                        yield pd.DataFrame(
                            {"path": name, "band": b + 1, "row": list(rows), "epsg": told["epsg"], "x0": x0, "dx": dx, "rx": rx, "y0": y0, "ry": ry, "dy": dy, "values": [[None if np.isnan(v) else v for v in values[r]] for r in rows]}
                        )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, GEOTIFF)


def read_ascii_raster(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """(band, row, col, value) of a text raster (ESRI ASCII grid), and its header: ncols, nrows, corner, cell size, nodata.

    Rows are numbered by their place in the file, which is read whole in one task however it would be split.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r\n|\r|\n"), lambda v: F.trim(v) != "")).alias("n", "value"))
    head = {}
    for r in lines.where(r"n < 10 and value rlike '^\\s*[A-Za-z]'").collect():  # the header
        name, value = re.split(r"\s+", r["value"].strip())[:2]
        head[name.lower()] = float(value)
    data = lines.where(F.col("n") >= len(head))
    long = data.select((F.col("n") - len(head)).cast("int").alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "v"))
    value = F.col("v").try_cast("double")
    return long.select(F.lit(1).alias("band"), "row", "col", F.when(value != head.get("nodata_value", float("nan")), value).alias("value")), head
