"""Statistics of two-dimensional heatmaps, over long pixels or in place on arrays.

Pixel tables have the columns of their keys and pos, x, y, v (double). Everything
that needs one image only is a single aggregation: no image is collected, and the
aggregates combine before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.functions.expr import let

EPS = 1e-12
# Radial bands (inner, outer], the first also holds 0; centred areas.
BANDS = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0)]
AREAS = {"25": 0.25, "50": 0.5}
STEPS = 511


def pixels(df: DataFrame, keys: list[str], values: str, width: int) -> DataFrame:
    """keys, pos, x, y, v of an array of row-major pixels; null arrays give none."""
    p = df.select(*keys, F.posexplode(values).alias("pos", "v"))
    return p.select(*keys, "pos", (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


def checked(df: DataFrame, values: str, width: int, height: int) -> DataFrame:
    """df, failing where an array has not width x height pixels."""
    return df.where(F.when(F.size(values) == width * height, F.lit(True)).otherwise(F.raise_error(F.lit("a heatmap has another shape")).cast("boolean")))


def radial(x: Column, y: Column, width: int, height: int) -> Column:
    """Distance from the centre over the largest one; 0 for a single pixel."""
    cx, cy = (width - 1) / 2, (height - 1) / 2
    far = (cx**2 + cy**2) ** 0.5
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / far if far > 0 else F.lit(0.0)


def _raw() -> list[Column]:
    return [F.sum("v").alias("raw_sum"), F.sum(F.abs("v")).alias("abs_sum"), F.min("v").alias("raw_min"), F.max("v").alias("raw_max"), F.sum(F.greatest(-F.col("v"), F.lit(0.0))).alias("neg")]


def _told() -> list[Column]:
    zero = F.col("abs_sum") <= EPS
    return [*map(F.col, ("raw_sum", "abs_sum", "raw_min", "raw_max")), F.when(zero, 0.0).otherwise(F.col("neg") / F.col("abs_sum")).alias("negative_mass_ratio"), zero.alias("is_zero_sum")]


def normalised(px: DataFrame, keys: list[str]) -> DataFrame:
    """One row per image: raw_sum, abs_sum, raw_min, raw_max, negative_mass_ratio, is_zero_sum."""
    return px.groupBy(*keys).agg(*_raw()).select(*keys, *_told())


def statistics(px: DataFrame, keys: list[str], width: int, height: int, target: float = 0.5) -> DataFrame:
    """One row per image with all spatial statistics of its absolute mass, and what ``normalised`` tells, in one aggregation.

    Masses of bands and centred squares, centroid (the centre if there is no mass) and its
    offset in pixels and normalised, the first peak of the raw map and its
    offset, and the smallest centred square and circle that hold ``target`` of the mass: their
    thresholds are the bucket at which a running sum over at most 512 buckets reaches it.
    """
    cx, cy = (width - 1) / 2, (height - 1) / 2
    d = radial(F.col("x"), F.col("y"), width, height)
    square = F.greatest(2 * F.abs(F.col("x") - cx) / width, 2 * F.abs(F.col("y") - cy) / height)
    bucket = lambda c: F.greatest(F.lit(0), F.ceil(c * STEPS - 1e-9)).cast("int")
    m = px.withColumn("a", F.abs("v")).withColumn("d", d).withColumn("kr", bucket(d)).withColumn("ks", bucket(STEPS * square / STEPS))
    band = lambda i, lo, hi: F.sum(F.when((F.col("d") <= hi) & ((F.col("d") > lo) if i else F.lit(True)), F.col("a")).otherwise(0.0))
    inside = lambda s: F.sum(F.when((F.abs(F.col("x") - cx) <= width * s / 2) & (F.abs(F.col("y") - cy) <= height * s / 2), F.col("a")).otherwise(0.0))
    base = m.groupBy(*keys).agg(
        *_raw(), F.collect_list(F.struct("kr", "ks", "a")).alias("p"),
        F.sum("a").alias("mass"), F.sum(F.col("a") * F.col("x")).alias("mx"), F.sum(F.col("a") * F.col("y")).alias("my"),
        F.min(F.struct((-F.col("v")).alias("n"), "pos", "x", "y")).alias("peak"),
        *[band(i, lo, hi).alias(f"band_{i}") for i, (lo, hi) in enumerate(BANDS)], *[inside(a**0.5).alias(f"square_{n}") for n, a in AREAS.items()],
    )
    zero = F.col("mass") <= EPS
    part = lambda c: F.when(zero, 0.0).otherwise(F.col(c) / F.col("mass"))
    far, least = (cx**2 + cy**2) ** 0.5, ((cx - int(cx)) ** 2 + (cy - int(cy)) ** 2) ** 0.5
    away = lambda x, y: F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    px_x = F.when(zero, cx).otherwise(F.col("mx") / F.col("mass"))
    px_y = F.when(zero, cy).otherwise(F.col("my") / F.col("mass"))
    out = base.select(
        *keys, *[part(f"band_{i}").alias(f"radial_profile_{i}") for i in range(len(BANDS))], *[part(f"square_{n}").alias(f"mass_center_{n}_square") for n in AREAS],
        px_x.alias("centroid_x"), px_y.alias("centroid_y"), away(px_x, px_y).alias("centroid_offset_px"),
        F.col("peak.x").alias("peak_x"), F.col("peak.y").alias("peak_y"), away(F.col("peak.x"), F.col("peak.y")).alias("peak_offset_px"),
        _half("kr", target).alias("radius_for_50_mass_radial"), _half("ks", target).alias("radius_for_50_mass_square"), *_told(),
    )
    out = out.withColumn("centroid_offset_norm", F.least(F.greatest("centroid_offset_px", F.lit(least)) / far, F.lit(1.0)) if far else F.lit(0.0))
    out = out.withColumn("peak_offset_norm", F.col("peak_offset_px") / far if far else F.lit(0.0))
    return out.withColumn("radius_50_gap", F.col("radius_for_50_mass_square") - F.col("radius_for_50_mass_radial"))


def _half(kind: str, target: float) -> Column:
    """The bucket at which the mass of an image's pixels, summed in the order of their buckets, reaches the target."""
    ordered = F.array_sort(F.transform("p", lambda x: F.struct(x[kind].alias("k"), x.a.alias("a"))))
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("int").alias("k"))
    add = lambda s, x: F.struct((s.run + x.a).alias("run"), F.coalesce(s.k, F.when((s.run + x.a) / F.col("mass") >= target - 1e-12, x.k)).alias("k"))
    hit = F.aggregate(ordered, zero, add, lambda s: s.k)
    return F.when(F.col("mass") <= EPS, 0.0).otherwise(F.coalesce(F.least(hit / float(STEPS), F.lit(1.0)), F.lit(1.0)))


def summarised(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Exact medians and quartile ranges (linear) of four metrics, medians of three, means and a fraction, per method."""
    q = lambda c, p: F.percentile(c, p)
    four = ["mass_center_25_square", "mass_center_50_square", "radius_for_50_mass_square", "radius_for_50_mass_radial"]
    three = ["radius_50_gap", "centroid_offset_norm", "peak_offset_norm"]
    return stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_images"), F.count_if("is_zero_sum").alias("zero_sum_images"), F.avg("negative_mass_ratio").alias("mean_negative_mass_ratio"),
        *[x for c in four for x in (q(c, 0.5).alias(f"median_{c}"), (q(c, 0.75) - q(c, 0.25)).alias(f"iqr_{c}"))], *[q(c, 0.5).alias(f"median_{c}") for c in three],
        F.avg((F.col("mass_center_25_square") > 0.5).cast("int")).alias("fraction_center25_over_50pct"),
    )


def profile_summary(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring, mean, std (population) of every radial band."""
    cols = [f"radial_profile_{i}" for i in range(len(BANDS))]
    long = stats.select(*keys, *cols).unpivot(keys, cols, "ring", "share")
    return long.groupBy(*keys, "ring").agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("std"))


# The following work on the array of one row and need no shuffle.


def minmax(a: Column) -> Column:
    """Array scaled to 0..1; a constant one gives zeros. Doubles."""
    scaled = lambda s: F.transform(s.a, lambda v: F.when(s.hi > s.lo, (v - s.lo) / (s.hi - s.lo)).otherwise(0.0))
    return let(a, lambda x: let(F.struct(x.alias("a"), F.array_min(x).alias("lo"), F.array_max(x).alias("hi")), scaled))


def relu_or_abs(a: Column, eps: float = EPS) -> Column:
    """Positive part; where nothing is positive, absolute values. Then scaled to 0..1."""
    flip = (F.array_max(a) <= eps) & (F.array_max(F.transform(a, F.abs)) > eps)
    return let(flip, lambda f: minmax(F.transform(a, lambda v: F.when(f, F.abs(v)).otherwise(F.greatest(v, F.lit(0.0))))))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double"))


def channels(a: Column, n: int, size: int, kind: str) -> Column:
    """Array of n channels of ``size`` values reduced over the channels: mean, abs (sum of absolutes) or positive (sum of positive parts)."""

    def at(i: Column) -> Column:
        vs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.element_at(a, (c * size + i + 1).cast("int")))
        f = {"mean": lambda v: v, "abs": F.abs, "positive": lambda v: F.greatest(v, F.lit(0.0))}[kind]
        total = F.aggregate(vs, F.lit(0.0), lambda s, v: s + f(v))
        return total / n if kind == "mean" else total

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def axis_weights(size: int, to: int) -> np.ndarray:
    """Matrix (to x size) of the bilinear weights of one axis: pixel centres, edges repeated."""
    out = np.zeros((to, size))
    for i in range(to):
        at = max((i + 0.5) * size / to - 0.5, 0.0)
        a = min(int(at), size - 1)
        b, f = min(a + 1, size - 1), at - a
        out[i, a] += 1 - f
        out[i, b] += f
    return out


def bilinear(a: Column, w: int, h: int, w2: int, h2: int) -> Column:
    """Row-major array resized by bilinear weights between pixel centres, edges repeated; null for null and for another size.

    The weights depend on the sizes alone, so a batch of arrays is two products with the
    small matrices of its axes.
    """
    across, down = axis_weights(w, w2), axis_weights(h, h2)

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        fits = [v is not None and len(v) == w * h for v in values]
        out = pd.Series([None] * len(values), dtype=object)
        if any(fits):
            x = np.stack([np.asarray(v, dtype=float) for v, ok in zip(values, fits, strict=True) if ok]).reshape(-1, h, w)
            made = (down @ (x @ across.T)).reshape(len(x), h2 * w2)
            for i, row in zip(np.flatnonzero(fits), made, strict=True):
                out.iat[i] = row
        return out

    return run(a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, null if one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def row_normalised(a: Column, n: int, identity: bool = True) -> Column:
    """n x n row-major matrix: positive parts, plus the identity, each row over its sum (at least 1e-6)."""
    grown = F.transform(a, lambda v, i: F.greatest(v, F.lit(0.0)) + (F.when(i % (n + 1) == 0, 1.0).otherwise(0.0) if identity else 0.0))

    def row(g: Column, r: Column) -> Column:
        total = lambda s: F.greatest(F.aggregate(s, F.lit(0.0), lambda x, v: x + v), F.lit(1e-6))
        return let(F.slice(g, r * n + 1, F.lit(n)), lambda s: let(total(s), lambda t: F.transform(s, lambda v: v / t)))

    return let(grown, lambda g: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: row(g, r))))


def matrix_product(a: Column, b: Column, n: int) -> Column:
    """Product of two n x n row-major matrices."""

    def product(x: Column, y: Column) -> Column:
        def cell(i: Column) -> Column:
            r, c = F.floor(i / n), i % n
            return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(x, (r * n + k + 1).cast("int")) * F.element_at(y, (k * n + c + 1).cast("int"))), F.lit(0.0), lambda s, v: s + v)

        return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), cell)

    return let(a, lambda x: let(b, lambda y: product(x, y)))


def token_gradcam(activations: Column, gradients: Column, channels_: int, tokens: int) -> Column:
    """Heatmap of supplied token activations and gradients (tokens x channels, row-major): the mean over the
    channels of their product, without the class token, positive part or absolute values, scaled to 0..1."""
    product = F.zip_with(activations, gradients, lambda a, g: a * g)
    mean = lambda p: F.transform(F.sequence(F.lit(1), F.lit(tokens - 1)), lambda t: F.aggregate(F.slice(p, t * channels_ + 1, F.lit(channels_)), F.lit(0.0), lambda s, v: s + v) / channels_)
    return let(let(product, mean), relu_or_abs)


def spatial_gradcam(activations: Column, gradients: Column, channels_: int, size: int) -> Column:
    """Heatmap of supplied activations and gradients (channels x size): each channel weighted by the mean of its gradients, then as above."""
    weight = lambda g: F.transform(F.sequence(F.lit(0), F.lit(channels_ - 1)), lambda c: F.aggregate(F.slice(g, c * size + 1, F.lit(size)), F.lit(0.0), lambda s, v: s + v) / size)
    at = lambda a, w, i: F.aggregate(F.transform(w, lambda x, c: x * F.element_at(a, (c * size + i + 1).cast("int"))), F.lit(0.0), lambda s, v: s + v)
    return let(let(gradients, weight), lambda w: relu_or_abs(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: at(activations, w, i))))


def rollout(layers: Column, n: int) -> Column:
    """Class-token row, without itself, of the product of the layers' relevance: an array of structs (attention, gradient) of
    n x n row-major matrices, first layer first. A layer's relevance is the positive part of attention x gradient plus the identity, rows scaled to one."""
    one = lambda x: row_normalised(F.zip_with(x.attention, x.gradient, lambda a, g: a * g), n)
    eye = F.array(*[F.lit(1.0 if i % (n + 1) == 0 else 0.0) for i in range(n * n)])
    return F.slice(F.aggregate(layers, eye, lambda acc, x: matrix_product(one(x), acc, n)), F.lit(2), F.lit(n - 1))
