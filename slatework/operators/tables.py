"""Joins, picks and fills that keep a row's identity: enrichment, lookups, overrides, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mapped(c: Column, mapping: dict, default=None) -> Column:
    """Dictionary lookup; unmapped and null give ``default``."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = F.try_element_at(table, c)
    return out if default is None else F.coalesce(out, F.lit(default))


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def first_values(df: DataFrame, keys: list[str], order: list[str], values: list[str], last: bool = False) -> DataFrame:
    """Per key the values of its first (or last) row: a min of structs, so rows are reduced before the shuffle."""
    s = F.struct(*order, *[v for v in values if v not in order])
    return df.groupBy(*keys).agg((F.max(s) if last else F.min(s)).alias("_s")).select(*keys, *[F.col(f"_s.{v}").alias(v) for v in values])


def present_and_absent(left: DataFrame, listing: DataFrame, on: str) -> DataFrame:
    """left with ``present``: whether its key is in the listing. Null keys are absent."""
    known = listing.select(F.col(on).alias("_k")).where("_k is not null").distinct()
    return left.join(known, F.col(on) == F.col("_k"), "left").withColumn("present", F.col("_k").isNotNull()).drop("_k")


def two_key_lookup(left: DataFrame, lookup: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """left with ``value`` by its first key, else by its second; lookup has columns key, value (keys unique)."""
    a = lookup.select(F.col("key").alias("_k1"), F.col(value).alias("_v1"))
    b = lookup.select(F.col("key").alias("_k2"), F.col(value).alias("_v2"))
    out = left.join(a, F.col(first) == F.col("_k1"), "left").join(b, F.col(second) == F.col("_k2"), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).withColumn("matched_by", F.when(F.col("_k1").isNotNull(), "first").when(F.col("_k2").isNotNull(), "second")).drop("_k1", "_k2", "_v1", "_v2")


def keyed_update(left: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """left with ``column`` overwritten where ``updates`` (key, column; keys unique) has its key; ``updated`` tells which."""
    u = updates.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return left.join(u, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).withColumn("updated", F.col("_k").isNotNull()).drop("_k", "_v")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, present, pct of every column, from one pass."""
    n = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in columns])
    return n.select("_all", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in columns]))).select("field", "present", F.try_divide(100.0 * F.col("present"), "_all").alias("pct"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin from 1, n: equal bins from minimum to maximum, the last one closed; empty bins are kept. Nulls don't count."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()  # one row
    labels = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if span["lo"] is None:
        return labels.select("bin", F.lit(0).cast("long").alias("n"))
    lo, hi = float(span["lo"]), float(span["hi"])
    b = F.lit(1) if lo == hi else F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)) + 1, F.lit(bins)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def of_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """df, failing when a row is read whose value isn't allowed; null is allowed only if listed as None."""
    c = F.col(column)
    known = c.isin(*[a for a in allowed if a is not None]) if any(a is not None for a in allowed) else F.lit(False)
    good = F.coalesce(known, F.lit(None in allowed))
    return df.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{column} has the value "), F.coalesce(c.cast("string"), F.lit("null")))).cast("boolean")))
